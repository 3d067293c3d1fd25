"""File sources and sinks: ledger and account CSVs, documentation files,
reports and cost summaries."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ACCOUNTS_RAW, BAD_LINE, LEDGER_RAW, missing_columns


#: quoting of all CSV files, the same for reading and writing: a quote within
#: a quoted value is doubled, a backslash is an ordinary character, and blanks
#: at the ends of a value belong to it
CSV_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: a folder with more different headers than this is not one table
MAX_HEADERS = 1000


def header_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, header): the first line with anything in it of every file.

    A pass over the text, without parsing it; of each file only the lines of
    its first split are looked at."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"),
                                          F.col("_metadata.file_block_start").alias("block"))
    first = lines.where((F.col("block") == 0) & (F.trim("value") != "")).withColumn("line", F.monotonically_increasing_id())
    return first.groupBy("file_path").agg(F.min_by("value", "line").alias("header"))


def _names(header: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([header.removeprefix("\ufeff")])))


def header_report(spark: SparkSession, paths: str | list[str], kind: str = "ledger") -> DataFrame:
    """What each file's header lacks and has in excess: source_file, missing
    (required columns), surplus (unknown ones)."""
    known = (LEDGER_RAW if kind == "ledger" else ACCOUNTS_RAW).fieldNames()
    names = F.transform(F.split("header", ","), lambda x: F.trim(F.regexp_replace(x, '["\ufeff]', "")))
    required = F.array(*[F.lit(c) for c in missing_columns([], kind)])
    return header_lines(spark, paths).select(
        F.element_at(F.split("file_path", "/"), -1).alias("source_file"), F.array_sort(F.array_except(required, names)).alias("missing"),
        F.array_sort(F.array_except(names, F.array(*[F.lit(c) for c in known]))).alias("surplus"))


def listed_file(path: str) -> str:
    """A listed file as a path to read: decoded, and not taken for a pattern."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in unquote(path))


def _csv(spark: SparkSession, names: Sequence[str], paths, multi_line: bool, compare: bool) -> DataFrame:
    """Files that share one header.  With ``compare`` Spark compares it with
    the header of every file.  A line with more or fewer fields than the
    header is kept as it stands in BAD_LINE."""
    schema = T.StructType([T.StructField(n or f"_c{k}", T.StringType()) for k, n in enumerate(names)] + [T.StructField(BAD_LINE, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", not compare).option("multiLine", multi_line)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", False)
            .options(**CSV_QUOTING).csv(paths))


def _by_name(spark: SparkSession, kind: str, paths, multi_line: bool, header: Sequence[str] | None, name: Column) -> DataFrame:
    """The known columns of files, found by the header of each file.

    Files with the same header are one read; the reads are put together by
    column name.  A file without a required column raises ValueError,
    optional columns that a file lacks are null, unknown ones are left out."""
    known = (LEDGER_RAW if kind == "ledger" else ACCOUNTS_RAW).fieldNames()
    if header is not None:
        groups = [(tuple(header), paths)]
    else:
        rows = (header_lines(spark, paths).groupBy("header").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
                .orderBy("files").limit(MAX_HEADERS + 1).collect())
        if len(rows) > MAX_HEADERS:
            raise ValueError(f"more than {MAX_HEADERS} different headers in {paths}")
        groups = [(_names(r.header), [listed_file(f) for f in r.files] if len(rows) > 1 else paths) for r in rows]
    parts = []
    for names, files in groups:
        lacking = missing_columns(names, kind)
        if lacking:
            where = files if isinstance(files, str) else ", ".join(files[:3])
            raise ValueError(f"Missing required columns in {kind} data: {lacking} ({where})")
        if len(set(names)) < len(names):
            raise ValueError(f"Repeated columns in {kind} data: {list(names)}")
        df = _csv(spark, names, files, multi_line, compare=header is not None)
        parts.append(df.select(*[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in known], BAD_LINE,
                               name.alias("source_file")))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*known, BAD_LINE, "source_file"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_ledger(spark: SparkSession, paths: str | list[str], multi_line: bool = False,
                base: str | None = None, header: Sequence[str] | None = None) -> DataFrame:
    """Ledger CSV(s) as text columns, found by the names in each file's own
    header, with the source file and an order key (file, position in the
    read) used for first-wins dedupe.  ``bad_line`` holds a line whose number
    of fields is not that of the header, as it stands in the file; else null.

    IDs stay text: reading them as numbers would drop leading zeros.  Files
    are split over tasks; only where values hold line ends must a file be
    read as a whole (``multi_line``).  ``source_file`` is the path below
    ``base`` (the landing folder), so equal names in two folders stay apart;
    without ``base`` it is the file name.

    Headers are found in a pass over the text of the files.  Where all files
    are known to share one, give it as ``header`` and that pass is saved; a
    file with another header then fails the read.
    """
    name = F.col("_metadata.file_name")
    if base is not None:
        # the folder's name as it stands in a listed path
        folder = quote(re.sub(r"\\(.)", r"\1", base.rstrip("/").rsplit("/", 1)[-1]), safe="!$&'()*+,;=:@")
        name = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*/\Q{folder}\E/", "")
    return _by_name(spark, "ledger", paths, multi_line, header, name).withColumn("file_order", F.monotonically_increasing_id())


def scan_ledger_months(spark: SparkSession, folder: str, pattern: str = "pl_*.csv",
                       multi_line: bool = False, header: Sequence[str] | None = None) -> DataFrame:
    """Every monthly ledger file of a folder; ``source_file`` is its path in the folder."""
    return scan_ledger(spark, f"{folder.rstrip('/')}/{pattern}", multi_line, base=folder, header=header)


def scan_accounts(spark: SparkSession, paths: str | list[str], multi_line: bool = False,
                  header: Sequence[str] | None = None) -> DataFrame:
    """Account master file(s) as text columns, found by name; only the required ones must be there."""
    return _by_name(spark, "accounts", paths, multi_line, header, F.col("_metadata.file_name")).drop("source_file")


def account_of_file(name: Column) -> Column:
    """The account a documentation file belongs to: its stem up to the first ``_``."""
    return F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_").getItem(0)


def scan_docs(spark: SparkSession, folder: str, account_from: str = "file") -> DataFrame:
    """Documentation files (``.md`` / ``.txt``, any depth): one row per file.

    ``account_from="file"``: the account id is the file stem up to the
    first ``_`` (the whole stem when there is none).  ``"folder"``: it is
    the ``account_id=`` folder the file lies in (as ``sink_account_docs``
    writes them).
    """
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    acc = (account_of_file(name) if account_from == "file"
           else F.regexp_extract(F.col("_metadata.file_path"), r"account_id=([^/]+)/", 1))
    return (df.select(F.col("value").alias("text"), name.alias("source_file"), acc.alias("account_id"))
            .filter(name.endswith(".md") | name.endswith(".txt")))


def table_read(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL over registered tables (named ``:param`` markers)."""
    return spark.sql(sql, args=params)


def sink_ledger_csv(ledger: DataFrame, out_dir: str, combined: bool = True) -> None:
    """Ledger split per month (``month=YYYY-MM`` folders) plus, optionally,
    one combined copy.  Columns are written in file order: date, not
    transaction_date.  Rows are gathered by month first, so a month has few
    files however many tasks write."""
    cols = [F.col("transaction_id"), F.col("gl_account_id"),
            F.date_format("transaction_date", "yyyy-MM-dd").alias("date"),
            F.col("amount").cast("string").alias("amount"),
            "description", "department", "vendor"]
    out = ledger.select(*cols, F.date_format("transaction_date", "yyyy-MM").alias("month"))
    (out.hint("rebalance", "month").write.mode("overwrite").option("header", True).options(**CSV_QUOTING)
     .partitionBy("month").csv(f"{out_dir}/by_month"))
    if combined:
        out.drop("month").write.mode("overwrite").option("header", True).options(**CSV_QUOTING).csv(f"{out_dir}/all")


def sink_report(lines: DataFrame, path: str) -> None:
    """Report lines (``section``, ``line_no``, ``text``) as ordered text
    parts: the files, read by name one after the other, are the report.
    Lines are range-partitioned by their place, so no task holds them all; a
    small report still ends up in one part (AQE merges small ranges)."""
    (lines.repartitionByRange("section", "line_no").sortWithinPartitions("section", "line_no")
     .select("text").write.mode("overwrite").text(path))


def _money_text(df: DataFrame) -> DataFrame:
    money = [f.name for f in df.schema.fields if f.name.endswith("cost") or f.name.endswith("_cost_usd")]
    for c in money:
        df = df.withColumn(c, F.format_string("%.8f", F.round(F.col(c).cast("decimal(38,11)"), 8).cast("double")))
    return df


def sink_cost_json(summary: DataFrame, path: str, calls: DataFrame | None = None) -> None:
    """Cost summary rows (one per run, with its per-agent breakdown when
    given) as JSON lines under ``summary/``; money columns become 8-decimal
    text.  The calls go to their own JSON-lines table under ``calls/``,
    partitioned by run, so no run's calls are ever gathered into one row."""
    _money_text(summary).write.mode("overwrite").json(f"{path}/summary")
    if calls is not None:
        (_money_text(calls.drop("cost_exact") if "cost_exact" in calls.columns else calls)
         .hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").json(f"{path}/calls"))


def sink_account_docs(docs: DataFrame, out_dir: str, folder_per_account: bool = False) -> None:
    """Generated documents as a JSON-lines table (account id, file name,
    text): file count follows the data size, not the number of accounts.
    ``folder_per_account=True`` writes one text folder per account instead;
    meant for small masters only, since it makes one folder per account."""
    if folder_per_account:
        (docs.select("account_id", "text").write.mode("overwrite")
         .partitionBy("account_id").text(out_dir))
    else:
        docs.select("account_id", "source_file", "text").write.mode("overwrite").json(out_dir)
