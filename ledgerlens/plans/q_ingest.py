"""Registered queries: validation, typed projection, files, parameterised reads."""

from __future__ import annotations

import datetime
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import validate as va
from ..session import scratch_path
from ..sources import files as fs
from . import adapters as ad
from . import oracle as o
from . import store as st
from .catalog import register

RAW_LEDGER_SQL = o.SQL_LEDGER_NATION.rstrip() + """,
raw AS (SELECT transaction_id, gl_account_id, CAST(transaction_date AS VARCHAR) AS date,
               CAST(amount AS VARCHAR) AS amount, description, department, vendor, source_file FROM ledger)"""


_DIRTY = o.with_(o.SQL_LEDGER_NATION, o.SQL_DIRTY_LEDGER)
_DIRTY_ACC = o.with_(o.SQL_ACCOUNTS_CUSTOMER, o.SQL_DIRTY_ACCOUNTS)
_RULES = ("null_account", "null_amount", "non_numeric_amount", "bad_date", "zero_amount", "null_transaction_id")


@register("quality_report", _DIRTY + "SELECT count(*) AS rows, " + ", ".join(f"count_if({r}) AS {r}" for r in _RULES) + " FROM broken")
def quality_report(spark, sf):
    """Counts of each fault over the ledger with faults."""
    return va.quality_report(ad.dirty_ledger(spark, sf))


@register("quality_report_accounts", _DIRTY_ACC + """
SELECT count(*) AS rows, count_if(null_account_id) AS null_account_id, count_if(bad_category) AS bad_category,
       count_if(threshold_out_of_range) AS threshold_out_of_range FROM broken_acc""")
def quality_report_accounts(spark, sf):
    return va.quality_report(ad.dirty_accounts(spark, sf), kind="accounts")


@register("quarantine_ledger", _DIRTY + """,
listed AS (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in _RULES) + """], lambda x: x IS NOT NULL) AS rules FROM broken)
SELECT transaction_id, CASE WHEN len(rules) = 0 THEN CAST(round(number, 2) AS DECIMAL(18,2)) END AS amount,
       array_to_string(rules, ',') AS broken_rules FROM listed""")
def quarantine_ledger(spark, sf):
    """Quarantine mode over the ledger with faults, stored in one pass: the
    good rows typed, the bad ones with the rules that they break."""
    path = scratch_path(spark, "quarantine")
    st.store_classified(ad.dirty_ledger(spark, sf), path, "batch")
    good, bad = st.stored_rows(spark, path, "good", "batch"), st.stored_rows(spark, path, "bad", "batch")
    return good.select("transaction_id", "amount", F.lit("").alias("broken_rules")).unionByName(
        bad.select("transaction_id", F.lit(None).cast(good.schema["amount"].dataType).alias("amount"),
                   F.array_join("broken_rules", ",").alias("broken_rules")))


@register("quarantine_counts", _DIRTY + """
SELECT 'rows' AS name, count(*) AS n FROM broken
UNION ALL SELECT 'bad_rows', count_if(""" + " OR ".join(f"coalesce({r}, FALSE)" for r in _RULES) + ") FROM broken " + " ".join(
    f"UNION ALL SELECT '{r}', count_if({r}) FROM broken" for r in _RULES))
def quarantine_counts(spark, sf):
    """What the one pass of quarantine mode counted while it wrote."""
    path = scratch_path(spark, "quarantine_counts")
    st.store_classified(ad.dirty_ledger(spark, sf), path, "batch")
    return spark.read.parquet(f"{path}/counts").select("name", "n")


@register("project_ledger", o.with_(o.SQL_LEDGER_NATION) + "SELECT * FROM ledger")
def project_ledger(spark, sf):
    return va.project_ledger(ad.raw_ledger_by_nation(spark, sf), mode="fail")


@register("project_accounts", o.with_(o.SQL_ACCOUNTS_NATION) + "SELECT * FROM accounts")
def project_accounts(spark, sf):
    acc = ad.accounts_from_nations(spark, sf)
    raw = acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])
    return va.project_accounts(raw, mode="fail")


@register("check_flag_domain", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """,
dirty_flags AS (SELECT gl_account_id, month,
  CASE month(month) % 4 WHEN 0 THEN ' ' || direction || '  ' WHEN 1 THEN upper(direction) WHEN 2 THEN 'sideways' ELSE direction END AS direction,
  CASE CAST(gl_account_id AS INT) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN upper(severity) || ' ' ELSE severity END AS severity,
  CAST(CAST(gl_account_id AS INT) - 2 AS DOUBLE) / 20.0::DOUBLE AS confidence FROM flags)
SELECT gl_account_id, month, lower(trim(direction)) AS direction, lower(trim(severity)) AS severity, confidence,
       coalesce(lower(trim(direction)) IN ('increase', 'decrease') AND lower(trim(severity)) IN ('high', 'medium', 'low')
                AND confidence BETWEEN 0 AND 1, FALSE) AS domain_ok
FROM dirty_flags""")
def check_flag_domain(spark, sf):
    """Flags with padded, upper-cased and unknown values and confidences outside 0 to 1."""
    from .q_core import nation_flags
    m, k = F.month("month") % 4, F.col("gl_account_id").cast("int")
    d, sv = F.col("direction"), F.col("severity")
    flags = nation_flags(spark, sf).select(
        "gl_account_id", "month",
        F.when(m == 0, F.concat(F.lit(" "), d, F.lit("  "))).when(m == 1, F.upper(d)).when(m == 2, F.lit("sideways")).otherwise(d).alias("direction"),
        F.when(k % 5 == 0, F.lit("critical")).when(k % 5 == 1, F.concat(F.upper(sv), F.lit(" "))).otherwise(sv).alias("severity"),
        ((k - 2).cast("double") / F.lit(20.0)).alias("confidence"))
    return va.check_flag_domain(flags, confidence_col="confidence")


@register("check_balance_domain", o.DETECT_CUSTOMER + """
SELECT gl_account_id, month, net_balance, transaction_count - 2 AS transaction_count FROM balances WHERE transaction_count - 2 < 0""")
def check_balance_domain(spark, sf):
    """Counts shifted by two, so accounts with a single transaction in a month are out of the domain."""
    from ..operators import balances as bal
    b = bal.monthly_balances(ad.ledger_by_customer(spark, sf))
    return va.check_balance_domain(b.withColumn("transaction_count", F.col("transaction_count") - 2))


@register("validate_month", """
WITH c AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS candidate FROM orders
           UNION SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) FROM orders
           UNION SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) + 3 AS VARCHAR) FROM orders)
SELECT candidate,
       regexp_matches(candidate, '^\\d{4}-(0[1-9]|1[0-2])$') AND try_strptime(candidate || '-01', '%Y-%m-%d') IS NOT NULL AS valid
FROM c""")
def validate_month(spark, sf):
    """Month labels as users type them: ``YYYY-MM``, ``YYYY-M`` and
    off-by-three months (some past 12)."""
    od = ad.table(spark, sf, "orders").select("o_orderdate")
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate")
    c = (od.select(F.date_format("o_orderdate", "yyyy-MM").alias("candidate"))
         .union(od.select(F.concat(y, F.lit("-"), m.cast("string")).alias("candidate")))
         .union(od.select(F.concat(y, F.lit("-"), (m + 3).cast("string")).alias("candidate")))
         .distinct())
    return c.select("candidate", va.validate_month(F.col("candidate")).alias("valid"))


@register("validate_identifier", """
SELECT c_name AS name, coalesce(regexp_matches(c_name, '^[a-zA-Z0-9_]+$'), FALSE) AS valid FROM customer
UNION ALL
SELECT n_name, coalesce(regexp_matches(n_name, '^[a-zA-Z0-9_]+$'), FALSE) FROM nation""")
def validate_identifier(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    n = ad.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    u = c.unionByName(n)
    return u.select("name", va.validate_identifier(F.col("name")).alias("valid"))


@register("validate_keys", """
WITH p AS (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'OPENAI_API_KEY' ELSE 'SEARCH_API_KEY' END AS name,
                  regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS value FROM pages)
SELECT page_id, name, value,
       CASE WHEN value IS NULL OR value = '' THEN FALSE
            WHEN name = 'OPENAI_API_KEY' THEN regexp_matches(value, '^sk-[a-zA-Z0-9]{48,}$') ELSE TRUE END AS valid,
       CASE WHEN value IS NULL OR value = '' THEN 'Missing'
            WHEN name = 'OPENAI_API_KEY' AND NOT regexp_matches(value, '^sk-[a-zA-Z0-9]{48,}$') THEN 'Invalid format' END AS error
FROM p""")
def validate_keys(spark, sf):
    """Key name/value pairs taken from pages: the tracking number stands
    for the key value (so the secret-format rule rejects it)."""
    p = ad.table(spark, sf, "pages")
    pairs = p.select(
        "page_id",
        F.when(F.col("url").startswith("https"), F.lit("OPENAI_API_KEY")).otherwise(F.lit("SEARCH_API_KEY")).alias("name"),
        F.regexp_extract("html", r"track\(([0-9]+)\)", 1).alias("value"))
    return va.validate_keys(pairs)


@register("table_read", o.DETECT_NATION + """
SELECT * FROM balances WHERE month >= DATE '1999-01-01' AND net_balance > 1000000""")
def table_read(spark, sf):
    """Parameterised SQL over a registered view (named parameters)."""
    from ..operators import balances as bal
    name = f"balances_{uuid.uuid4().hex[:8]}"
    bal.monthly_balances(ad.ledger_by_nation(spark, sf)).createOrReplaceTempView(name)
    return fs.table_read(spark, f"SELECT * FROM {name} WHERE month >= :since AND net_balance > :floor",
                         since=datetime.date(1999, 1, 1), floor=1000000)


_QUOTED = o.with_(o.SQL_LEDGER_NATION, o.SQL_QUOTED_LEDGER)


@register("load_all_months", _QUOTED + "SELECT * EXCLUDE (source_file) FROM quoted")
def load_all_months(spark, sf):
    """Round trip: the ledger written as monthly CSV files (one folder per
    month, in the shared scratch folder), read back from the folder of
    files, validated and typed."""
    out = scratch_path(spark, "ledger_csv")
    fs.sink_ledger_csv(ad.quoted_ledger(spark, sf), out, combined=False)
    raw = fs.scan_ledger_months(spark, f"{out}/by_month", pattern="*/*.csv")
    return va.project_ledger(raw, mode="fail").drop("source_file")


@register("scan_accounts_csv", o.with_(o.SQL_ACCOUNTS_CUSTOMER) + "SELECT * FROM accounts")
def scan_accounts_csv(spark, sf):
    """Round trip: the customer account master written as CSV, read back
    with the explicit text schema and typed."""
    acc = ad.accounts_from_customers(spark, sf)
    out = scratch_path(spark, "accounts_csv")
    acc.write.option("header", True).options(**fs.CSV_QUOTING).csv(out)
    return va.project_accounts(fs.scan_accounts(spark, out), mode="fail")


# ---------------------------------------------------------------------------
# One query per validation rule: every row with the rule's verdict
# ---------------------------------------------------------------------------

def _rule_rows(raw, rules, id_col, names):
    r = rules(raw)
    return raw.select(id_col, *[F.coalesce(r[n], F.lit(False)).alias(n) for n in names])


_RAW = o.with_(RAW_LEDGER_SQL)


@register("check_required_columns", _RAW + """
SELECT transaction_id, gl_account_id, date, amount, description FROM raw""")
def check_required_columns(spark, sf):
    """The schema check (raises on a missing column), then the required
    columns of every row."""
    raw = ad.raw_ledger_by_nation(spark, sf)
    va.check_required_columns(raw, "ledger")
    return raw.select("transaction_id", "gl_account_id", "date", "amount", "description")


def _ledger_rule(spark, sf, *names):
    return _rule_rows(ad.dirty_ledger(spark, sf), va.ledger_rules, "row_key", list(names))


def _account_rule(spark, sf, *names):
    return _rule_rows(ad.dirty_accounts(spark, sf), va.account_rules, "row_key", list(names))


@register("check_nulls", _DIRTY + "SELECT row_key, null_account, null_amount FROM broken")
def check_nulls(spark, sf):
    return _ledger_rule(spark, sf, "null_account", "null_amount")


@register("check_numeric", _DIRTY + "SELECT row_key, non_numeric_amount FROM broken")
def check_numeric(spark, sf):
    return _ledger_rule(spark, sf, "non_numeric_amount")


@register("check_dates", _DIRTY + "SELECT row_key, bad_date FROM broken")
def check_dates(spark, sf):
    return _ledger_rule(spark, sf, "bad_date")


@register("check_nonzero_amount", _DIRTY + "SELECT row_key, zero_amount FROM broken")
def check_nonzero_amount(spark, sf):
    return _ledger_rule(spark, sf, "zero_amount")


@register("check_category_domain", _DIRTY_ACC + "SELECT row_key, bad_category FROM broken_acc")
def check_category_domain(spark, sf):
    return _account_rule(spark, sf, "bad_category")


@register("check_threshold_range", _DIRTY_ACC + "SELECT row_key, threshold_out_of_range FROM broken_acc")
def check_threshold_range(spark, sf):
    return _account_rule(spark, sf, "threshold_out_of_range")


# ---------------------------------------------------------------------------
# Ledger files: written per month, read back
# ---------------------------------------------------------------------------

@register("sink_ledger_csv", _QUOTED + "SELECT * EXCLUDE (source_file) FROM quoted")
def sink_ledger_csv(spark, sf):
    """The ledger written as monthly CSV files plus one combined file; the
    combined copy read back and typed."""
    out = scratch_path(spark, "ledger_csv_sink")
    fs.sink_ledger_csv(ad.quoted_ledger(spark, sf), out, combined=True)
    return va.project_ledger(fs.scan_ledger(spark, f"{out}/all"), mode="fail").drop("source_file")


@register("scan_ledger", _QUOTED + """
SELECT transaction_id, gl_account_id, CAST(transaction_date AS VARCHAR) AS date, CAST(amount AS VARCHAR) AS amount,
       description, department, '"' || l_vendor || '\\", ' AS vendor, TRUE AS has_file
FROM quoted JOIN (SELECT transaction_id, vendor AS l_vendor FROM ledger) USING (transaction_id)""")
def scan_ledger(spark, sf):
    """Ledger files scanned as text columns, with the file of each row."""
    out = scratch_path(spark, "ledger_scan")
    fs.sink_ledger_csv(ad.quoted_ledger(spark, sf), out, combined=True)
    raw = fs.scan_ledger(spark, f"{out}/all")
    return raw.select("transaction_id", "gl_account_id", "date", "amount", "description", "department", "vendor",
                      F.col("source_file").endswith(".csv").alias("has_file"))


@register("scan_ledger_months", _QUOTED + """
SELECT transaction_id, gl_account_id, CAST(transaction_date AS VARCHAR) AS date, CAST(amount AS VARCHAR) AS amount,
       description, department, '"' || l_vendor || '\\", ' AS vendor, 'month=' || strftime(transaction_date, '%Y-%m') AS folder
FROM quoted JOIN (SELECT transaction_id, vendor AS l_vendor FROM ledger) USING (transaction_id)""")
def scan_ledger_months(spark, sf):
    """Monthly ledger files scanned as text columns; the source file is its
    path below the landing folder."""
    out = scratch_path(spark, "ledger_months")
    fs.sink_ledger_csv(ad.quoted_ledger(spark, sf), out, combined=False)
    raw = fs.scan_ledger_months(spark, f"{out}/by_month", pattern="*/*.csv")
    return raw.select("transaction_id", "gl_account_id", "date", "amount", "description", "department", "vendor",
                      F.split("source_file", "/")[0].alias("folder"))


# ---------------------------------------------------------------------------
# A landing folder of files with headers of their own
# ---------------------------------------------------------------------------

#: by month of the year modulo 4: the columns of its files
_LAYOUTS = {
    0: ["transaction_id", "gl_account_id", "date", "amount", "description", "department", "vendor"],
    1: ["vendor", "date", "description", "transaction_id", "amount", "gl_account_id", "department"],       # other order
    2: ["date", "transaction_id", "gl_account_id", "amount", "description"],                               # without the optional ones
    3: ["transaction_id", "cost_center", "gl_account_id", "date", "amount", "description", "vendor"],      # one column in excess
}


def land_mixed(spark, sf, out):
    """The ledger as CSV files of four layouts; of every 97th transaction the
    last field is missing, of every 89th there is a field too many."""
    led = ad.ledger_by_nation(spark, sf).select(
        "transaction_id", "gl_account_id", F.date_format("transaction_date", "yyyy-MM-dd").alias("date"),
        F.col("amount").cast("string").alias("amount"), F.concat(F.lit('a "b", '), F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce("department", F.lit("")).alias("department"), F.coalesce("vendor", F.lit("")).alias("vendor"),
        F.lit("c1").alias("cost_center"))
    key = F.col("transaction_id").cast("long")
    for k, names in _LAYOUTS.items():
        quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in names]
        line = (F.when(key % 97 == 0, F.concat_ws(",", *quoted[:-1])).when(key % 89 == 0, F.concat_ws(",", *quoted, F.lit("more")))
                .otherwise(F.concat_ws(",", *quoted)))
        # a header of its own stands at the head of each file
        (led.where(F.month("date") % 4 == k).select(line.alias("l")).mapInArrow(_with_header(",".join(names)), "l string")
         .write.text(f"{out}/layout={k}"))


def _with_header(header):
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["l"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["l"])
    return run


@register("header_report", o.with_(o.SQL_LEDGER_NATION) + """
SELECT k AS layout, CASE WHEN k = 9 THEN 'amount,date' ELSE '' END AS missing, CASE k WHEN 3 THEN 'cost_center' WHEN 9 THEN 'total' ELSE '' END AS surplus
FROM (SELECT DISTINCT month(transaction_date) % 4 AS k FROM ledger UNION ALL SELECT 9)""")
def header_report(spark, sf):
    """What the headers of a landing folder lack and have in excess, by layout."""
    out = scratch_path(spark, "landing_headers")
    land_mixed(spark, sf, out)
    ad.ledger_by_nation(spark, sf).select("transaction_id", "gl_account_id", "description", F.col("amount").alias("total")).write.option(
        "header", True).csv(f"{out}/layout=9")
    files = fs.header_report(spark, f"{out}/*/*")
    layout = F.regexp_extract("file_path", r"layout=(\d)", 1).cast("long").alias("layout")
    paths = fs.header_lines(spark, f"{out}/*/*").select(layout, F.element_at(F.split("file_path", "/"), -1).alias("source_file"))
    return files.join(paths, "source_file").select(
        "layout", F.array_join("missing", ",").alias("missing"), F.array_join("surplus", ",").alias("surplus")).distinct()


@register("scan_mixed_headers", o.with_(o.SQL_LEDGER_NATION) + """
SELECT transaction_id, gl_account_id, CAST(transaction_date AS VARCHAR) AS date, CAST(amount AS VARCHAR) AS amount, 'a "b", ' || coalesce(description, '') AS description,
       CASE WHEN month(transaction_date) % 4 IN (0, 1) THEN nullif(department, '') END AS department,
       CASE WHEN month(transaction_date) % 4 <> 2 THEN nullif(vendor, '') END AS vendor
FROM ledger WHERE CAST(transaction_id AS BIGINT) % 97 <> 0 AND CAST(transaction_id AS BIGINT) % 89 <> 0""")
def scan_mixed_headers(spark, sf):
    """A landing folder of files with other column orders, missing and surplus
    columns and broken lines: the good rows, found by name."""
    out = scratch_path(spark, "landing_mixed")
    land_mixed(spark, sf, out)
    raw = fs.scan_ledger(spark, f"{out}/*/*")
    return raw.where("bad_line IS NULL").select("transaction_id", "gl_account_id", "date", "amount", "description",
                                                 F.nullif("department", F.lit("")).alias("department"), F.nullif("vendor", F.lit("")).alias("vendor"))


def _line_sql():
    """The lines of :func:`land_mixed` that do not fit their header."""
    col = {c: f"coalesce({c}, '')" for c in ("department", "vendor", "transaction_id", "gl_account_id")} | {
        "date": "CAST(transaction_date AS VARCHAR)", "amount": "CAST(amount AS VARCHAR)", "description": "'a \"b\", ' || coalesce(description, '')",
        "cost_center": "'c1'"}
    lists = " ".join(f"WHEN {k} THEN [{', '.join(col[c] for c in names)}]" for k, names in _LAYOUTS.items())
    return o.with_(o.SQL_LEDGER_NATION) + f"""
, parts AS (SELECT CAST(transaction_id AS BIGINT) AS n, list_transform(CASE month(transaction_date) % 4 {lists} END,
    lambda x: '"' || replace(x, '"', '""') || '"') AS fields FROM ledger)
SELECT array_to_string(CASE WHEN n % 97 = 0 THEN fields[:-2] ELSE list_append(fields, 'more') END, ',') AS bad_line
FROM parts WHERE n % 97 = 0 OR n % 89 = 0"""


@register("scan_bad_lines", _line_sql())
def scan_bad_lines(spark, sf):
    """The lines of the same folder that have too few or too many fields, as
    quarantine mode stores them."""
    out = scratch_path(spark, "landing_bad")
    land_mixed(spark, sf, out)
    path = scratch_path(spark, "landing_quarantine")
    st.store_classified(fs.scan_ledger(spark, f"{out}/*/*"), path, "batch")
    return st.stored_rows(spark, path, "bad").where(F.array_contains("broken_rules", "malformed_line")).select("bad_line")
