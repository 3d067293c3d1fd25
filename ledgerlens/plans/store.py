"""Stored tables: idempotent ledger appends, account upserts, monthly
balance refresh (dynamic partition overwrite), runs, counts.

Tables are parquet folders partitioned by month under a base path (on a
cluster: the shared folder).  Writes happen only here and in the sinks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import balances as bal
from ..operators import detect as det
from ..operators import history as hi
from ..operators import validate as va
from ..schemas import MONEY_SUM

LEDGER_COLS = ["transaction_id", "gl_account_id", "transaction_date", "amount", "description",
               "department", "vendor", "source_file"]


#: conditions under which there is no table: no folder, or a folder without any data file
_NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is there.  Only a missing folder (or one in
    which nothing was written yet) means no; every other fault, such as an
    unreadable file or a missing permission, is raised, so that it is never
    taken for an empty store."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _NO_TABLE:
            return False
        raise
    return True


def write_by(df: DataFrame, partition: str, path: str, mode: str = "append", dynamic: bool = False) -> None:
    """Write partition folders with few files each: rows are first gathered
    by the partition column; the rebalance lets AQE split a large partition
    over tasks and put small ones together."""
    w = df.hint("rebalance", partition).write.mode(mode).partitionBy(partition)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def store_classified(raw: DataFrame, path: str, ingest_id: str, kind: str = "ledger") -> dict[str, int]:
    """Validate a batch and store all of its rows, good and bad apart, in one
    pass over the source: one write, partitioned by ingest and status, that
    also counts (``observe``) the rows and those that break each rule.  A
    retry with the same id replaces what it wrote before.

    Returns the counts, which are kept as a row of ``{path}/counts`` too.
    The counts of a stage that ran twice because an executor was lost can be
    too high; the stored rows are exact."""
    rules = list((va.ledger_rules if kind == "ledger" else va.account_rules)(raw))
    seen = Observation()
    rows = va.classify(raw, kind).withColumn("ingest_id", F.lit(ingest_id)).withColumn(
        "status", F.when(F.size("broken_rules") > 0, "bad").otherwise("good"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken_rules") > 0).alias("bad_rows"),
                        *[F.count_if(F.array_contains("broken_rules", r)).alias(r) for r in rules])
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_id", "status").parquet(f"{path}/rows"))
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    spark = raw.sparkSession
    (spark.createDataFrame([(ingest_id, k, v) for k, v in counts.items()], "ingest_id string, name string, n long")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_id").parquet(f"{path}/counts"))
    return counts


def stored_rows(spark: SparkSession, path: str, status: str, ingest_id: str | None = None) -> DataFrame:
    """Good rows of an ingest as typed columns, or bad rows (of one ingest or
    of all) as text columns with ``broken_rules``."""
    rows = spark.read.parquet(f"{path}/rows").where(F.col("status") == status)
    if ingest_id is not None:
        rows = rows.where(F.col("ingest_id") == ingest_id)
    return rows.select("good.*") if status == "good" else rows.select("ingest_id", "raw.*", "broken_rules")


def dedupe_first(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key by ``order`` (file name, position...).  An
    aggregate with map-side partial merge, so a key repeated a third of the
    time is combined before the shuffle."""
    rest = [c for c in batch.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return batch.groupBy(key).agg(first.alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def new_transactions(batch: DataFrame, existing: DataFrame | None,
                     order: list[str] | None = None, id_scope: str = "global") -> DataFrame:
    """Rows to insert: complete rows (no NULL account, date or amount),
    first per id within the batch, and ids not stored yet (first write wins).

    ``id_scope="global"`` (default, exact) checks the id against the whole
    stored ledger.  ``"month"`` checks it only within the row's month: the
    stored table is partitioned by month, so dynamic partition pruning reads
    only the months the batch touches.  Exact as long as a transaction's
    date never changes between deliveries.
    """
    b = batch.filter(F.col("transaction_id").isNotNull() & F.col("gl_account_id").isNotNull()
                     & F.col("transaction_date").isNotNull() & F.col("amount").isNotNull())
    order = order or (["source_file", "file_order"] if "file_order" in b.columns else ["source_file", "transaction_id"])
    b = dedupe_first(b, "transaction_id", order)
    if existing is not None:
        if id_scope == "month":
            ex_month = existing["month"] if "month" in existing.columns else bal.month_start("transaction_date")
            b = b.withColumn("month", bal.month_start("transaction_date"))
            # The batch's months (a calendar-bounded list) become a filter on
            # the stored table's month partition column: only the touched
            # months are read.  (Spark does not prune the build side of an
            # anti-join dynamically.)
            touched = [r["month"] for r in b.select("month").distinct().collect()]
            ex = existing.select("transaction_id", ex_month.alias("month")).filter(F.col("month").isin(touched))
            b = b.join(ex, ["transaction_id", "month"], "left_anti")
        elif id_scope == "global":
            b = b.join(existing.select("transaction_id"), "transaction_id", "left_anti")
        else:
            raise ValueError(f"id_scope must be 'global' or 'month': {id_scope}")
    return b.select(*[c for c in LEDGER_COLS if c in b.columns])


def append_ledger(spark: SparkSession, batch: DataFrame, path: str, id_scope: str = "global") -> None:
    """Insert-or-ignore by transaction id into the ledger table (partitioned
    by month)."""
    existing = spark.read.parquet(path) if table_exists(spark, path) else None
    new = new_transactions(batch, existing, id_scope=id_scope).withColumn("month", bal.month_start("transaction_date"))
    write_by(new, "month", path)


# --------------------------------------------------------------------------
# A ledger by batches: appends and balance changes that follow the batch
# --------------------------------------------------------------------------


def _overwrite_parts(df: DataFrame, path: str, *parts: str) -> None:
    (df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def append_batch(spark: SparkSession, rows: DataFrame, path: str, batch: int) -> None:
    """Store the rows of one batch in a ledger partitioned by batch and month.
    The rows must be new already (ids deduplicated, see
    ``streams.dedupe_in_state``), so nothing stored is read; a batch that is
    written again replaces itself."""
    new = rows.select(*[c for c in LEDGER_COLS if c in rows.columns], bal.month_start("transaction_date").alias("month"))
    _overwrite_parts(new.withColumn("batch", F.lit(batch).cast("long")), path, "batch", "month")


def store_deltas(spark: SparkSession, ledger_path: str, path: str, batch: int) -> list[str]:
    """What one stored batch changes in the monthly balances, as rows
    (account, month, amount, count) of a table of changes: only that batch of
    the ledger is read.  A batch stored again replaces its changes.  Returns
    the months that it touches."""
    rows = spark.read.parquet(ledger_path).where(F.col("batch") == batch)
    changes = rows.groupBy("gl_account_id", "month").agg(F.sum("amount").cast(MONEY_SUM).alias("amount"), F.count(F.lit(1)).alias("n"))
    _overwrite_parts(changes.withColumn("batch", F.lit(batch).cast("long")).withColumn("folded", F.lit(0)), path, "folded", "batch")
    made = spark.read.parquet(path).where((F.col("folded") == 0) & (F.col("batch") == batch))
    # bounded by the calendar
    return sorted(r["m"] for r in made.select(F.date_format("month", "yyyy-MM").alias("m")).distinct().collect())


def reverse_deltas(spark: SparkSession, rows: DataFrame, path: str, batch: int) -> None:
    """Take rows back out of the balances (withdrawn or corrected ones): the
    same changes with the opposite sign, under a batch number of their own."""
    changes = rows.groupBy("gl_account_id", bal.month_start("transaction_date").alias("month")).agg(
        (-F.sum("amount")).cast(MONEY_SUM).alias("amount"), (-F.count(F.lit(1))).alias("n"))
    _overwrite_parts(changes.withColumn("batch", F.lit(batch).cast("long")).withColumn("folded", F.lit(0)), path, "folded", "batch")


def _open_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The last fold and the changes of later batches."""
    rows = spark.read.parquet(path)
    last = rows.where("folded = 1").agg(F.max("batch")).first()[0]
    if last is None:
        return rows.where((F.col("folded") == 0))
    return rows.where(((F.col("folded") == 1) & (F.col("batch") == last)) | ((F.col("folded") == 0) & (F.col("batch") > last)))


def balances_from_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The monthly balances: all changes since the last fold added up.  An
    account-month whose rows were all taken back is gone."""
    sums = _open_deltas(spark, path).groupBy("gl_account_id", "month").agg(
        F.sum("amount").cast(MONEY_SUM).alias("net_balance"), F.sum("n").alias("transaction_count"))
    return sums.where(F.col("transaction_count") > 0)


def fold_deltas(spark: SparkSession, path: str, upto: int) -> None:
    """Put the changes of all batches up to ``upto`` into one fold, so that
    reads do not grow with the number of batches."""
    rows = _open_deltas(spark, path).where(F.col("batch") <= upto)
    whole = rows.groupBy("gl_account_id", "month").agg(F.sum("amount").cast(MONEY_SUM).alias("amount"), F.sum("n").alias("n"))
    _overwrite_parts(whole.withColumn("batch", F.lit(upto).cast("long")).withColumn("folded", F.lit(1)), path, "folded", "batch")


# --------------------------------------------------------------------------
# Stored feedback
# --------------------------------------------------------------------------


def store_feedback(spark: SparkSession, feedback: DataFrame, base: str) -> None:
    """Store verdicts on anomalies (``base``/feedback) and the thresholds that
    they move (``base``/thresholds): a false positive with
    ``adjust_threshold`` raises its account's threshold.  Verdicts are kept as
    given, and reads take the latest of each anomaly, so storing the same
    feedback again changes nothing."""
    feedback.write.mode("append").parquet(f"{base}/feedback")
    moved = hi.moved_thresholds(spark.read.parquet(f"{base}/investigations"), feedback)
    moved.write.mode("append").parquet(f"{base}/thresholds")


def judged_investigations(spark: SparkSession, base: str) -> DataFrame:
    """The stored investigations with the latest verdict on each."""
    inv = spark.read.parquet(f"{base}/investigations")
    if not table_exists(spark, f"{base}/feedback"):
        return inv
    return hi.apply_feedback(inv, spark.read.parquet(f"{base}/feedback"))


def adjusted_accounts(spark: SparkSession, base: str, survive_reload: bool = True) -> DataFrame:
    """The stored account master with the thresholds that feedback has moved.
    A later load of the master leaves them in force; with
    ``survive_reload=False`` it sets them back, as a plain update would."""
    rows = spark.read.parquet(f"{base}/accounts")
    accounts = current_accounts(spark, f"{base}/accounts")
    if not table_exists(spark, f"{base}/thresholds"):
        return accounts
    moved = spark.read.parquet(f"{base}/thresholds").groupBy("account_id").agg(
        F.max_by(F.struct("threshold", "moved_at"), F.struct("moved_at", "anomaly_id")).alias("last"))
    loaded = rows.groupBy("account_id").agg(F.max("seq").alias("seq"))
    both = accounts.join(loaded, "account_id").join(moved, "account_id", "left")
    holds = F.col("last").isNotNull()
    if not survive_reload:
        holds = holds & (F.unix_micros(F.col("last.moved_at").cast("timestamp")) > F.col("seq"))
    return both.withColumn("variance_threshold_pct", F.when(holds, F.col("last.threshold")).otherwise(F.col("variance_threshold_pct"))).select(
        *accounts.columns)


def upsert_accounts(master: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Replace by account id: a batch row beats the stored one, the last
    batch row (by ``order_col``, a number; null first) beats earlier ones."""
    cols = master.columns
    old = master.select(*cols, F.lit(0).alias("_prio"), F.lit(0).cast("long").alias("_ord"))
    new = batch.select(*cols, F.lit(1).alias("_prio"),
                       F.col(order_col).cast("long").alias("_ord"))
    u = old.unionByName(new)
    rest = [c for c in cols if c != "account_id"]
    win = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct("_prio", "_ord"))
    return u.groupBy("account_id").agg(win.alias("_w")).select("account_id", *[F.col(f"_w.{c}").alias(c) for c in rest])


def store_accounts(batch: DataFrame, path: str, seq: int) -> None:
    """Add a batch of the account master under the sequence number ``seq``
    (higher replaces lower); storing the same batch again changes nothing."""
    write_by(batch.withColumn("seq", F.lit(seq).cast("long")), "seq", path, mode="overwrite", dynamic=True)


def current_accounts(spark: SparkSession, path: str) -> DataFrame:
    """The stored master: of each account the row with the highest sequence number."""
    rows = spark.read.parquet(path)
    return upsert_accounts(rows.drop("seq").limit(0), rows, order_col="seq")


def refresh_balances(spark: SparkSession, ledger: DataFrame, path: str,
                     target_month: str | list[str] | None = None, refresh: str = "target") -> DataFrame:
    """Write the monthly balance table and return it enriched with variance.

    First run (no table): every month.  Later runs: only ``target_month``
    (``refresh="target"``, the parity behaviour: late rows of other months
    stay out) or every month touched by rows missing from the table
    (``refresh="affected"``).  Only the rewritten month partitions change
    (dynamic partition overwrite).
    """
    targets = [target_month] if isinstance(target_month, str) else list(target_month or [])
    if not table_exists(spark, path) or not targets:
        fresh = bal.monthly_balances(ledger)
        write_by(fresh, "month", path, mode="overwrite")
    else:
        if refresh == "affected":
            stored = spark.read.parquet(path)
            diff = late_rows(ledger, stored)
            months = diff.select("month").distinct()
            fresh = bal.monthly_balances(ledger.join(
                months, bal.month_start("transaction_date") == months.month, "left_semi"))
            fresh = fresh.unionByName(bal.monthly_balances(ledger, months=targets)).distinct()
        else:
            fresh = bal.monthly_balances(ledger, months=targets)
        write_by(fresh, "month", path, mode="overwrite", dynamic=True)
    return bal.enrich_balances(spark.read.parquet(path))


def late_rows(ledger: DataFrame, stored_balances: DataFrame) -> DataFrame:
    """Account-months whose stored balance differs from the ledger roll-up
    (rows stored after their month was rolled up)."""
    actual = bal.monthly_balances(ledger).select(
        "gl_account_id", "month", F.col("net_balance").alias("ledger_balance"),
        F.col("transaction_count").alias("ledger_count"))
    stored = stored_balances.select("gl_account_id", "month", F.col("net_balance").alias("stored_balance"),
                                    F.col("transaction_count").alias("stored_count"))
    j = actual.join(stored, ["gl_account_id", "month"], "full_outer")
    return j.filter(~F.col("ledger_balance").eqNullSafe(F.col("stored_balance"))
                    | ~F.col("ledger_count").eqNullSafe(F.col("stored_count")))


def run_rows(flags: DataFrame, accounts: DataFrame, period: str = "monthly", created_at: str | None = None,
             cost_usd: Column | None = None) -> DataFrame:
    """One analysis-run row per target month.  The call count is the
    estimate of one call per anomaly and two for the report; ``cost_usd`` is
    an expression over the counts (see ``costs.estimated_run_cost``), NULL if
    not given.  ``created_at`` is the time of the run; without one, rows are
    dated to the last day of their month."""
    c = det.severity_counts(flags, accounts)
    made = (F.lit(created_at).cast("timestamp_ntz") if created_at is not None
            else F.last_day(F.to_date(F.concat(F.col("current_month"), F.lit("-01")))).cast("timestamp_ntz"))
    return c.select(
        F.lit(period).alias("analysis_period"),
        F.col("current_month").alias("target_month"),
        F.col("accounts_analyzed").alias("total_accounts_analyzed"),
        "anomalies_detected", "high_severity_count", "medium_severity_count",
        (F.col("anomalies_detected") + 2).alias("total_llm_calls"),
        (F.lit(None).cast("double") if cost_usd is None else cost_usd.cast("double")).alias("total_cost_usd"),
        made.alias("created_at"),
    )


def store_investigations(spark: SparkSession, investigations: DataFrame, path: str, dedupe: bool = True) -> None:
    """Append investigation records.  With ``dedupe`` (default) a rerun of
    the same run adds nothing: rows whose (anomaly id, run id) is stored
    already are skipped.  ``dedupe=False`` appends blindly, like the
    reference's unkeyed inserts."""
    new = investigations
    if dedupe and table_exists(spark, path):
        new = new.join(spark.read.parquet(path).select("anomaly_id", "run_id"), ["anomaly_id", "run_id"], "left_anti")
    new.write.mode("append").parquet(path)


def store_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run (a top-1, planned as TakeOrderedAndProject)."""
    return runs.orderBy(F.col("created_at").desc(), F.col("target_month").desc()).limit(1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one frame (one job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sort_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("transaction_date", "transaction_id")
