"""Registered queries: streaming loads, run to completion (available-now)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import ordered as so
from ..streaming import streams as sm
from . import adapters as ad
from . import oracle as o
from . import store as st
from .catalog import register
from .q_ingest import land_mixed


def _landing(spark, sf, files: int = 3, twice: bool = False) -> str:
    """The dense ledger landed in several folders, each with rows of all
    dates (so every one but the first brings late rows and corrects months
    that were flagged already); with ``twice`` each lands once more."""
    path = scratch_path(spark, "landing")
    led = ad.ledger_by_nation(spark, sf).withColumn("land", F.pmod(F.xxhash64("transaction_id"), F.lit(files)))
    led.write.partitionBy("land").parquet(path)
    if twice:
        led.withColumn("land", F.col("land") + files).write.mode("append").partitionBy("land").parquet(path)
    return path


def _stream(spark, path, batches: int = 3):
    """So many micro-batches, with as many files each, however many files have
    landed: a batch has costs of its own, whatever it brings."""
    landed = spark.read.parquet(path)
    files = max(1, -(-len(landed.inputFiles()) // batches))
    return spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files).parquet(path).drop("land")


@register("stream_monthly_balances", o.with_(o.SQL_LEDGER_NATION, o.BALANCES) + "SELECT * FROM balances")
def stream_monthly_balances(spark, sf):
    src = _stream(spark, _landing(spark, sf, files=6), batches=6)
    agg = sm.monthly_balances_stream(src)
    out = sm.upsert_log(agg, scratch_path(spark, "stream_bal"), scratch_path(spark, "ckpt_bal"), keys=["gl_account_id", "month_ts"], fold_every=2)
    res = sm.latest_rows(spark, out, ["gl_account_id", "month_ts"])
    return res.select("gl_account_id", F.col("month_ts").cast("date").alias("month"), "net_balance",
                      "transaction_count")


@register("stream_dedupe", o.with_(o.SQL_LEDGER_NATION) + "SELECT * FROM ledger")
def stream_dedupe(spark, sf):
    """Every row landed twice, each id kept once by state."""
    src = _stream(spark, _landing(spark, sf, twice=True))
    with so.rocksdb_state(spark):
        out = sm.write_stream(sm.dedupe_in_state(src), scratch_path(spark, "stream_dedupe"), scratch_path(spark, "ckpt_dedupe"))
    return spark.read.parquet(out)


@register("stream_ledger_files", o.with_(o.SQL_LEDGER_NATION) + f"""
SELECT transaction_id, gl_account_id, transaction_date, amount, 'good' AS status FROM ledger
WHERE CAST(transaction_id AS BIGINT) % 97 <> 0 AND CAST(transaction_id AS BIGINT) % 89 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, 'bad' FROM ledger WHERE CAST(transaction_id AS BIGINT) % 97 = 0 OR CAST(transaction_id AS BIGINT) % 89 = 0""")
def stream_ledger_files(spark, sf):
    """CSV files of four layouts and with broken lines, streamed: the ledger
    of good rows, and one row for each bad line that was stored."""
    folder, base = scratch_path(spark, "csv_landing"), scratch_path(spark, "csv_stream")
    land_mixed(spark, sf, folder)
    sm.stream_ledger_files(spark, folder, base, scratch_path(spark, "ckpt_csv"), pattern="part-*", files_per_batch=20)
    good = spark.read.parquet(f"{base}/ledger").select("transaction_id", "gl_account_id", "transaction_date", "amount", F.lit("good").alias("status"))
    bad = st.stored_rows(spark, f"{base}/ingest/ledger", "bad").select(
        *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns[:-1]], F.lit("bad").alias("status"))
    return good.unionByName(bad)


@register("stream_call_rates", o.with_(o.CALL_LOG) + """,
w AS (SELECT agent, to_timestamp(((epoch_us(ts) // 10000000) * 10 - k * 10)::DOUBLE) AS ws
      FROM call_log, range(0, 6) r(k))
SELECT agent, CAST(ws AS TIMESTAMP) AS window_start, CAST(ws + INTERVAL 60 SECOND AS TIMESTAMP) AS window_end,
       count(*) AS calls
FROM w GROUP BY agent, ws""")
def stream_call_rates(spark, sf):
    calls = ad.call_log_from_events(spark, sf).select("ts", "agent")
    path = scratch_path(spark, "calls_landing")
    calls.repartition(3, F.col("ts")).write.parquet(path)       # each file has calls of all times
    win = sm.call_rate_windows(_stream(spark, path))
    out = sm.upsert_log(win, scratch_path(spark, "stream_rates"), scratch_path(spark, "ckpt_rates"), keys=["agent", "window_start"])
    return sm.latest_rows(spark, out, ["agent", "window_start"])


@register("stream_ledger", o.DETECT_NATION + o.detect_select(o.GLOBAL_FLAG))
def stream_ledger(spark, sf):
    """Ledger files streamed through append -> refresh -> detect, out of date order."""
    src = _stream(spark, _landing(spark, sf))
    base = scratch_path(spark, "stream_ledger")
    flags_path = sm.stream_ledger(spark, src, ad.accounts_from_nations(spark, sf), base,
                                  scratch_path(spark, "ckpt_ledger"))
    cols = ["gl_account_id", "account_name", "month", "current_month", "previous_month", "current_balance",
            "previous_balance", "variance_percent", "variance_amount", "transaction_count", "rolling_3mo_avg",
            "rolling_6mo_std", "z_score", "is_statistical_outlier", "typical_range", "severity", "direction",
            "past_anomaly_count"]
    return sm.current_flags(spark, flags_path).select(*cols)


def _limiter_sql():
    from .q_costs import limiter_sql
    return "WITH RECURSIVE" + limiter_sql(2, 4)[len("WITH"):]


@register("stream_admit_calls_by_week", _limiter_sql())
def stream_admit_calls_by_week(spark, sf):
    """The limiter replay as a stateful stream over the call log, landed in
    several files a week and run week by week; same result as the batch
    replay and its recursive SQL twin."""
    calls = ad.call_log_from_events(spark, sf).select("ts", "agent").withColumn(
        "week", F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd"))
    path = scratch_path(spark, "calls_by_week")
    calls.repartition(4, "ts").write.partitionBy("week").parquet(path)
    # bounded by the calendar
    weeks = sorted(r["w"] for r in spark.read.parquet(path).select(F.col("week").cast("string").alias("w")).distinct().collect())
    out = sm.stream_periods(spark, path, weeks, "week", lambda src: sm.admit_calls_stream(src, per_minute=2, per_hour=4),
                            scratch_path(spark, "stream_admit"), scratch_path(spark, "ckpt_admit"))
    return spark.read.parquet(out).select(F.col("key").alias("agent"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                                          "admitted")


def _shuffled_calls(spark, sf, batches: int = 3) -> str:
    """The call log landed as folders, each with calls of all times, and a
    last one whose only call, of no agent, lets event time pass all others."""
    calls = ad.call_log_from_events(spark, sf).select("ts", "agent").withColumn("n", F.pmod(F.xxhash64("ts", "agent"), F.lit(batches)))
    path = scratch_path(spark, "calls_shuffled")
    calls.write.partitionBy("n").parquet(path)
    calls.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(
        "ts", F.lit(None).cast("string").alias("agent"), F.lit(batches).alias("n")).write.mode("append").partitionBy("n").parquet(path)
    return path


def _run_in_order(spark, path, build, name, batches: int = 3):
    """One run of the stream after each folder has landed."""
    schema = spark.read.parquet(path).drop("n").schema
    inbox, out, checkpoint = (scratch_path(spark, f"{name}_{x}") for x in ("inbox", "out", "ckpt"))
    with so.rocksdb_state(spark):
        for k in range(batches + 1):
            spark.read.schema(schema).parquet(f"{path}/n={k}").write.parquet(f"{inbox}/n={k}")
            sm.write_stream(build(spark.readStream.schema(schema).parquet(f"{inbox}/n=*")), out, checkpoint)
    return spark.read.parquet(out).where(F.col("key").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("key", "agent")


@register("stream_admit_calls", _limiter_sql())
def stream_admit_calls(spark, sf):
    """The limiter over calls that arrive in any order, held in state until
    event time has passed them; same result as the batch replay."""
    return _run_in_order(spark, _shuffled_calls(spark, sf), lambda src: so.admit_calls_in_order(
        src, per_minute=2, per_hour=4, lateness="399 days"), "admit")


@register("stream_call_rate_stats", o.with_(o.CALL_LOG) + """
SELECT agent, ts, count(*) OVER (PARTITION BY agent ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS calls_last_minute,
       count(*) OVER (PARTITION BY agent ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS calls_last_hour
FROM call_log""")
def stream_call_rate_stats(spark, sf):
    """The exact trailing counts at each call, from the same stream."""
    return _run_in_order(spark, _shuffled_calls(spark, sf), lambda src: so.call_rates_in_order(src, lateness="399 days"), "rates")
