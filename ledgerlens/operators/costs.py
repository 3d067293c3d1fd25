"""Model-call cost accounting and call-rate statistics over a call log."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefns import epoch_us
from ..schemas import RATE_PER_HOUR, RATE_PER_MINUTE

# ---------------------------------------------------------------------------
# Price per 1,000,000 tokens (input, output) by model, and the
# model whose price applies to a model not in the list.
# ---------------------------------------------------------------------------
PRICES_PER_MILLION = [
    ("gpt-4", "0.03", "0.06"),
    ("gpt-4-turbo", "0.01", "0.03"),
    ("gpt-4o", "0.005", "0.015"),
    ("gpt-4o-mini", "0.00015", "0.0006"),
    ("gpt-5", "1.25", "10.00"),
    ("text-embedding-3-small", "0.00002", "0.0"),
    ("text-embedding-3-large", "0.00013", "0.0"),
    ("text-embedding-ada-002", "0.0001", "0.0"),
]
DEFAULT_PRICE_MODEL = "gpt-4"

# Cost arithmetic is exact: tokens as decimal(16,0) times the per-token price
# as decimal(20,11) stays within Spark's 38 digits without losing scale.
TOKENS = T.DecimalType(16, 0)
PER_TOKEN = T.DecimalType(20, 11)
COST = T.DecimalType(38, 11)


def price_list(spark: SparkSession) -> DataFrame:
    """The price table, per token (price per million / 1e6), exact decimals."""
    rows = ", ".join(f"('{m}', CAST({i} AS DECIMAL(20,11)) / 1000000, CAST({o} AS DECIMAL(20,11)) / 1000000)"
                     for m, i, o in PRICES_PER_MILLION)
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input_price, output_price)")
    return df.select("model", F.col("input_price").cast(PER_TOKEN).alias("input_price"),
                     F.col("output_price").cast(PER_TOKEN).alias("output_price"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every call.  Unknown models take the default model's price.

    The price table is a fixed list of a few models, so broadcasting it is
    safe at any data size.
    """
    # The default model's price is a fixed value: a literal, not a join.
    d_in, d_out = next((i, o) for m, i, o in PRICES_PER_MILLION if m == DEFAULT_PRICE_MODEL)
    j = calls.join(F.broadcast(prices), "model", "left")
    in_price = F.coalesce(F.col("input_price"), (F.lit(d_in).cast(PER_TOKEN) / 1000000).cast(PER_TOKEN))
    out_price = F.coalesce(F.col("output_price"), (F.lit(d_out).cast(PER_TOKEN) / 1000000).cast(PER_TOKEN))
    # Exact decimals while computing; the result columns are doubles (the
    # exact value rounded once), which compare equal across engines.
    input_cost = F.col("input_tokens").cast(TOKENS) * in_price
    output_cost = F.col("output_tokens").cast(TOKENS) * out_price
    return (j.withColumn("cost_exact", (input_cost + output_cost).cast(COST))
            .withColumn("input_cost", input_cost.cast(COST).cast("double"))
            .withColumn("output_cost", output_cost.cast(COST).cast("double"))
            .withColumn("total_cost", F.col("cost_exact").cast("double"))
            .withColumn("query_preview", F.substring(F.coalesce(F.col("query_preview"), F.lit("")), 1, 100))
            .drop("input_price", "output_price"))


def cost_summary(priced: DataFrame) -> DataFrame:
    """Per run: calls, tokens, total cost, first and last call, duration."""
    return priced.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("cost_exact").cast(COST).cast("double").alias("total_cost"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        ((epoch_us(F.max("ts")) - epoch_us(F.min("ts"))) / F.lit(1e6)).alias("total_duration"),
    )


def cost_by_agent(priced: DataFrame) -> DataFrame:
    """Cost per (run, agent) and its share of the run's total (0 when the
    run cost nothing).  The run total is a window over the already
    aggregated (run, agent) rows, so it stays small."""
    per = priced.groupBy("run_id", "agent").agg(F.sum("cost_exact").cast(COST).alias("_exact"),
                                                F.count(F.lit(1)).alias("calls"))
    total = F.sum("_exact").over(Window.partitionBy("run_id"))
    share = F.when(total == 0, F.lit(0.0)).otherwise(
        F.col("_exact").cast("double") / total.cast("double"))
    return (per.withColumn("share", share)
            .withColumn("agent_cost", F.col("_exact").cast("double")).drop("_exact"))


def money8(c):
    """Cost as text with 8 decimals, rounded half-up on the exact decimal
    value first (so no engine's float formatting sees a tie)."""
    return F.format_string("%.8f", F.round(c.cast(COST), 8).cast("double"))


def cost_report(priced: DataFrame) -> DataFrame:
    """Per run: the summary plus the per-agent cost breakdown as a JSON
    list sorted by agent, costs as 8-decimal text.  The breakdown holds one
    entry per agent (a handful), so collecting it per run is bounded; the
    calls themselves stay a separate table (``price_calls``)."""
    per = priced.groupBy("run_id", "agent").agg(F.sum("cost_exact").cast(COST).alias("_c"))
    br = per.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("agent"), money8(F.col("_c")).alias("cost"))))).alias("cost_breakdown"))
    summ = cost_summary(priced).withColumn("total_cost", money8(F.col("total_cost")))
    return summ.join(br, "run_id", "inner")


def cost_per_anomaly(summary: DataFrame, anomaly_counts: DataFrame) -> DataFrame:
    """Run cost divided by its number of anomalies; 0 when there are none."""
    j = summary.join(anomaly_counts, "run_id", "left")
    n = F.coalesce(F.col("anomalies"), F.lit(0))
    return j.select("run_id", "total_cost", n.alias("anomalies"),
                    F.when(n == 0, F.lit(0.0)).otherwise(F.col("total_cost") / n)
                    .alias("cost_per_anomaly"))


def trailing_counts(df: DataFrame, key: str, ts: str, windows: dict[str, int],
                    bucket_seconds: int = 14400) -> DataFrame:
    """For every row, the number of rows of the same key in the trailing
    ``[ts - seconds, ts]`` range (ends inclusive), one column per window.

    Skew: a per-key range window would put a hot key into one task.  Rows
    are instead split into (key, time bucket) partitions; the rows of the
    last ``max(windows)`` seconds of each bucket are copied into the next
    bucket as ghosts, so each bucket sees its full trailing range, and the
    ghosts are dropped after counting.  The extra rows are at most
    ``max(windows) / bucket_seconds`` of the input.
    """
    widest = max(windows.values())
    if bucket_seconds < widest:
        raise ValueError("bucket_seconds must be at least the widest window")
    us = epoch_us(ts)
    b_us = bucket_seconds * 1_000_000
    base = df.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / F.lit(b_us)))
    late = F.col("_us") >= (F.col("_b") + 1) * F.lit(b_us) - F.lit(widest * 1_000_000)
    own = F.struct(F.col("_b").alias("bucket"), F.lit(False).alias("ghost"))
    nxt = F.struct((F.col("_b") + 1).alias("bucket"), F.lit(True).alias("ghost"))
    u = base.withColumn("_to", F.explode(F.when(late, F.array(own, nxt)).otherwise(F.array(own))))   # one pass
    u = u.withColumn("_bucket", F.col("_to.bucket")).withColumn("_ghost", F.col("_to.ghost")).drop("_to", "_b")
    w = Window.partitionBy(key, "_bucket").orderBy("_us")
    for name, seconds in windows.items():
        u = u.withColumn(name, F.count(F.lit(1)).over(w.rangeBetween(-seconds * 1_000_000, 0)))
    return u.filter(~F.col("_ghost")).drop("_us", "_bucket", "_ghost")


def call_rate_stats(calls: DataFrame, key: str = "caller_id", ts: str = "ts",
                    per_minute: int = RATE_PER_MINUTE, per_hour: int = RATE_PER_HOUR) -> DataFrame:
    """At each call: calls of the same key in the last minute / hour
    (a call exactly 60 s old still counts), the limits and what remains."""
    c = trailing_counts(calls, key, ts, {"calls_last_minute": 60, "calls_last_hour": 3600})
    return (c.withColumn("minute_limit", F.lit(per_minute))
            .withColumn("hour_limit", F.lit(per_hour))
            .withColumn("minute_remaining", F.lit(per_minute) - F.col("calls_last_minute"))
            .withColumn("hour_remaining", F.lit(per_hour) - F.col("calls_last_hour")))


def admit_calls(calls: DataFrame, key: str = "caller_id", ts: str = "ts", order_col: str | None = None,
                per_minute: int = RATE_PER_MINUTE, per_hour: int = RATE_PER_HOUR) -> DataFrame:
    """Replay a sliding-window rate limiter per key: a call is admitted when
    fewer than ``per_minute`` admitted calls lie in the last 60 s and fewer
    than ``per_hour`` in the last hour; rejected calls do not count.

    The decision depends on earlier decisions, so each key is a sequential
    scan.  Spark sorts each key's calls (external sort, spills) and the scan
    runs over the sorted stream batch by batch, keeping only the admitted
    calls of the last hour (at most ``per_hour``) as state.  After more than
    an hour without calls that state is empty, so a key's calls are cut at
    such gaps and the stretches go to different tasks; the gaps are found on
    one row per key and hour.  A stretch without a gap is streamed through one
    task, never collected.  Calls without a key are the calls of one key; a
    call without a time is not admitted and counts for none.
    """
    tie = order_col or ts
    cols = calls.columns
    src = calls.withColumn("_us", epoch_us(ts))
    minute_us, hour_us = 60_000_000, 3_600_000_000
    src = src.withColumn("_hour", F.floor(F.col("_us") / F.lit(hour_us)))
    hours = src.groupBy(key, "_hour").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    w = Window.partitionBy(key).orderBy("_hour")
    gap = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > hour_us, F.lit(False)).cast("int")
    cut = hours.withColumn("_gap", gap).withColumn("_stretch", F.sum("_gap").over(w)).select(
        F.col(key).alias("_k"), F.col("_hour").alias("_h"), "_stretch")
    src = src.join(cut, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_hour") == F.col("_h")), "left").drop("_k", "_h", "_hour")
    sorted_ = src.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_us", tie)
    out_schema = T.StructType(src.schema.fields + [T.StructField("admitted", T.BooleanType())])

    def run(batches):
        current, mins, hours = None, deque(), deque()
        for pdf in batches:
            # a null key or stretch is told from every other, and equal to itself
            places = zip(pdf[key], pdf[key].isna(), pdf["_stretch"], pdf["_stretch"].isna(), strict=True)
            out = []
            for (k, no_key, stretch, no_stretch), t, no_time in zip(places, pdf["_us"].to_numpy(), pdf["_us"].isna(), strict=True):
                if no_time:
                    out.append(False)
                    continue
                t = int(t)
                place = (None if no_key else k, no_key, None if no_stretch else stretch)
                if place != current:
                    current, mins, hours = place, deque(), deque()
                while mins and mins[0] < t - minute_us:
                    mins.popleft()
                while hours and hours[0] < t - hour_us:
                    hours.popleft()
                ok = len(mins) < per_minute and len(hours) < per_hour
                if ok:
                    mins.append(t)
                    hours.append(t)
                out.append(ok)
            yield pdf.assign(admitted=pd.Series(out, index=pdf.index, dtype=bool))

    return sorted_.mapInPandas(run, out_schema).select(*cols, "admitted")
