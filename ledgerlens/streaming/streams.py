"""Structured Streaming versions of the monthly load.

The exact forms give the same tables however the input is cut into
micro-batches, also with files out of date order; no row is dropped as late:

* ``stream_ledger``: each micro-batch runs dedupe -> append -> balance changes
  -> detection in ``foreachBatch`` (the variance needs the global month list,
  so it is computed on the stored balances, not in streaming state).
* ``stream_ledger_files``: CSV files by their own headers, good and bad rows
  stored apart.
* ``monthly_balances_stream``: the roll-up as a stateful aggregate; its state
  is the balance table itself (accounts x months), so nothing needs to expire.
* ``dedupe_in_state``: each id once, by state; ``dedupe_stream``:
  insert-or-ignore against a stored ledger that other jobs write as well.
* ``call_rate_windows``: sliding one-minute call counts; the exact counts and
  the limiter in event-time order are in ``ordered``.

``*_within_lateness`` forms bound their state with a watermark and therefore
ignore rows that are later than that.

All sinks are files with a checkpoint folder under the shared checkpoint
directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import balances as bal
from ..operators import detect as det
from ..plans import store as st
from ..schemas import MONEY_SUM, ROLLING_AVG_MONTHS, ROLLING_STD_MONTHS
from ..sources import files as fs
from .ordered import rocksdb_state


def run_available(query_writer, checkpoint: str):
    """Start a writer with an available-now trigger and wait for it."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def monthly_balances_stream(ledger_stream: DataFrame) -> DataFrame:
    """Streaming roll-up per account and month, exact for rows in any order:
    no watermark, the state has one row per account-month."""
    s = ledger_stream.withColumn("month_ts", F.date_trunc("month", F.col("transaction_date").cast("timestamp")))
    return (s.groupBy("gl_account_id", "month_ts")
            .agg(F.sum("amount").cast(MONEY_SUM).alias("net_balance"),
                 F.count(F.lit(1)).alias("transaction_count")))


def dedupe_stream(spark: SparkSession, ledger_stream: DataFrame, path: str, checkpoint: str,
                  id_scope: str = "global") -> str:
    """Each transaction id once, whenever its repeats arrive: every
    micro-batch inserts the ids that the ledger at ``path`` does not hold.  A
    batch replayed after a failure finds its rows stored and adds nothing."""
    def each(batch: DataFrame, epoch: int) -> None:
        st.append_ledger(spark, batch, path, id_scope=id_scope)
    run_available(ledger_stream.writeStream.foreachBatch(each), checkpoint)
    return path


def dedupe_in_state(ledger_stream: DataFrame) -> DataFrame:
    """Each transaction id once, whenever its repeats arrive: the ids seen are
    streaming state without a watermark, so none is forgotten.  A micro-batch
    looks up its own ids only; the stored ledger is not read.  Of repeats
    within one micro-batch any one stays.  Rows without an id, account, date
    or amount are left out.  Start it within ``ordered.rocksdb_state``, where
    state lies on disk and a batch checkpoints only what it adds."""
    whole = ledger_stream.where(F.col("transaction_id").isNotNull() & F.col("gl_account_id").isNotNull()
                                & F.col("transaction_date").isNotNull() & F.col("amount").isNotNull())
    return whole.dropDuplicates(["transaction_id"])


def dedupe_within_lateness(ledger_stream: DataFrame, lateness: str = "400 days") -> DataFrame:
    """Drop repeated transaction ids that arrive within ``lateness`` of each
    other.  State is bounded; rows later than that are ignored, so this is
    not a substitute for ``dedupe_stream``."""
    s = ledger_stream.withColumn("event_ts", F.col("transaction_date").cast("timestamp"))
    return s.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["transaction_id"]).drop("event_ts")


def call_rate_windows(calls: DataFrame, key: str = "agent", size: str = "60 seconds",
                      slide: str = "10 seconds", lateness: str | None = None) -> DataFrame:
    """Calls per key in sliding windows (approximate form of the per-call
    trailing count; the exact one is ``operators.costs.call_rate_stats``).
    With ``lateness``, windows older than that are closed: their state is
    dropped and later calls in them are ignored."""
    c = calls.withColumn("event_ts", F.col("ts").cast("timestamp"))
    if lateness is not None:
        c = c.withWatermark("event_ts", lateness)
    return (c.groupBy(key, F.window("event_ts", size, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "calls"))


def _months_to_redo(balances: DataFrame, months: list[str], reach: int) -> list[str]:
    """Months in which some flag can change when balances of ``months`` did:
    those months, the month observed right after each, and every month whose
    row has one of them among its account's ``reach`` rows before it (rolling
    average and deviation)."""
    dates = [F.to_date(F.lit(f"{m}-01")) for m in months]
    om = bal.observed_months(balances)
    near = om.where(F.col("month").isin(*dates) | F.col("prev_observed_month").isin(*dates)).select("month")
    w = Window.partitionBy("gl_account_id").orderBy("month").rowsBetween(-reach, 0)
    touched = F.max(F.col("month").isin(*dates).cast("int")).over(w) == 1
    rolling = balances.select("month", touched.alias("touched")).where("touched").select("month")
    # bounded by the calendar
    return sorted(r["m"] for r in near.unionByName(rolling).distinct().select(
        F.date_format("month", "yyyy-MM").alias("m")).collect())


def stream_ledger(spark: SparkSession, ledger_stream: DataFrame, accounts: DataFrame, base: str, checkpoint: str,
                  fold_every: int = 20) -> str:
    """Micro-batch pipeline: dedupe -> append -> balance changes -> detect.

    Ids are deduplicated in state, each batch's rows are stored under its
    number, and what they change in the balances is added to a table of
    changes (folded every ``fold_every`` batches), so neither the ids nor the
    rows of earlier batches are read again.  The flags of all months that the
    batch can change are made anew from the balances and replace the earlier
    ones as a whole, so a flag that no longer holds is gone, also where a
    month has none left.

    Flags are kept by batch: ``flags`` holds each batch's flags, ``months``
    which months a batch made; :func:`current_flags` reads the latest of each
    month.  A replayed batch overwrites its own rows everywhere."""
    ledger_path, bal_path, flags_path = f"{base}/ledger", f"{base}/balance_changes", f"{base}/flags"

    def each(batch: DataFrame, epoch: int) -> None:
        st.append_batch(spark, batch, ledger_path, epoch)
        if not st.table_exists(spark, ledger_path):
            return                                      # nothing has come yet
        months = st.store_deltas(spark, ledger_path, bal_path, epoch)
        if epoch and epoch % fold_every == 0:
            st.fold_deltas(spark, bal_path, epoch - 1)
        if not months:
            return
        balances = st.balances_from_deltas(spark, bal_path)
        redo = _months_to_redo(balances, months, max(ROLLING_AVG_MONTHS, ROLLING_STD_MONTHS))
        flags = det.detect_anomalies(bal.enrich_balances(balances), accounts).where(F.col("current_month").isin(redo))
        made = spark.createDataFrame([(m,) for m in redo], "current_month string")
        for df, path in ((flags, f"{flags_path}/flags"), (made, f"{flags_path}/months")):
            st.write_by(df.withColumn("batch", F.lit(epoch)), "batch", path, mode="overwrite", dynamic=True)

    with rocksdb_state(spark):
        run_available(dedupe_in_state(ledger_stream).writeStream.foreachBatch(each), checkpoint)
    return flags_path


def stream_ledger_files(spark: SparkSession, folder: str, base: str, checkpoint: str, pattern: str = "*.csv", files_per_batch: int = 100) -> str:
    """Ledger CSV files as they land in ``folder`` (at any depth): every
    micro-batch reads its files by their own headers, validates them, and in
    one write stores good and bad rows apart under ``base``/ingest/ledger,
    with counts, under the batch's number.  The good rows that the ledger at
    ``base``/ledger does not hold are appended to it.

    The stream itself lists files only; their contents are read once, by the
    batch.  A replayed batch overwrites what it stored and appends nothing."""
    listed = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
              .option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path"))
    ingest = f"{base}/ingest/ledger"

    def each(batch: DataFrame, epoch: int) -> None:
        files = sorted(r.path for r in batch.collect())              # files_per_batch at most
        if not files:
            return
        raw = fs.scan_ledger(spark, [fs.listed_file(f) for f in files], base=folder)
        st.store_classified(raw, ingest, f"batch-{epoch}")
        st.append_ledger(spark, st.stored_rows(spark, ingest, "good", f"batch-{epoch}"), f"{base}/ledger")
    run_available(listed.writeStream.foreachBatch(each), checkpoint)
    return base


def current_flags(spark: SparkSession, flags_path: str) -> DataFrame:
    """The flags of ``stream_ledger`` that hold now: of each month those of
    the last batch that made it (the month table is calendar-bounded)."""
    last = spark.read.parquet(f"{flags_path}/months").groupBy("current_month").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{flags_path}/flags").join(F.broadcast(last), ["current_month", "batch"]).drop("batch")


def upsert_log(df: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, fold_every: int = 20) -> str:
    """Update-mode sink: every micro-batch's changed rows are stored under
    its number; ``latest_rows`` reads the current state back.  A batch replayed
    after a failure replaces its own rows.

    With ``keys`` the log is folded every ``fold_every`` batches: the latest
    row of each key becomes a snapshot, and reads take the last snapshot and
    the batches behind it, so they do not grow with the number of batches."""
    def each(batch: DataFrame, epoch: int) -> None:
        st.write_by(batch.withColumn("_batch", F.lit(epoch)), "_batch", f"{path}/log", mode="overwrite", dynamic=True)
        if keys and epoch and epoch % fold_every == 0:
            whole = latest_rows(batch.sparkSession, path, keys)
            st.write_by(whole.withColumn("_batch", F.lit(epoch)), "_batch", f"{path}/snapshots", mode="overwrite", dynamic=True)
    run_available(df.writeStream.outputMode("update").foreachBatch(each), checkpoint)
    return path


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot of an upsert log, and the batches behind it."""
    log = spark.read.parquet(f"{path}/log")
    if not st.table_exists(spark, f"{path}/snapshots"):
        return log
    snapshots = spark.read.parquet(f"{path}/snapshots")
    last = snapshots.agg(F.max("_batch")).first()[0]
    return snapshots.where(F.col("_batch") == last).unionByName(log.where(F.col("_batch") > last))


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest version of every key in an upsert log (aggregate, skew-safe)."""
    log = _versions(spark, path)
    rest = [c for c in log.columns if c not in keys and c != "_batch"]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> str:
    run_available(df.writeStream.format("parquet").outputMode(mode).option("path", path), checkpoint)
    return path


def stream_from_table(spark: SparkSession, path: str) -> DataFrame:
    """A file-source stream over a parquet folder (schema from the files)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def admit_calls_stream(calls: DataFrame, key: str = "agent", ts: str = "ts",
                       per_minute: int = 60, per_hour: int = 1000, timeout: str = "NoTimeout") -> DataFrame:
    """The rate-limiter replay as a stateful stream.

    Whether a call is admitted depends on the calls before it, so calls must
    arrive in time order across micro-batches (within one they may be in any
    order): land one period per batch, in order, as
    ``stream_periods`` does.  A call older than one that was already
    decided can't be decided rightly any more, so it raises instead.

    State per key is the admitted call times of the last hour (at most
    ``per_hour`` values) and the last time seen, so it stays bounded however
    long the stream runs.
    """
    import bisect

    import numpy as np
    import pandas as pd

    minute_us, hour_us = 60_000_000, 3_600_000_000
    src = calls.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def replay(k, batches, state):
        admitted, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        times = np.sort(np.concatenate([pdf["us"].to_numpy() for pdf in batches]))      # 8 bytes a call
        if seen is not None and len(times) and times[0] < seen:
            raise ValueError(f"calls of {k[0]!r} arrived out of order: land periods in order")
        ok = np.zeros(len(times), bool)
        first = 0                     # admitted[first:] are those of the last hour
        for i, t in enumerate(times.tolist()):
            while first < len(admitted) and admitted[first] < t - hour_us:
                first += 1
            last_min = len(admitted) - bisect.bisect_left(admitted, t - minute_us, first)
            if last_min < per_minute and len(admitted) - first < per_hour:
                admitted.append(t)
                ok[i] = True
        if len(times):
            state.update((admitted[first:], int(times[-1])))
        for lo in range(0, len(times), 100_000):
            part = times[lo:lo + 100_000]
            yield pd.DataFrame({"key": [k[0]] * len(part), "ts": pd.to_datetime(part, unit="us"),
                                "admitted": ok[lo:lo + 100_000]})

    return src.groupBy("key").applyInPandasWithState(
        replay, "key string, ts timestamp, admitted boolean", "admitted array<long>, seen long", "append", timeout)


def stream_periods(spark: SparkSession, landing: str, periods: list[str], column: str, build, path: str,
                   checkpoint: str) -> str:
    """Run a stream over period folders (``column=value``) strictly one
    period after the other: the source sees a growing folder of periods and
    each run takes what is new, whatever the files' times and number.  One
    checkpoint carries the state from period to period."""
    schema = spark.read.parquet(landing).drop(column).schema
    inbox = f"{checkpoint}-inbox"
    for k, period in enumerate(periods):
        spark.read.schema(schema).parquet(f"{landing}/{column}={period}").write.mode("overwrite").parquet(f"{inbox}/n={k}")
        source = spark.readStream.schema(schema).parquet(f"{inbox}/n=*")
        write_stream(build(source), path, checkpoint)
    return path
