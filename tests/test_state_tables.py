"""Streams with state, balance changes by batch, stored feedback, limiter nulls."""

import datetime as dt
import random
import types
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from conftest import accounts_rows, ledger_rows
from ledgerlens.operators import balances as bal
from ledgerlens.operators import costs as co
from ledgerlens.plans import store as st
from ledgerlens.session import scratch_path
from ledgerlens.streaming import ordered as so
from ledgerlens.streaming import streams as sm


def test_dedupe_in_state_survives_restarts(spark):
    land, out, ck = (scratch_path(spark, f"t_dedupe_{x}") for x in ("land", "out", "ck"))
    seen = Counter()
    for part in (["1", "2", "1"], ["2", "3"], ["3", "1", "4"]):
        ledger_rows(spark, [(i, "A", "2025-01-10", 5) for i in part]).write.mode("append").parquet(land)
        with so.rocksdb_state(spark):
            sm.write_stream(sm.dedupe_in_state(sm.stream_from_table(spark, land)), out, ck)     # a new query each time
        seen = Counter(r.transaction_id for r in spark.read.parquet(out).collect())
    assert seen == Counter(["1", "2", "3", "4"])
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")      # the session keeps its own


def test_replayed_batches_change_nothing(spark):
    ledger, changes = scratch_path(spark, "t_ledger_b"), scratch_path(spark, "t_changes")
    one = ledger_rows(spark, [("1", "A", "2025-01-10", 100), ("2", "A", "2025-02-10", 50), ("3", "B", "2025-01-11", 7)])
    two = ledger_rows(spark, [("4", "A", "2025-01-20", -30)])
    for batch, rows in ((0, one), (1, two), (1, two), (0, one)):
        st.append_batch(spark, rows, ledger, batch)
        st.store_deltas(spark, ledger, changes, batch)

    def balances():
        return {(r.gl_account_id, r.month.month): (str(r.net_balance), r.transaction_count) for r in st.balances_from_deltas(spark, changes).collect()}
    want = {(r.gl_account_id, r.month.month): (str(r.net_balance), r.transaction_count)
            for r in bal.monthly_balances(one.unionByName(two)).collect()}
    assert balances() == want and spark.read.parquet(ledger).count() == 4
    st.fold_deltas(spark, changes, upto=1)
    assert balances() == want
    st.reverse_deltas(spark, ledger_rows(spark, [("3", "B", "2025-01-11", 7)]), changes, batch=2)
    del want[("B", 1)]
    assert balances() == want
    st.fold_deltas(spark, changes, upto=2)
    assert balances() == want


def test_affected_refresh_reads_only_the_batch(spark):
    ledger, changes = scratch_path(spark, "t_ledger_p"), scratch_path(spark, "t_changes_p")
    for batch in range(3):
        st.append_batch(spark, ledger_rows(spark, [(str(batch), "A", "2025-01-10", 1)]), ledger, batch)
        assert st.store_deltas(spark, ledger, changes, batch) == ["2025-01"]
    plan = spark.read.parquet(ledger).where("batch = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def _calls(seed, n=400):
    r = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    return [(r.choice(["a", "b", None]), start + dt.timedelta(seconds=r.randrange(4 * 3600), microseconds=r.randrange(3) * 500_000)) for _ in range(n)]


def test_calls_in_any_order(spark):
    """Files shuffled over batches give what the batch forms give."""
    rows = _calls(4)
    calls = spark.createDataFrame(rows, "agent string, ts timestamp_ntz")
    inbox = scratch_path(spark, "t_calls")
    out = {k: (scratch_path(spark, f"t_{k}"), scratch_path(spark, f"t_{k}_ck")) for k in ("admit", "rates")}
    random.Random(9).shuffle(rows)
    parts = [rows[k::3] for k in range(3)] + [[("clock", dt.datetime(2026, 1, 1))]]
    with so.rocksdb_state(spark):
        for part in parts:
            spark.createDataFrame(part, "agent string, ts timestamp_ntz").write.mode("append").parquet(inbox)
            src = sm.stream_from_table(spark, inbox)
            sm.write_stream(so.admit_calls_in_order(src, per_minute=2, per_hour=25, lateness="100 days"), *out["admit"])
            sm.write_stream(so.call_rates_in_order(src, lateness="100 days"), *out["rates"])

    def rows_of(df, *cols):
        return Counter(tuple(r) for r in df.where("agent IS NULL OR agent <> 'clock'").select("agent", F.col("ts").cast("timestamp_ntz"), *cols).collect())
    got = rows_of(spark.read.parquet(out["admit"][0]).withColumnRenamed("key", "agent"), "admitted")
    want = rows_of(co.admit_calls(calls, key="agent", per_minute=2, per_hour=25), "admitted")
    assert got == want and len({k[-1] for k in got}) == 2
    cols = ("calls_last_minute", "calls_last_hour")
    assert rows_of(spark.read.parquet(out["rates"][0]).withColumnRenamed("key", "agent"), *cols) == rows_of(co.call_rate_stats(calls, key="agent"), *cols)


class _Asked:
    """State of one key in a dict, and timers; counts what is asked of them."""

    def __init__(self):
        self.kept, self.timers, self.asked = {}, set(), 0

    def _part(self, name):
        def call(f):
            def run(*a):
                self.asked += 1
                return f(*a)
            return run
        kept = self.kept
        return types.SimpleNamespace(
            exists=call(lambda: name in kept), get=call(lambda: kept[name]), update=call(lambda v: kept.__setitem__(name, v)),
            containsKey=call(lambda k: (name, k) in kept), getValue=call(lambda k: kept[name, k]),
            updateValue=call(lambda k, v: kept.__setitem__((name, k), v)), removeKey=call(lambda k: kept.pop((name, k))))

    def getMapState(self, name, *_):
        return self._part(name)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.asked += 1
        self.timers.add(ms)

    def run_timers(self, processor, watermark):
        out = []
        while due := sorted(t for t in self.timers if t <= watermark):
            for ms in due:
                self.timers.discard(ms)
                out += processor.handleExpiredTimer(("a",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark),
                                                    types.SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
        return pd.concat(out) if out else pd.DataFrame({"ts": []})


def test_state_is_asked_by_the_hour():
    """Calls of ten hours, one a second, shuffled into three batches: each call is given out once, in order and with
    its minute passed, and the state is asked a few times an hour (before: several times a minute)."""
    us = [k * 1_000_000 + 500_000 for k in range(10 * 3600)]
    random.Random(3).shuffle(us)
    handle, processor = _Asked(), so._Rates()
    processor.init(handle)
    for k in range(3):
        assert list(processor.handleInputRows(("a",), iter([pd.DataFrame({"us": us[k::3]})]), None)) == []
    first = handle.run_timers(processor, 90_000_000 // 1000 + 4 * 3_600_000)            # 4 h, 1 min and 30 s
    assert len(first) == 4 * 3600 + 60 and first["ts"].is_monotonic_increasing
    assert len(handle.run_timers(processor, 90_000_000 // 1000 + 4 * 3_600_000 + 20_000)) == 0
    rest = handle.run_timers(processor, 11 * 3_600_000)
    every = pd.concat([first, rest])
    assert every["ts"].is_monotonic_increasing and len(every) == len(us)
    assert every["calls_last_minute"].tolist() == [min(k + 1, 61) for k in range(len(us))]
    assert every["calls_last_hour"].tolist() == [min(k + 1, 3601) for k in range(len(us))]
    assert not handle.timers and handle.asked < 120


def test_landed_files_make_a_fixed_number_of_batches(spark):
    from ledgerlens.plans.q_streams import _stream
    path = scratch_path(spark, "t_landed")
    spark.range(200).withColumn("land", F.col("id") % 2).repartition(20).write.partitionBy("land").parquet(path)
    assert len(spark.read.parquet(path).inputFiles()) == 40
    seen = []
    sm.run_available(_stream(spark, path, batches=3).writeStream.foreachBatch(lambda b, n: seen.append(b.count())), scratch_path(spark, "t_landed_ck"))
    assert len(seen) == 3 and sum(seen) == 200


def test_limiter_with_null_keys_and_times(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s)) for k in (1, None) for s in range(20)] + [(1, None), (None, None)]
    got = co.admit_calls(spark.createDataFrame(rows, "caller_id long, ts timestamp_ntz"), per_minute=3).collect()
    assert len(got) == len(rows)
    assert Counter(r.caller_id for r in got if r.admitted) == {1: 3, None: 3}
    assert not any(r.admitted for r in got if r.ts is None)


def _feedback(spark, base):
    inv = spark.createDataFrame([("i1", "A", -40.0, "r"), ("i2", "A", 60.0, "r"), ("i3", "B", 20.0, "r")],
                                "anomaly_id string, gl_account_id string, variance_percent double, run_id string")
    for c, t in (("is_true_anomaly", "boolean"), ("investigation_notes", "string"), ("resolved_by", "string"), ("resolved_at", "timestamp_ntz")):
        inv = inv.withColumn(c, F.lit(None).cast(t))
    st.store_investigations(spark, inv, f"{base}/investigations")


def test_feedback_is_stored_and_outlives_a_reload(spark):
    base = scratch_path(spark, "t_feedback")
    schema = ("anomaly_id string, is_true_anomaly boolean, correct_explanation string, adjust_threshold boolean, "
              "resolution_notes string, resolved_by string, feedback_ts timestamp_ntz")
    _feedback(spark, base)
    master = accounts_rows(spark, ["A", "B"])
    st.store_accounts(master, f"{base}/accounts", seq=1)
    assert {r.account_id: r.variance_threshold_pct for r in st.adjusted_accounts(spark, base).collect()} == {"A": 15.0, "B": 15.0}
    assert st.judged_investigations(spark, base).where("is_true_anomaly IS NOT NULL").count() == 0
    first = spark.createDataFrame([("i1", False, None, True, "n1", "amy", dt.datetime(2025, 3, 1))], schema)
    later = spark.createDataFrame([("i2", False, "why", True, "n2", "bo", dt.datetime(2025, 3, 2)), ("i3", True, None, True, "n3", "bo", dt.datetime(2025, 3, 2)),
                                   ("gone", False, None, True, "n4", "bo", dt.datetime(2025, 3, 2))], schema)
    for fb in (first, later, first):                 # an earlier verdict stored again does not win
        st.store_feedback(spark, fb, base)

    def thresholds(**kw):
        return {r.account_id: round(r.variance_threshold_pct, 6) for r in st.adjusted_accounts(spark, base, **kw).collect()}
    assert thresholds() == {"A": 66.0, "B": 15.0}
    judged = {r.anomaly_id: (r.is_true_anomaly, r.investigation_notes) for r in st.judged_investigations(spark, base).collect()}
    assert judged == {"i1": (False, "n1"), "i2": (False, "why"), "i3": (True, "n3")}
    reload_at = int(dt.datetime(2025, 4, 1, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    st.store_accounts(master, f"{base}/accounts", seq=reload_at)
    assert thresholds() == {"A": 66.0, "B": 15.0}
    assert thresholds(survive_reload=False) == {"A": 15.0, "B": 15.0}


def test_csv_stream_keeps_bad_rows(spark, tmp_path):
    land, base, ck = tmp_path / "land", str(tmp_path / "base"), str(tmp_path / "ck")
    land.mkdir()
    (land / "pl_1.csv").write_text("transaction_id,gl_account_id,date,amount,description\n1,A,2025-01-01,5,x\n2,A,2025-01-02,zz,x\n3,A,2025-01-03\n")
    sm.stream_ledger_files(spark, str(land), base, ck)
    (land / "pl_2.csv").write_text("amount,date,transaction_id,gl_account_id,description\n7,2025-02-01,4,B,y\n8,2025-02-01,1,B,again\n")
    sm.stream_ledger_files(spark, str(land), base, ck)
    sm.stream_ledger_files(spark, str(land), base, ck)          # nothing new
    assert {r.transaction_id: str(r.amount) for r in spark.read.parquet(f"{base}/ledger").collect()} == {"1": "5.00", "4": "7.00"}
    bad = {r.transaction_id: r.broken_rules for r in st.stored_rows(spark, f"{base}/ingest/ledger", "bad").collect()}
    assert bad == {"2": ["non_numeric_amount"], "3": ["malformed_line", "null_amount"]}


def test_upsert_log_is_folded(spark):
    land, out, ck = (scratch_path(spark, f"t_fold_{x}") for x in ("land", "out", "ck"))
    rows = []
    for k in range(5):
        part = [(f"{k}-{j}", "AB"[j % 2], f"2025-0{1 + (j + k) % 3}-10", 10 * k + j) for j in range(6)]
        rows += part
        ledger_rows(spark, part).write.mode("append").parquet(land)
        sm.upsert_log(sm.monthly_balances_stream(sm.stream_from_table(spark, land)), out, ck, keys=["gl_account_id", "month_ts"], fold_every=2)
    got = {(r.gl_account_id, r.month_ts.date()): str(r.net_balance) for r in sm.latest_rows(spark, out, ["gl_account_id", "month_ts"]).collect()}
    assert got == {(r.gl_account_id, r.month): str(r.net_balance) for r in bal.monthly_balances(ledger_rows(spark, rows)).collect()}
    assert {r["_batch"] for r in spark.read.parquet(f"{out}/snapshots").select("_batch").distinct().collect()} == {2, 4}
    assert sm._versions(spark, out).where("_batch < 4").count() == 0        # earlier batches are not read any more
