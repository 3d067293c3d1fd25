"""Results that must not depend on faults, batch cuts, odd text or hot keys."""

import datetime as dt
import os
import random
import types

import pytest
from conftest import accounts_rows, ledger_rows
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.operators import balances as bal
from ledgerlens.operators import costs as co
from ledgerlens.operators import detect as det
from ledgerlens.operators import docs as dc
from ledgerlens.operators import reuse as ru
from ledgerlens.operators import validate as va
from ledgerlens.plans import store as st
from ledgerlens.session import scratch_path
from ledgerlens.sources import files as fs
from ledgerlens.streaming import streams as sm


def months_ledger(n_months=14, accounts=5, seed=3):
    r = random.Random(seed)
    rows, i = [], 0
    for m in range(n_months):
        for a in range(accounts):
            for _ in range(r.randint(1, 3)):
                day = f"{2024 + m // 12}-{m % 12 + 1:02d}-{r.randint(1, 28):02d}"
                rows.append((str(i), f"A{a}", day, r.choice([100, 110, 95, 400, 12])))
                i += 1
    return rows


# --- stored tables -------------------------------------------------------------------------

def test_an_unreadable_file_is_never_an_empty_table(spark, tmp_path):
    rows = months_ledger(4)
    path, led_path = f"{tmp_path}/balances", f"{tmp_path}/ledger"
    led = ledger_rows(spark, rows)
    st.refresh_balances(spark, led, path)
    st.append_ledger(spark, led, led_path)

    def break_one(folder):
        files = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
        with open(files[0], "rb+") as f:
            f.truncate(8)
        return {f: os.path.getsize(f) for f in files}
    for folder, again in ((path, lambda: st.refresh_balances(spark, led, path, target_month="2024-02")),
                          (led_path, lambda: st.append_ledger(spark, led, led_path))):
        before = break_one(folder)
        with pytest.raises(Exception):  # noqa: B017
            again()
        after = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
        assert set(before) <= after
    assert not st.table_exists(spark, path + "-none")


def test_writes_by_month_make_few_files(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    st.append_ledger(spark, ledger_rows(spark, months_ledger(6)).repartition(16), path)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * 6


# --- streams -------------------------------------------------------------------------------

def land(spark, parts):
    path = scratch_path(spark, "t_parts")
    for rows in parts:
        ledger_rows(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("files", [1, 3, 6])
def test_streams_do_not_depend_on_batches(spark, files):
    rows = months_ledger()
    # a correction that removes a flag, and one that changes later rolling values
    rows += [("x1", "A0", "2024-03-15", 5000), ("x2", "A0", "2024-03-16", -4990), ("x3", "A1", "2024-02-10", 700)]
    r = random.Random(files)
    shuffled = rows[:-3]
    r.shuffle(shuffled)
    parts = [shuffled[k::files] for k in range(files)]
    parts[0].append(rows[-3])
    parts[-1] += rows[-2:]
    led, acc = ledger_rows(spark, rows), accounts_rows(spark, [f"A{k}" for k in range(5)])

    agg = sm.upsert_log(sm.monthly_balances_stream(land(spark, parts)), scratch_path(spark, "t_a"), scratch_path(spark, "t_ac"))
    got = {(x.gl_account_id, x.month_ts.date(), x.net_balance, x.transaction_count)
           for x in sm.latest_rows(spark, agg, ["gl_account_id", "month_ts"]).collect()}
    assert got == {tuple(x) for x in bal.monthly_balances(led).select("gl_account_id", "month", "net_balance", "transaction_count").collect()}

    out = sm.dedupe_stream(spark, land(spark, [*parts, *parts]), scratch_path(spark, "t_d"), scratch_path(spark, "t_dc"))
    assert sorted(x.transaction_id for x in spark.read.parquet(out).collect()) == sorted(x[0] for x in rows)

    flags = sm.stream_ledger(spark, land(spark, parts), acc, scratch_path(spark, "t_s"), scratch_path(spark, "t_sc"))
    cols = ["gl_account_id", "current_month", "current_balance", "previous_balance", "z_score", "is_statistical_outlier", "severity"]
    want = det.detect_anomalies(bal.enrich_balances(bal.monthly_balances(led)), acc).select(*cols)
    assert sorted(map(str, sm.current_flags(spark, flags).select(*cols).collect())) == sorted(map(str, want.collect()))


def test_limiter_stream_refuses_calls_out_of_order(spark):
    path = scratch_path(spark, "t_calls")
    t0 = dt.datetime(2024, 1, 1)
    for part in ([60, 120], [0, 30]):
        spark.createDataFrame([("a", t0 + dt.timedelta(seconds=s)) for s in part], "agent string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(Exception, match="out of order"):
        sm.write_stream(sm.admit_calls_stream(src), scratch_path(spark, "t_lo"), scratch_path(spark, "t_lc"))


def test_limiter_cut_at_gaps_equals_one_scan(spark):
    r = random.Random(5)
    t0, t, rows = dt.datetime(2024, 1, 1), 0.0, []
    for _ in range(600):
        t += r.choice([1, 5, 20, 3600, 3600.000001, 4000])
        rows.append(("k", t0 + dt.timedelta(seconds=t)))
    rows += [(None, x[1]) for x in rows[:50]]
    got = co.admit_calls(spark.createDataFrame(rows, "caller_id string, ts timestamp_ntz").repartition(4), per_minute=3, per_hour=9).collect()
    for key in ("k", None):
        times = sorted(x[1] for x in rows if x[0] == key)
        admitted, want = [], []
        for x in times:
            ok = (sum(a >= x - dt.timedelta(seconds=60) for a in admitted) < 3
                  and sum(a >= x - dt.timedelta(hours=1) for a in admitted) < 9)
            want.append(ok)
            if ok:
                admitted.append(x)
        assert [g.admitted for g in sorted((g for g in got if g.caller_id == key), key=lambda g: g.ts)] == want


# --- numbers, text, keys -------------------------------------------------------------------

def test_one_number_rule(spark):
    good = {"12": "12.00", " 1.5 ": "1.50", "-.5": "-0.50", "7.": "7.00", "1.5E3": "1500.00", "+3": "3.00"}
    bad = ["12d", "3.5f", "NaN", "Infinity", "-inf", "1e17", "1,000", "0x1F", "", "--1", "1e", "."]
    rows = [(str(k), "A", "2024-01-05", v, "d", None, None) for k, v in enumerate([*good, *bad, "0", "-0.00", "0.004"])]
    raw = spark.createDataFrame(rows, "transaction_id string, gl_account_id string, date string, amount string, description string, department string, vendor string")
    ok, broken = va.project_ledger(raw, mode="quarantine")
    assert [str(x.amount) for x in ok.orderBy(F.col("transaction_id").cast("int")).collect()] == list(good.values())
    assert broken.count() == len(bad) + 3
    report = va.quality_report(raw).first()
    assert (report.non_numeric_amount, report.zero_amount) == (len(bad), 3)
    for v in bad:
        with pytest.raises(Exception, match="quality check failed"):
            va.project_ledger(raw.where(F.col("amount") == v)).collect()


def test_missing_columns_are_named(spark):
    raw = spark.createDataFrame([("1", "2024-01-01")], "transaction_id string, date string")
    with pytest.raises(ValueError, match="gl_account_id.*amount.*description"):
        va.project_ledger(raw)


def test_csv_round_trip_of_awkward_text(spark):
    texts = ['he said "hi", ok\\', '"', '""', "\\", 'a\\"b', "x,y", " lead and trail ", "tab\tin", "ünï"]
    led = ledger_rows(spark, [(str(k), "A", "2024-01-05", 10) for k in range(len(texts))])
    cases = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "transaction_id string, t string")
    led = led.drop("description", "department").join(cases, "transaction_id").withColumns(
        {"description": F.col("t"), "department": F.lit("dep")})
    out = scratch_path(spark, "t_csv")
    fs.sink_ledger_csv(led, out)
    for raw in (fs.scan_ledger(spark, f"{out}/all"), fs.scan_ledger_months(spark, f"{out}/by_month", "*/*.csv")):
        got = {x.transaction_id: (x.description, x.department) for x in raw.collect()}
        assert got == {str(k): (t, "dep") for k, t in enumerate(texts)}
    names = {x.source_file.split("/")[0] for x in fs.scan_ledger_months(spark, f"{out}/by_month", "*/*.csv").collect()}
    assert names == {"month=2024-01"}
    newline = led.limit(1).withColumn("description", F.lit("two\nlines"))
    fs.sink_ledger_csv(newline, out + "-nl")
    assert fs.scan_ledger(spark, f"{out}-nl/all", multi_line=True).first().description == "two\nlines"


def test_different_requests_have_different_keys(spark):
    rows = [("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a|b", None, None), ("a", "b", ""), ("a", '","p2":"b', None), ("", "a", "b")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    keys = [r.k for r in df.select(ru.request_key("n", F.col("x"), F.col("y"), F.col("z")).alias("k")).collect()]
    assert len(set(keys)) == len(rows) and all(k.startswith("n_") for k in keys)


# --- hot keys and shared folders -----------------------------------------------------------

def test_pairs_of_a_hot_label_are_spread(spark):
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)], 0 if k < 380 else 1) for k in range(400)]
    e = spark.createDataFrame(rows, "id int, embedding array<double>, label int")
    q, c = e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "chunk_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                         "spark.sql.adaptive.enabled")}
    try:
        for k in old:
            spark.conf.set(k, "-1" if "Threshold" in k else "false")
        got = dc.topk_similar(q, c, k=3, key="label", exclude_self=True, block_size=20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        free = dc.topk_similar(q.drop("label"), c.drop("label"), k=3, exclude_self=True, block_size=50)
        free_plan = free._jdf.queryExecution().executedPlan().toString()
        for p in (plan, free_plan):
            assert "Cartesian" not in p and "NestedLoop" not in p
        assert "hashpartitioning(label" in plan and "_q_block" in plan.split("SortMergeJoin [label")[1][:200]
        want = {(x["query_id"], x["chunk_id"], x["rank"]) for x in dc.topk_similar(q, c, k=3, key="label", exclude_self=True, block_size=1000).collect()}
        assert {(x["query_id"], x["chunk_id"], x["rank"]) for x in got.collect()} == want
        assert free.count() == 1200
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_machine_local_folder_on_a_cluster():
    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
                                 conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


# --- hand-worked ledger --------------------------------------------------------------------

def test_hand_worked_months(spark):
    """Two accounts over eight months, B without May; every number worked by hand."""
    a = [100, 100, 100, 200, 150, 150, 150, 600]
    b = [50, 55, 50, 40, None, 80, 80, 0]
    rows = [(f"a{m}", "A", f"2024-{m + 1:02d}-10", v) for m, v in enumerate(a)]
    rows += [(f"b{m}", "B", f"2024-{m + 1:02d}-10", v) for m, v in enumerate(b) if v is not None]
    got = {(r.gl_account_id, r.month.month): r for r in bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows))).collect()}
    assert got["A", 4].variance_percent == 100.0 and got["A", 5].variance_percent == -25.0
    assert got["A", 8].rolling_3mo_avg == 150.0 and got["A", 3].rolling_3mo_avg is None and got["A", 4].rolling_3mo_avg == 100.0
    # the six before August: 100 100 200 150 150 150, mean 141.6667, sample deviation 37.6386
    assert got["A", 8].rolling_6mo_std == 37.6386 and got["A", 8].z_score == 12.1772 and got["A", 8].is_statistical_outlier
    assert got["B", 6].prev_month_balance is None and got["B", 6].variance_percent is None       # May was observed, B has none
    assert got["B", 7].variance_percent == 0.0 and got["B", 8].variance_percent == -100.0
    # B's six before August skip the missing month: 55 50 40 80 80 are five of them, with 50 first
    assert got["B", 8].rolling_6mo_std == round(__import__("statistics").stdev([50, 55, 50, 40, 80, 80]), 4)
    flags = det.detect_anomalies(bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows))), accounts_rows(spark, ["A", "B"]))
    found = {(f.gl_account_id, f.current_month, f.severity, f.direction) for f in flags.collect()}
    assert found == {("A", "2024-04", "high", "increase"), ("A", "2024-05", "medium", "decrease"), ("A", "2024-08", "high", "increase"),
                     ("B", "2024-04", "medium", "decrease"), ("B", "2024-08", "high", "decrease")}
