"""Call pricing, roll-ups, trailing counts and the rate-limiter replay."""

import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from ledgerlens.operators import costs as co

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _calls(spark, rows):
    return spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, model string, agent string, "
                                       "input_tokens long, output_tokens long, call_duration double, query_preview string")


def test_price_and_fallback(spark):
    rows = [("r", T0, "gpt-4o", "a", 1_000_000, 1_000_000, 1.0, "q"),
            ("r", T0, "mystery", "b", 1_000_000, 0, 1.0, None),
            ("z", T0, "text-embedding-3-small", "c", 0, 0, 1.0, "x" * 300)]
    p = co.price_calls(_calls(spark, rows), co.price_list(spark))
    got = {r["agent"]: r for r in p.collect()}
    assert got["a"]["total_cost"] == 0.02 and got["a"]["input_cost"] == 0.005
    assert got["b"]["total_cost"] == 0.03          # default model price
    assert len(got["c"]["query_preview"]) == 100 and got["b"]["query_preview"] == ""
    by = {(r["run_id"], r["agent"]): r["share"] for r in co.cost_by_agent(p).collect()}
    assert by[("z", "c")] == 0.0                   # zero total -> share 0
    assert abs(by[("r", "a")] - 0.4) < 1e-12
    s = {r["run_id"]: r for r in co.cost_summary(p).collect()}
    assert s["r"]["total_calls"] == 2 and s["r"]["total_cost"] == 0.05


def _python_trailing(times, w):
    return [sum(1 for u in times if t - w <= u <= t) for t in times]


def test_trailing_counts_match_brute_force(spark):
    rnd = random.Random(3)
    times = sorted(T0 + dt.timedelta(seconds=rnd.randint(0, 4 * 3600)) for _ in range(400))
    times[5] = times[4] + dt.timedelta(seconds=60)    # exactly 60 s old -> counted
    times = sorted(times)
    df = spark.createDataFrame([("k", t) for t in times], "caller_id string, ts timestamp_ntz")
    out = co.trailing_counts(df, "caller_id", "ts", {"m": 60, "h": 3600}, bucket_seconds=3600).orderBy("ts").collect()
    secs = [(t - T0).total_seconds() for t in times]
    want_m = _python_trailing(secs, 60)
    want_h = _python_trailing(secs, 3600)
    got = sorted(zip([(r["ts"] - T0).total_seconds() for r in out], [r["m"] for r in out], [r["h"] for r in out]))
    exp = sorted(zip(secs, want_m, want_h))
    assert got == exp


def _python_limiter(times, per_min, per_hour):
    mins, hours, out = deque(), deque(), []
    for t in times:
        while mins and mins[0] < t - 60:
            mins.popleft()
        while hours and hours[0] < t - 3600:
            hours.popleft()
        ok = len(mins) < per_min and len(hours) < per_hour
        if ok:
            mins.append(t)
            hours.append(t)
        out.append(ok)
    return out


def test_admit_calls_matches_replay(spark):
    rnd = random.Random(7)
    rows = []
    for key in ("a", "b"):
        for _ in range(300):
            rows.append((key, T0 + dt.timedelta(seconds=rnd.randint(0, 7200), microseconds=rnd.randint(0, 999999))))
    df = spark.createDataFrame(rows, "caller_id string, ts timestamp_ntz").repartition(3)
    got = co.admit_calls(df, per_minute=3, per_hour=40).collect()
    for key in ("a", "b"):
        ts = sorted((r[1] - T0).total_seconds() for r in rows if r[0] == key)
        exp = _python_limiter(ts, 3, 40)
        mine = [r["admitted"] for r in sorted((r for r in got if r["caller_id"] == key), key=lambda r: r["ts"])]
        assert mine == exp
    assert any(not r["admitted"] for r in got)


def test_cost_json_with_calls(spark):
    from ledgerlens.session import scratch_path
    from ledgerlens.sources.files import sink_cost_json
    rows = [("r1", T0, "gpt-4o", "a", 1_000_000, 0, 1.0, "q"), ("r2", T0, "gpt-4", "b", 10, 10, 1.0, "q")]
    p = co.price_calls(_calls(spark, rows), co.price_list(spark))
    path = scratch_path(spark, "t_cost_json")
    sink_cost_json(co.cost_report(p), path, calls=p)
    summ = {r["run_id"]: r for r in spark.read.json(f"{path}/summary").collect()}
    assert summ["r1"]["total_cost"] == "0.00500000" and '"agent":"a"' in summ["r1"]["cost_breakdown"]
    calls = spark.read.json(f"{path}/calls").collect()
    assert sorted((r["run_id"], r["total_cost"]) for r in calls) == [("r1", "0.00500000"), ("r2", "0.00000090")]
