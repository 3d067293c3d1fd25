"""Stored-result reuse: keys, expiry boundary, stats."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import reuse as ru

NOW = dt.datetime(2024, 1, 20, 0, 0, 0)


def test_expiry_boundary_and_stats(spark):
    stored = spark.createDataFrame([
        ("llm", "k1", "v", NOW - dt.timedelta(hours=1), NOW, 1048576),                       # expires exactly now: hit
        ("llm", "k2", "v", NOW - dt.timedelta(hours=2), NOW - dt.timedelta(seconds=1), 10),  # expired
        ("vector", "k3", "v", NOW - dt.timedelta(hours=1), NOW + dt.timedelta(hours=1), 524288),
        ("vector", "k3", "v", NOW - dt.timedelta(days=3), NOW - dt.timedelta(days=2), 1)],   # older copy of k3
        "namespace string, key string, value string, created_at timestamp_ntz, expires_at timestamp_ntz, size_bytes long")
    req = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "key string")
    hits, misses = ru.split_hits_misses(req, stored, "2024-01-20 00:00:00")
    assert sorted(r["key"] for r in hits.collect()) == ["k1", "k3"]
    assert sorted(r["key"] for r in misses.collect()) == ["k2", "k4"]
    st = {r["namespace"]: (r["entries"], r["expired"], float(r["size_mb"]))
          for r in ru.reuse_stats(stored, "2024-01-20 00:00:00").collect()}
    assert st == {"llm": (2, 1, 1.0), "vector": (2, 1, 0.5)}


def test_request_key_is_stable(spark):
    df = spark.createDataFrame([("q", 3), ("q", 3), ("q", 4)], "a string, b int")
    keys = [r["k"] for r in df.select(ru.request_key("llm", F.col("a"), F.col("b")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[0].startswith("llm_") and len(keys[0]) == 4 + 64
