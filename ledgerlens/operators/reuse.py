"""Reuse of stored results: request keys, hit / miss split, store stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(namespace: Column | str, *parts: Column) -> Column:
    """``namespace_sha256(json of the numbered parts)``: the same request
    gives the same key on every executor and run.  Parts are quoted and NULL
    ones are written out, so no two different requests share a text."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    named = F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)])
    return F.concat(ns, F.lit("_"), F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256))


def split_hits_misses(requests: DataFrame, stored: DataFrame, as_of: Column | str) -> tuple[DataFrame, DataFrame]:
    """Requests answered by an unexpired stored result, and the rest.

    A stored result is valid while ``as_of <= expires_at`` (it expires only
    once the clock passes it).  Stored results are first reduced to one row
    per key (latest expiry), so a key stored many times can not multiply
    the join.
    """
    t = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    live = (stored.groupBy("key").agg(F.max("expires_at").alias("_exp"))
            .filter(F.col("_exp") >= t).select("key"))
    return requests.join(live, "key", "left_semi"), requests.join(live, "key", "left_anti")


def mark_hits(requests: DataFrame, stored: DataFrame, as_of: Column | str) -> DataFrame:
    """Every request with a ``hit`` flag (one plan for both sides)."""
    t = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    best = stored.groupBy("key").agg(F.max("expires_at").alias("_exp"))
    return (requests.join(best, "key", "left")
            .withColumn("hit", F.coalesce(F.col("_exp") >= t, F.lit(False))).drop("_exp"))


def reuse_stats(stored: DataFrame, as_of: Column | str) -> DataFrame:
    """Per namespace: entries, expired entries, size in MB (2 decimals)."""
    t = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return stored.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("expires_at") < t).alias("expired"),
        F.round(F.sum("size_bytes").cast("decimal(38,0)") / F.lit(1048576), 2).cast("decimal(38,2)").alias("size_mb"),
    )


def hit_rate(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"),
        (F.count_if("hit") / F.count(F.lit(1))).alias("hit_rate"))
