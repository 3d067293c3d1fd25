"""Registered queries: stored-result reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reuse as ru
from . import adapters as ad
from .catalog import register

AS_OF = "2024-01-20 00:00:00"

REUSE_SQL = f"""
WITH ev AS (
  SELECT *, event_type || '_' || sha256('{{"p0":"' || CAST(user_id AS VARCHAR) || '","p1":"' || event_type || '"}}') AS key FROM events
),
stored AS (
  SELECT event_type AS namespace, key, props AS value, ts AS created_at, ts + INTERVAL 3 DAY AS expires_at,
         CAST(length(props) AS BIGINT) AS size_bytes
  FROM ev WHERE ts < TIMESTAMP '{AS_OF}'
),
every AS (
  SELECT event_type AS namespace, ts + INTERVAL 3 DAY AS expires_at, CAST(length(props) AS BIGINT) AS size_bytes FROM ev
),
requests AS (SELECT event_id, user_id, event_type, key FROM ev WHERE ts >= TIMESTAMP '{AS_OF}'),
best AS (SELECT key, max(expires_at) AS exp FROM stored GROUP BY key)
"""


def _frames(spark, sf, whole: bool = False):
    """Requests after the cut-off and results stored before it (``whole``: at any time)."""
    e = ad.table(spark, sf, "events").withColumn(
        "key", ru.request_key(F.col("event_type"), F.col("user_id"), F.col("event_type")))
    t = F.lit(AS_OF).cast("timestamp_ntz")
    stored = (e if whole else e.filter(F.col("ts") < t)).select(
        F.col("event_type").alias("namespace"), "key", F.col("props").alias("value"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"),
        F.length("props").cast("long").alias("size_bytes"))
    requests = e.filter(F.col("ts") >= t).select("event_id", "user_id", "event_type", "key")
    return requests, stored


@register("split_hits_misses", REUSE_SQL + """
SELECT r.event_id, r.user_id, r.event_type, r.key, coalesce(b.exp >= TIMESTAMP '""" + AS_OF + """', FALSE) AS hit
FROM requests r LEFT JOIN best b ON r.key = b.key""")
def split_hits_misses(spark, sf):
    """Requests after the cut-off day against results stored before it
    (3-day lifetime), split in two and put together with a mark."""
    requests, stored = _frames(spark, sf)
    hits, misses = ru.split_hits_misses(requests, stored, AS_OF)
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@register("reuse_stats", REUSE_SQL + """
SELECT namespace, count(*) AS entries, count_if(expires_at < TIMESTAMP '""" + AS_OF + """') AS expired,
       CAST(round(CAST(sum(size_bytes) AS DECIMAL(38,0)) / 1048576, 2) AS DECIMAL(38,2)) AS size_mb
FROM every GROUP BY namespace""")
def reuse_stats(spark, sf):
    _, stored = _frames(spark, sf, whole=True)
    return ru.reuse_stats(stored, AS_OF)


@register("hit_rate", REUSE_SQL + """,
m AS (SELECT r.event_type, coalesce(b.exp >= TIMESTAMP '""" + AS_OF + """', FALSE) AS hit
      FROM requests r LEFT JOIN best b ON r.key = b.key)
SELECT event_type, count(*) AS requests, count_if(hit) AS hits, count_if(hit) / count(*) AS hit_rate
FROM m GROUP BY event_type""")
def hit_rate(spark, sf):
    requests, stored = _frames(spark, sf)
    return ru.hit_rate(ru.mark_hits(requests, stored, AS_OF), ["event_type"])
