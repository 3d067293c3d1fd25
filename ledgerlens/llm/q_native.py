"""Queries: mixing, sharding, URL rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import kdtree, mixing, url_rules
from .common import table
from .registry import register

SEED = 17

OP1_SQL = rf"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
marks AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END AS weight FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, size,
       -ln((CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
       / coalesce(weight, 1.0) AS key
  FROM n LEFT JOIN marks USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
       2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
       sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM w),
f AS (SELECT total - used AS lft, heavy AS hv FROM o WHERE (total - used) * weight / heavy <= lim ORDER BY lim / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lft IS NULL OR lft * weight / hv >= lim THEN lim ELSE lft * weight / hv END AS target
      FROM o LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, e.source_size, e.target,
  CAST(r.size * least(e.epochs + CASE WHEN 2 * r.before + r.size <= 2 * (e.target - e.epochs * e.source_size) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""


@register("op1_mixing", OP1_SQL)
def op1_mixing(spark, sf_dir):
    """Documents labelled good weigh 2, poor 0.5, those without a label 1."""
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix_plan(table(spark, sf_dir, "documents"), weights=weights, seed=SEED).select("doc_id", "size", "source_size", "target", "taken")


@register("op7_kd_shards")
def op7_kd_shards(spark, sf_dir):
    """All documents in 40 shards of nearly equal bytes."""
    return kdtree.kd_shards(table(spark, sf_dir, "documents"), n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP10_SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r(r_host, r_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM c) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (host, path)
"""


@register("op10_url_rules", OP10_SQL)
def op10_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)
