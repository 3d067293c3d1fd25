"""Query: hard-negative mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import negatives
from .common import table
from .registry import register

OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, b.k AS bk, a.vec_id AS aid, b.vec_id AS bid, a.label AS la, b.label AS lb, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
pos AS (SELECT ak, bk, aid AS anchor_id, bid AS positive_id, score AS positive_score FROM s WHERE la = lb
  QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, bid NULLS LAST, bk) <= 5),
neg AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY pos.ak, pos.bk ORDER BY score DESC, bid NULLS LAST, s.bk) AS rank,
    bid AS negative_id, positive_score, score AS negative_score
  FROM pos JOIN s ON s.ak = pos.ak AND la <> lb AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


@register("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark, sf_dir):
    """Negatives in the windows of the five nearest rows of the same label, for one row in fifty."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label=label)
