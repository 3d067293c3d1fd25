"""Sharding (operator 7): a K-d tree over document metadata with weighted cuts.

A node that has to become k shards is cut along its widest dimension, so that
floor(k / 2) / k of its bytes lie to the left.  Widths are measured against
the whole table's.  The weighted median of all nodes of a level is found with
two aggregations: bytes per (node, bin of the dimension), then, within the
bin that the cut falls into, bytes per (node, bin of a hash of id and text).
Rows that tie in the dimension are thus told apart by the hash, so a value
that holds any share of the rows is cut as well.  Leaves hold about
``target_bytes`` (or the table's bytes over ``n_shards``).  Only narrow rows
move; each level is written once.

Defined results: a null text has no bytes; null metadata lies below all
values; repeated rows stay side by side in one bin but are all placed; with
fewer documents than shards some shards are empty; an empty table gives an
empty one; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_totals, stored, text_bytes

BINS = 1024
HASH_BINS = 8192


#: a table of distinct values is broadcast to the rows up to so many
BROADCAST_VALUES = 10_000


def document_dimensions() -> dict[str, Column]:
    """Dimensions of the table of documents that are numbers: id, size (log)."""
    return {"id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)), "bytes": F.log2(F.col("size").cast("double") + 1)}


def with_rank(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with the text column ``col`` replaced by the place of its
    value among all distinct values in byte order (null first)."""
    values = running_totals(rows.select(F.col(col).alias("value")).distinct(), [], [F.col("value").asc_nulls_first()],
                            {"place": F.lit(1)}, "kd_values")
    near = F.broadcast(values) if values.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else values
    return (rows.join(near, F.col(col).eqNullSafe(F.col("value")))
            .withColumn(col, F.col("place").cast("double")).drop("value", "place"))


def _cuts(rows: DataFrame, bins: str, goal: str, before: str) -> DataFrame:
    """Per node: the first bin where the running bytes reach the goal, the
    bytes below it, and 1 if the goal is nearer to the bin's end than to its start."""
    w = Window.partitionBy("node").orderBy(bins)
    h = rows.groupBy("node", bins).agg(F.sum("size").alias("in_bin"), F.first(goal).alias("goal"), F.first(before).alias("start"))
    h = h.withColumn("upto", F.col("start") + F.sum("in_bin").over(w))
    return (h.where(F.col("upto") >= F.col("goal")).groupBy("node")
            .agg(F.min(F.struct(F.col(bins).alias("bin"), (F.col("upto") - F.col("in_bin")).alias("below"),
                                (F.col("upto") * 2 - F.col("in_bin") <= F.col("goal") * 2).cast("long").alias("nearer"))).alias("cut")))


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
              dimensions: dict[str, Column] | None = None, text_dimensions: Sequence[str] = ("lang", "source"), id_col: str = "doc_id",
              text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n-1), slot (gapless from 0 in its
    shard).  Dimensions are numbers (``dimensions``; ``size`` may be used) and
    text columns (``text_dimensions``), which count by their place among the
    distinct values."""
    dims = document_dimensions() if dimensions is None else dimensions
    names = [f"d{k}" for k in range(len(dims) + len(text_dimensions))]
    sized = docs.withColumn("size", text_bytes(text_col) + overhead)
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    rows = stored(sized.select(
        F.col(id_col).alias("doc_id"), "size", crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("u"),
        *[c.cast("double").alias(n) for n, c in zip(names, dims.values(), strict=False)],
        *[F.col(c).cast("string").alias(n) for n, c in zip(names[len(dims):], text_dimensions, strict=True)]), "kd_texts")
    for name in names[len(dims):]:
        rows = with_rank(rows, name)
    rows = stored(rows.select("doc_id", "size", "text_crc32", "u", *names), "kd_rows")
    ends = rows.agg(F.sum("size").alias("size"), *[F.min(n).alias(f"lo_{n}") for n in names],
                    *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    if n_shards is None:
        n_shards = max(1, math.ceil((ends["size"] or 0) / target_bytes))
    width = {n: (ends[f"hi_{n}"] or 0.0) - (ends[f"lo_{n}"] or 0.0) for n in names}
    cur = rows.withColumns({"node": F.lit(1).cast("long"), "k": F.lit(n_shards), "shard": F.lit(0)})
    for _ in range(max(0, (n_shards - 1).bit_length())):
        spread = F.array(*[(F.max(n) - F.min(n)) / F.lit(width[n] or 1.0) for n in names])
        nodes = cur.where("k > 1").groupBy("node").agg(
            F.sum("size").alias("node_size"), F.first("k").alias("node_k"), spread.alias("spread"),
            F.array(*[F.min(n) for n in names]).alias("lo"), F.array(*[F.max(n) for n in names]).alias("hi"))
        axis = F.array_position("spread", F.array_max("spread")).cast("int")
        nodes = nodes.select(
            F.col("node").alias("n_node"), axis.alias("axis"), F.element_at("lo", axis).alias("lo"),
            F.element_at("hi", axis).alias("hi"), F.floor(F.col("node_k") / 2).cast("int").alias("left_k"),
            (F.col("node_size") * F.floor(F.col("node_k") / 2) / F.col("node_k")).alias("goal"))
        nodes = stored(nodes, "kd_nodes")                              # at most one row per shard
        x = F.element_at(F.array(*names), F.col("axis"))
        share = (x - F.col("lo")) / (F.col("hi") - F.col("lo"))
        code = F.when(F.col("hi") > F.col("lo"), F.floor(share * BINS)).otherwise(0).cast("long")
        coded = cur.join(nodes, F.col("node") == F.col("n_node"), "left").withColumn("code", code).withColumn(
            "ubin", F.floor(F.col("u") / ((1 << 40) // HASH_BINS)).cast("long")).withColumn("zero", F.lit(0).cast("long"))
        first = stored(_cuts(coded.where("k > 1"), "code", "goal", "zero").select(
            F.col("node").alias("c_node"), F.col("cut.bin").alias("cut_code"), F.col("cut.below").alias("below")), "kd_cuts")
        split = coded.join(first, F.col("node") == F.col("c_node"), "left")
        fine = stored(_cuts(split.where("code = cut_code"), "ubin", "goal", "below").select(
            F.col("node").alias("f_node"), (F.col("cut.bin") + F.col("cut.nearer")).alias("cut_ubin")), "kd_cuts")
        placed = split.join(fine, F.col("node") == F.col("f_node"), "left")
        left = (F.col("code") < F.col("cut_code")) | ((F.col("code") == F.col("cut_code")) & (F.col("ubin") < F.col("cut_ubin")))
        go = F.coalesce(left, F.lit(True))
        cur = stored(placed.select(
            *rows.columns, F.when(F.col("k") > 1, F.col("node") * 2 + (~go).cast("long")).otherwise(F.col("node")).alias("node"),
            F.when(F.col("k") > 1, F.when(go, F.col("left_k")).otherwise(F.col("k") - F.col("left_k"))).otherwise(F.col("k")).alias("k"),
            F.when((F.col("k") > 1) & ~go, F.col("shard") + F.col("left_k")).otherwise(F.col("shard")).alias("shard")), "kd_level")
    out = running_totals(cur.select("doc_id", "size", "text_crc32", "u", "shard"), ["shard"],
                         [F.col("u"), F.col("doc_id"), F.col("text_crc32")], {"slot": F.lit(1)}, "kd_slots")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
