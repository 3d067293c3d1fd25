"""Helpers shared by the operators: stored tables and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

#: Java regex of a word: a run of code points outside blank and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: one
    computation for several readers, and a lineage that ends at files which
    every executor can read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text (null: none)."""
    return F.coalesce(F.octet_length(F.col(col) if isinstance(col, str) else col), F.lit(0)).cast("long")


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   totals: dict[str, Column], name: str) -> DataFrame:
    """``df`` plus, for each entry of ``totals``, the sum of that expression
    over the earlier rows of the same ``keys`` (exclusive prefix sum).

    A key may hold any share of the rows: rows are range-partitioned by key
    and order, each partition sums for itself, and only one row per
    (partition, key) takes part in the scan over partitions.  Rows that tie
    in ``order`` are numbered in any order, so give an order without ties
    between different rows.  ``df`` is stored with its partition number
    first; the boundaries of a range partitioning are sampled, and a second
    run of them could differ.
    """
    part, parts = "__part", "__parts"
    exprs = {k: v.cast("long") for k, v in totals.items()}
    cut = stored(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
                 .withColumn(part, F.spark_partition_id()), name)
    per_part = cut.groupBy(part, *keys).agg(*[F.sum(e).alias(f"__sum_{k}") for k, e in exprs.items()])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col(part).alias(parts), *[F.col(k).alias(f"__key_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__off_{k}") for k in exprs])
    match = F.col(part) == F.col(parts)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    inner = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(e).over(inner), F.lit(0)).alias(k) for k, e in exprs.items()])
    return local.join(offsets, match, "left").select(
        *df.columns, *[(F.col(k) + F.coalesce(F.col(f"__off_{k}"), F.lit(0))).alias(k) for k in exprs])
