"""Exact row numbers within groups without putting a group into one task.

``Window.partitionBy(g).orderBy(...)`` sorts each group in a single task; a
group holding a third of all rows then becomes the whole job.  Here the rows
are instead sorted globally (range-partitioned, so a big group is spread
over many partitions) and numbered in three steps:

1. the sorted frame is materialised (its partitioning and order are fixed,
   lineage cut) and every row gets a position inside its partition;
2. a summary of (group, partition) -> row count is aggregated; it has at
   most one row per partition plus one per group boundary, so it is small;
3. a running sum over that summary gives each (group, partition) the number
   of the group's rows in earlier partitions; row number = that offset +
   the position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def row_number_in_groups(df: DataFrame, groups: list[str], order: list[Column], name: str = "row_number",
                         partitions: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position of each row within its group in the
    given order (which must be total, e.g. end with a unique key)."""
    sort_cols = [F.col(g) for g in groups] + list(order)
    sorted_ = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    sorted_ = sorted_.sortWithinPartitions(*sort_cols)
    # position inside the partition (monotonically increasing follows the sorted order)
    sorted_ = (sorted_.withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = materialize(sorted_)
    summary = (fixed.groupBy(*groups, "_pid")
               .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    sm = summary.select(*[F.col(g).alias(f"_s_{g}") for g in groups], F.col("_pid").alias("_s_pid"),
                        "_first", "_offset")
    cond = F.col("_pid") == F.col("_s_pid")
    for g in groups:                      # null-safe: a NULL group is a group too
        cond = cond & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    out = fixed.join(sm, cond, "inner")
    return (out.withColumn(name, (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_offset", "_s_pid", *[f"_s_{g}" for g in groups]))
