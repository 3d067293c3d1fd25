"""Mixing sources to target weights (operator 1).

Every source has a weight and gets a share of the word budget in proportion
to it, but never more than ``max_epochs`` times what it holds; what is over
goes to the other sources by weight.  A source first gives its complete
epochs.  The rest is an Efraimidis-Spirakis sample: each document draws an
exponential key, -ln(u) / quality, the documents of a source are sorted by
key, and those whose running sum of words reaches the remaining budget are
taken once more.  Documents stay whole; the one at the edge is taken if at
least half of it lies within the budget, so a source misses its target by
half a document at most.  u comes from a hash of the document id, so another
run takes the same documents.

Built from DataFrame functions only.  A source may hold any share of all
rows: sorting and summing run over ranges of (source, key).

Defined results: a null text has no words; null is a source of its own, last
in order; a null or non-positive quality counts as 1e-6, so such documents
come last; a document without words is never counted against a budget;
rows that agree in id and text share one key and lie next to each other; an
empty table gives an empty one; other columns, whatever their names, are
carried along as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_totals, stored, word_count

#: up to so many sources their table is broadcast to the rows
BROADCAST_SOURCES = 10_000
#: up to so many ids that their weight moves past the last key are broadcast to the texts
BROADCAST_IDS = 500_000


def sampling_key(id_col: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality with u from 52 bits of the md5 of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = F.when(quality > 0, quality.cast("double")).otherwise(F.lit(1e-6))
    return -F.log(u) / weight


def label_weights(labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """(doc_id, weight) of the labelled documents; an id with several labels
    counts by the best.  Ids without one keep the weight 1."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("best"))
    weight = F.when(F.col("best") == 1, good).when(F.col("best") == 0, poor)
    return best.select("doc_id", weight.cast("double").alias("weight")).where(F.col("weight").isNotNull())


def source_targets(sizes: DataFrame, cycle: Sequence[float], budget: float, max_epochs: int) -> DataFrame:
    """Of (source, source_size), one row per source: the target and how many
    complete epochs it holds.  Sources in code-point order (null last) get the
    weights of ``cycle`` in turn; the budget is ``budget`` times all sizes.

    Sources that reach their limit first are those with the least
    limit / weight; the first one in that order that stays below its limit
    fixes the share per unit of weight for all that follow."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    s = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(cycle) + 1))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(budget)))
    s = s.withColumn("used", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("heavy", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    left = F.col("total") - F.col("used")
    s = s.withColumn("below", left * F.col("weight") / F.col("heavy") <= F.col("limit"))
    first = F.min(F.when(F.col("below"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "used", left.alias("left"),
                                                    F.col("heavy").alias("heavy")))).over(all_rows)
    s = s.withColumn("level", first)
    share = F.col("level.left") * F.col("weight") / F.col("level.heavy")
    target = F.when(F.col("level").isNull() | (share >= F.col("limit")), F.col("limit")).otherwise(share)
    s = s.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return s.select("source", "source_size", "target", epochs.cast("long").alias("epochs"))


def _near(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join with the table of sources (null matches null), broadcast only if it has few rows."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    s = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _ranked(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality: Column, seed: int,
            weights: DataFrame | None) -> DataFrame:
    """Narrow rows in the order of their keys, with the words before each.  The
    weights are joined here, where the texts are already counted and left behind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                       quality.cast("double").alias("quality"), F.xxhash64(F.col(text_col)).alias("tie"))
    if weights is not None:
        w = weights.select(F.col("doc_id").alias("__id"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(w, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    rows = rows.withColumn("key", sampling_key(F.col("doc_id"), F.coalesce("weight", "quality"), seed))
    return running_totals(rows, ["source"], [F.col("key"), F.col("doc_id"), F.col("tie")],
                          {"before": F.col("size")}, "mix_keys")


def _taken_once_more() -> Column:
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return (F.col("before") * 2 + F.col("size")).cast("double") <= rest * 2


def mix_plan(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: int = 2,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             quality: Column | None = None, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken (words).

    ``weights`` (doc_id, weight; an id once) replaces ``quality`` for the ids in it."""
    ranked = _ranked(docs, id_col, source_col, text_col, F.lit(1.0) if quality is None else quality, seed, weights)
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = _near(ranked, source_targets(sizes, cycle, budget, max_epochs))
    copies = F.least(F.col("epochs") + _taken_once_more().cast("long"), F.lit(max_epochs).cast("long"))
    return rows.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _within(key: Column, doc_id: Column, tie: Column, cut: str) -> Column:
    """Whether a key is not behind the last one taken (none taken: false)."""
    at = F.struct(key.alias("key"), doc_id.alias("doc_id"), tie.alias("tie"))
    return F.coalesce(at <= F.col(cut), F.lit(False))


def mix_documents(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: int = 2,
                  id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  quality: Column | None = None, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken.

    Only the last key taken in each source is needed for that, so the texts
    are not shuffled.  ``weights`` (see :func:`mix_plan`) do not move them
    either: narrow rows tell which documents their weight puts on the other
    side of the last key, and only those few ids are joined with the texts,
    by broadcast up to ``BROADCAST_IDS``."""
    quality = F.lit(1.0) if quality is None else quality
    ranked = _ranked(docs, id_col, source_col, text_col, quality, seed, weights)
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, cycle, budget, max_epochs)
    cuts = (_near(ranked, targets).where(_taken_once_more()).groupBy("source")
            .agg(F.max(F.struct("key", "doc_id", "tie")).alias("cut")))
    plan = targets.withColumnRenamed("source", "__s").join(
        cuts, F.col("__s").eqNullSafe(F.col("source")), "left").select(
        F.struct(F.col("__s").alias("source"), "epochs", "cut").alias("mix"))
    if weights is not None:
        plan = stored(plan, "mix_cuts")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    near = F.broadcast(plan) if few else plan
    # the row is carried as one value, so its column names can't clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                        F.col(source_col).alias("source"), sampling_key(F.col(id_col), quality, seed).alias("key"), F.xxhash64(F.col(text_col)).alias("tie"))
    joined = keyed.join(near, F.col("source").eqNullSafe(F.col("mix.source")), "left")
    again = _within(F.col("key"), F.col("id"), F.col("tie"), "mix.cut")
    if weights is not None:
        listed = ranked.where(F.col("weight").isNotNull()).join(near, F.col("source").eqNullSafe(F.col("mix.source")), "left")
        plain = sampling_key(F.col("doc_id"), F.col("quality"), seed)
        other = stored(listed.where(
            _within(plain, F.col("doc_id"), F.col("tie"), "mix.cut") != _within(F.col("key"), F.col("doc_id"), F.col("tie"), "mix.cut"))
            .select(F.struct(F.col("doc_id").alias("id"), "source", "tie").alias("other")).distinct(), "mix_other")
        few = other.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        joined = joined.join(F.broadcast(other) if few else other,
                             (F.col("id") == F.col("other.id")) & (F.col("tie") == F.col("other.tie"))
                             & F.col("source").eqNullSafe(F.col("other.source")), "left")
        again = again != F.col("other").isNotNull()
    copies = F.least(F.col("mix.epochs") + again.cast("long"), F.lit(max_epochs).cast("long"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")
