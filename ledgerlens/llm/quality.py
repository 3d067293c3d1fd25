"""Quality rules (operator 6): cutoffs whose false rejections are bounded.

Each rule rejects a document whose value is above a cutoff.  For every
stratum and rule the cutoffs of a fixed grid are tested from the most lenient
to the strictest on the labelled good documents: a cutoff is certified if the
exact (Clopper-Pearson) upper bound of its false rejection rate is at most
the rule's share of ``limit``; the first one that fails ends the sequence.
Testing in a fixed order needs no correction over cutoffs; over strata and
rules the error ``delta`` is split evenly (Bonferroni).  So with probability
1 - delta, in every stratum all rules together reject at most ``limit`` of the
good documents.  Among the certified cutoffs the one with the greatest
(labelled poor documents rejected - ``good_weight`` times good ones) is taken,
the most lenient on ties; where nothing is gained a rule does not act.  A
stratum with too few labels to certify anything keeps all its documents.

Counts are taken from whole texts.  The labelled rows are summed per
(stratum, rule, grid bin) before anything else, so only counts are gathered.

Defined results: a null text has no words; a null stratum is one of its own;
a document with several labels counts as good only if all say so; labels
that are null, or without a document, are left out; repeated rows count as
often as they occur; empty tables give empty results; columns of the input
beyond those named are kept by :func:`judge`, whatever their names, if they
do not clash with its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import Texts, mix, ranges, return_memory, span_hashes
from .token_files import groups

BINS = 200
#: texts are counted in groups of so many bytes, as a group needs some 50 times its size
COUNTED = 512_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


def _inside(mask: np.ndarray, t: Texts) -> np.ndarray:
    """True bytes of each text (texts follow each other without gaps)."""
    out, full = np.zeros(len(t), np.int64), t.ends > t.starts
    if full.any():
        out[full] = np.add.reduceat(mask.view(np.uint8), t.starts[full], dtype=np.int64)
    return out


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    both = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(both, return_index=True)
    return np.bincount(owner[first], minlength=n)


def counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a batch."""
    n, b = len(t), t.buf
    blank = _BLANK[b]
    s, e, owner = t.words()
    n_words = np.bincount(owner, minlength=n)
    # lines with a word
    ls, le, lo = t.lines()
    has = np.zeros(len(ls), bool)
    has[np.searchsorted(ls, s, "right") - 1] = True
    ls, le, lo = ls[has], le[has], lo[has]
    n_lines = np.bincount(lo, minlength=n)
    # words in windows of three that occur again
    covered = np.zeros(len(s), bool)
    windows = np.maximum(n_words - 2, 0)
    begin = ranges(np.cumsum(n_words) - n_words, windows)
    if len(begin):
        w = span_hashes(b, s, e)
        h = w[begin] + mix(w[begin + 1] + np.uint64(1)) + mix(mix(w[begin + 2]) + np.uint64(2))
        own = np.repeat(np.arange(n, dtype=np.uint64), windows)
        h = mix(h + own * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = begin[again]
        covered[at], covered[at + 1], covered[at + 2] = True, True, True
    upper = (b >= 65) & (b <= 90)
    return {
        "n_words": n_words, "word_chars": _inside(~blank & ((b & 0xC0) != 0x80), t), "n_symbols": _inside(_SYMBOL[b], t),
        "n_dup_lines": n_lines - _distinct(lo, span_hashes(b, ls, le), n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n), "n_lines": n_lines, "n_upper": _inside(upper, t),
        "n_letters": _inside(upper | ((b >= 97) & (b <= 122)), t), "n_bangs": _inside(b == 33, t)}


def _features(batches):
    for batch in batches:
        for k, m, t in groups(Texts.of(batch.column(batch.num_columns - 1)), COUNTED):
            c = counts(t)
            some = batch.slice(k, m - k)
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:-1], *[pa.array(c[x].astype(np.int64)) for x in _NAMES]],
                [*batch.schema.names[:-1], *_NAMES])
        return_memory()


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text") -> DataFrame:
    """``keep`` columns and the counts of each whole text."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_features, ", ".join([kept, *[f"{x} long" for x in _NAMES]]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.least(F.col(a) / F.col(b), F.lit(1.0))).otherwise(F.lit(0.0))


RULES = ("symbols", "capitals", "bangs", "dup_lines", "repeats")


def rule_bins() -> dict[str, Column]:
    """What each rule looks at, a share, on the grid: 0 for none, else 1 to BINS."""
    values = {"symbols": _share("n_symbols", "word_chars"), "capitals": _share("n_upper", "n_letters"),
              "bangs": _share("n_bangs", "n_words"), "dup_lines": _share("n_dup_lines", "n_lines"),
              "repeats": _share("n_repeat_words", "n_words")}
    return {k: F.ceil(values[k] * BINS).cast("int") for k in RULES}


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial (n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(1, k + 1, dtype=float)
    steps = np.log((n - i + 1) / i) + math.log(p / (1 - p))
    logs = n * math.log1p(-p) + np.append(0.0, np.cumsum(steps))
    top = logs.max()
    return float(min(0.0, top + math.log(np.exp(logs - top).sum())))


def is_certified(rejected: int, n: int, limit: float, delta: float) -> bool:
    """Whether the exact upper bound at confidence 1 - delta of a rate of
    which ``rejected`` of ``n`` were seen is at most ``limit``."""
    return n > 0 and rejected <= n * limit and log_binomial_cdf(rejected, n, limit) <= math.log(delta)


def best_cutoff(good: np.ndarray, poor: np.ndarray, limit: float, delta: float, good_weight: float) -> int | None:
    """Of the counts of good and poor documents per bin (0 to BINS): the bin
    above which documents are rejected, or None."""
    n, best, gain = int(good.sum()), None, 0.0
    for cut in range(BINS, -1, -1):
        rejected = int(good[cut + 1:].sum())
        if not is_certified(rejected, n, limit, delta):
            break
        now = float(poor[cut + 1:].sum()) - good_weight * rejected
        if now > gain:
            best, gain = cut, now
    return best


def cutoffs(labelled: DataFrame, stratum: str = "lang", limit: float = 0.05, delta: float = 0.05,
            good_weight: float = 10.0) -> DataFrame:
    """(stratum, rule, cutoff) from labelled counts: rows of
    :func:`text_counts` with ``good`` (boolean), those that pass the base rules."""
    bins = rule_bins()
    # one row per stratum, rule and bin
    seen = (labelled.select(F.col(stratum).alias("stratum"), "good", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), b.alias("bin")) for k, b in bins.items()])).alias("r"))
        .groupBy("stratum", "r.rule", "r.bin").agg(F.sum(F.col("good").cast("long")).alias("good"),
                                                   F.sum((~F.col("good")).cast("long")).alias("poor")))
    strata = max(1, labelled.select(stratum).distinct().count())
    share, error = limit / len(bins), delta / (strata * len(bins))

    kind = labelled.schema[stratum].dataType.simpleString()
    # at most BINS + 1 entries for each stratum and rule
    bounded = seen.groupBy("stratum", "rule").agg(F.collect_list(F.struct("bin", "good", "poor")).alias("bins"))
    return bounded.mapInArrow(_choose(share, error, good_weight), f"stratum {kind}, rule string, cutoff int")


def _choose(share: float, error: float, good_weight: float):
    def cutoff(bins: list[dict]) -> int | None:
        good, poor = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
        for x in bins:
            good[x["bin"]] += x["good"]
            poor[x["bin"]] += x["poor"]
        return best_cutoff(good, poor, share, error, good_weight)

    def run(batches):
        for batch in batches:
            cuts = pa.array([cutoff(x) for x in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cuts], ["stratum", "rule", "cutoff"])
    return run


def judge(features: DataFrame, cuts: DataFrame, stratum: str = "lang", few: int = 10_000) -> DataFrame:
    """``features`` plus base_failed and kept.  The cutoffs are broadcast only
    if there are at most ``few`` strata."""
    wide = cuts.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"__cut_{k}") for k in RULES])
    wide = wide.withColumnRenamed("stratum", "__stratum")
    small = wide.limit(few + 1).count() <= few
    rows = features.join(F.broadcast(wide) if small else wide, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for k, b in rule_bins().items():
        rejected = rejected | F.coalesce(b > F.col(f"__cut_{k}"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop(
        "__stratum", *[f"__cut_{k}" for k in RULES])


def with_labels(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """The labelled documents that pass the base rules, with ``good``."""
    marks = (labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
             .agg((F.min(quality_col) > 0).alias("good")))
    return features.where(~base_failed()).join(marks, F.col(id_col) == F.col("__id")).drop("__id")
