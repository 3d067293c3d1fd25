"""Source divergence audit (operator 12): how differently sources use terms.

Within a stratum (a language) every source is a group.  A group's share of a
term is p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), in integers,
and two groups differ by the sum of abs(p - q) over the stratum's V kept terms.

The group-term count matrix of a stratum is sparse: most groups lack most
terms.  It is held as a k^2 quadtree (k = 2): rows are groups, columns are
terms in order of their frequency, the square is cut into four quadrants again
and again, and only quadrants with a nonzero cell are kept.  In a quadrant
that is all zero for two groups each of its terms adds the same |z - z'|, z
being a group's share of a term it lacks.  So the price of a pair is
V * |z - z'| for the whole matrix, made without visiting any cell, plus a
correction for each quadrant that is nonzero for either group: the sum over
its terms of |p - p'| - |z - z'|.  Corrections come from one traversal for all
pairs of groups together: from a node (rows A, rows B, columns) it goes on
into those of the eight child nodes where A or B has a nonzero cell, down to
leaves of ``LEAF`` columns, which are worked on as dense arrays.

Columns are cut into strips of ``STRIP`` terms and groups into bands of
``BAND``, and each task traverses the nodes of one (band, band, strip): its
memory is bounded, whatever the number of terms and groups.  Strips without a
nonzero cell in either band cost nothing.

Defined results: null text, stratum and source count as ''; a group without
kept terms takes part with zero counts; a stratum that keeps no term has
V = 0 and pairs of value 0; repeated documents count as often as they occur;
empty tables give empty results; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_totals, stored
from .licenses import ascii_lower
from .textnum import return_memory

#: what stands between terms
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, PRIOR = 1_000_000_000, 5
#: columns and rows of the part of a matrix that one task holds, and of a leaf
STRIP, BAND = 2048, 128
LEAF, ROWS = 64, 16
#: the table of kept terms is broadcast up to so many rows
BROADCAST_TERMS = 200_000


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of two non-negative integers."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)) in 64-bit
    integers, for counts below 2^47: UNIT is multiplied in two steps, and each
    is divided with remainder."""
    a, b = 32_000, UNIT // 32_000
    bottom = F.greatest(total + F.lit(PRIOR) * kept, F.lit(1)).cast("long")
    top = (count + F.lit(PRIOR)).cast("long") * F.lit(a)
    return F.lit(1).cast("long") + _div(top, bottom) * F.lit(b) + _div((top % bottom) * F.lit(b), bottom)


def _name(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, stratum: str = "lang", group: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term
    in each group.  Each text is parsed once; it hands on its terms once for
    every occurrence and once for the document, and these are summed before
    they are shuffled."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), BETWEEN), "")
    rows = docs.select(_name(stratum).alias("lang"), _name(group).alias("source"), words.alias("ws"))
    kinds = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("docs"), F.col("ws").alias("terms")),
                    F.struct(F.lit(0).alias("n"), F.lit(1).alias("docs"), F.array_distinct("ws").alias("terms")))
    each = rows.select("lang", "source", F.explode(kinds).alias("kind")).select(
        "lang", "source", "kind.n", "kind.docs", F.explode("kind.terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, column): terms in at least ``least_docs`` documents
    of the stratum, numbered from 0 in order of their frequency."""
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs)
    return stored(running_totals(terms.select("lang", "term", "total"), ["lang"], [F.col("total").desc(), F.col("term")],
                                 {"column": F.lit(1)}, "divergence_order"), "divergence_terms")


class Quadtree:
    """One band x strip of the matrix: which quadrants hold a nonzero cell, at
    each level, and its cells.  ``rows`` and ``columns`` count from 0 within it."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, zero: np.ndarray, width: int):
        self.zero, self.width = zero, width               # share of a term that a row lacks
        order = np.lexsort((columns, rows))
        self.columns, self.shares = columns[order], shares[order]
        self.begin = np.searchsorted(rows[order], np.arange(len(zero) + 1))
        filled = np.zeros((_square(-(-len(zero) // ROWS)), _square(-(-width // LEAF))), bool)
        filled[rows // ROWS, columns // LEAF] = True
        self.levels = [filled]
        while filled.size > 1:
            h, w = filled.shape
            filled = filled.reshape(max(1, h // 2), min(2, h), max(1, w // 2), min(2, w)).any((1, 3))
            self.levels.append(filled)

    def dense(self, block: int, leaf: int) -> np.ndarray:
        """Shares of the rows of a leaf quadrant."""
        r0, r1, c0 = block * ROWS, min((block + 1) * ROWS, len(self.zero)), leaf * LEAF
        out = np.repeat(self.zero[r0:r1, None], min(LEAF, self.width - c0), axis=1)
        for r in range(r0, r1):
            lo, hi = self.begin[r], self.begin[r + 1]
            a, b = lo + np.searchsorted(self.columns[lo:hi], [c0, c0 + LEAF])
            out[r - r0, self.columns[a:b] - c0] = self.shares[a:b]
        return out


def _square(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def joint_corrections(a: Quadtree, b: Quadtree, same: bool) -> np.ndarray:
    """For each row of ``a`` and row of ``b``: the sum over the columns of
    |p - p'| - |z - z'|.  With ``same`` (one tree) for row blocks in order only."""
    out = np.zeros((len(a.zero), len(b.zero)), np.int64)
    levels = max(len(a.levels), len(b.levels))

    def at(t: Quadtree, level: int, i: int, k: int) -> bool:
        f = t.levels[min(level, len(t.levels) - 1)]
        return bool(i < f.shape[0] and k < f.shape[1] and f[i, k])

    def halves(x: int) -> tuple[int, ...]:
        return 2 * x, 2 * x + 1
    todo = [(levels - 1, 0, 0, 0)]
    while todo:
        level, i, j, k = todo.pop()
        if (same and j < i) or not (at(a, level, i, k) or at(b, level, j, k)):
            continue                                      # all zero for both: priced by the whole matrix
        if level:
            todo += [(level - 1, x, y, z) for x in halves(i) for y in halves(j) for z in halves(k)]
            continue
        if i * ROWS >= len(a.zero) or j * ROWS >= len(b.zero) or k * LEAF >= a.width:
            continue
        x, y = a.dense(i, k), b.dense(j, k)
        here = out[i * ROWS:i * ROWS + len(x), j * ROWS:j * ROWS + len(y)]
        here += np.abs(x[:, None, :] - y[None, :, :]).sum(2)
        here -= x.shape[1] * np.abs(a.zero[i * ROWS:i * ROWS + len(x), None] - b.zero[None, j * ROWS:j * ROWS + len(y)])
    return out


_PAIRS = pa.schema([("lang", pa.string()), ("row_a", pa.int64()), ("row_b", pa.int64()), ("more", pa.int64())])


def _traverse(key, part):
    """All pairs of groups of two bands, in one strip of terms."""
    lang, one, two, strip = (x.as_py() for x in key)
    row, column, p, z = (part.column(x).to_numpy() for x in ("row", "column", "p", "z"))
    width = int(part.column("width")[0].as_py())
    cell = column >= 0

    def tree(band: int) -> Quadtree:
        mine = row // BAND == band
        member, at = mine & ~cell, mine & cell
        zero = np.zeros(int(row[member].max()) - band * BAND + 1, np.int64)
        zero[row[member] - band * BAND] = z[member]
        return Quadtree(row[at] - band * BAND, column[at] - strip * STRIP, p[at], zero, width)
    if not cell.any():
        return _PAIRS.empty_table()
    a = tree(one)
    b = a if one == two else tree(two)
    found = joint_corrections(a, b, one == two)
    i, j = np.nonzero(np.triu(found, 1) if one == two else found)
    return_memory()
    return pa.table([pa.array([lang] * len(i), pa.string()), i + one * BAND, j + two * BAND, found[i, j]], schema=_PAIRS)


def _with_bands(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of bands that its own band is part of."""
    band = F.floor(F.col("row") / BAND)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_band")))
    return rows.withColumn("other", other).withColumn("one", F.least(band, "other")).withColumn("two", F.greatest(band, "other")).drop("other")


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, stratum: str = "lang", group: str = "source",
          text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has the
    divergence of a group from each other group of the stratum, part ``term``
    the ``top`` terms that it uses more than the stratum does as a whole."""
    counts = stored(term_counts(docs, stratum, group, text_col), "divergence_counts")
    kept = kept_terms(counts, least_docs)
    few = kept.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    cells = stored(counts.select("lang", "source", "term", "n").join(F.broadcast(kept) if few else kept, ["lang", "term"]), "divergence_cells")
    wide = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    names = docs.select(_name(stratum).alias("lang"), _name(group).alias("source")).distinct()
    numbered = running_totals(names, ["lang"], [F.col("source")], {"row": F.lit(1)}, "divergence_groups")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    last = numbered.groupBy("lang").agg(F.floor(F.max("row") / BAND).alias("last_band"))
    zero = F.lit(0).cast("long")
    groups = (numbered.join(sums, ["lang", "source"], "left").join(wide, "lang", "left").join(last, "lang")
              .select("lang", "source", "row", "last_band", F.coalesce("total", zero).alias("total"),
                      F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total")))
    groups = stored(groups.withColumn("z", share(zero, F.col("total"), F.col("terms"))), "divergence_numbers")
    # nonzero cells, and in every strip the members of its bands
    width = F.least(F.lit(STRIP).cast("long"), F.col("terms") - F.col("strip") * STRIP).alias("width")
    full = cells.withColumnRenamed("total", "all_groups").join(groups, ["lang", "source"])
    full = full.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    matrix = full.withColumn("strip", F.floor(F.col("column") / STRIP)).select("lang", "row", "last_band", "strip", "column", "p", "z", width)
    strips = F.explode(F.sequence(zero, F.floor((F.col("terms") - 1) / STRIP)))
    members = groups.where(F.col("terms") > 0).withColumn("strip", strips).select(
        "lang", "row", "last_band", "strip", F.lit(-1).cast("long").alias("column"), zero.alias("p"), "z", width)
    more = (_with_bands(matrix.unionByName(members)).drop("last_band").groupBy("lang", "one", "two", "strip")
            .applyInArrow(_traverse, "lang string, row_a long, row_b long, more long")
            .groupBy("lang", "row_a", "row_b").agg(F.sum("more").alias("more")))
    # every pair once, at the price of a matrix of zeros
    g = _with_bands(groups.select("lang", "source", "row", "z", "terms", "last_band"))
    mine = F.floor(F.col("row") / BAND)
    a = g.where(mine == F.col("one")).select("lang", "one", "two", "terms", F.col("source").alias("source_a"), F.col("row").alias("row_a"), F.col("z").alias("z_a"))
    b = g.where(mine == F.col("two")).select("lang", "one", "two", F.col("source").alias("source_b"), F.col("row").alias("row_b"), F.col("z").alias("z_b"))
    pairs = a.join(b, ["lang", "one", "two"]).where(F.col("row_a") < F.col("row_b")).join(more, ["lang", "row_a", "row_b"], "left")
    value = F.col("terms") * F.abs(F.col("z_a") - F.col("z_b")) + F.coalesce("more", zero)
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more_used = F.col("p") - share(F.col("all_groups"), F.col("lang_total"), F.col("terms"))
    terms = full.where(F.col("n") > 0).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                               more_used.alias("value")).where(F.col("value") > 0)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
