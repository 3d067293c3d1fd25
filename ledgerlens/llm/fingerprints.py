"""Document fingerprints (operator 5): invertible Bloom lookup sketches.

A text's units are its paragraphs (lines); a long one is also cut behind each
word whose hash ends in two zero bits, and every ``LONGEST`` words where no
such word comes, so an edit changes the units that it touches and no others.  A unit's digest, together with how often it occurred
before in the text, is added to three cells of a small table: each cell holds
a count, the sum of its digests and the sum of their checks.  Two tables are
subtracted cell by cell and peeled: a cell that holds a single digest gives it
away, it is taken out of its other cells, and so on, until the digests that
differ are all known.  The likeness of two texts is the number of common
digests over the number of all.

Each third of a table has a power of two of cells, so a table can be folded to
any smaller size: two fingerprints are compared at the size of the smaller
one.  A text's table is as large as it takes to peel it by itself (it is made
twice as large until it does), so where a difference is too large for the
common size, its digests are read out of the fingerprint and the comparison is
made again in a larger table.  So any two stored fingerprints can be compared,
whatever their texts' sizes.

Rows are dealt into ranges of the document id, whose bounds are ids that
occur; the first rows of a range are also sent to the range before it, so
every document meets the one that follows it, and texts move once.

Defined results: a null text is empty; the likeness of two texts without
words is 1, of one with and one without 0; null ids come first; rows with
equal ids follow each other by text; a single document follows itself; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import Texts, mix, span_hashes

CELLS = 24          # the least number of a table; three times a power of two
LOAD = 1.5          # cells for a digest, to begin with
GROUP_CHARS = 1_500_000
LONGEST = 8         # words of a unit
_CELL = np.dtype([("count", "i1"), ("sum", "<u8"), ("check", "<u4")])
#: rounds of peeling; few tables need fifty, but a cell taken for a single one by mistake could go on for ever
ROUNDS = 1000


def unit_digests(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all units and the numbers of their texts, in order."""
    s, e, owner = t.words()
    if not len(s):
        return np.zeros(0, np.uint64), owner
    ends_unit = (span_hashes(t.buf, s, e, 3) & np.uint64(3)) == 0
    line = np.cumsum(t.buf == 10)[s]
    first = np.ones(len(s), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]) | ends_unit[:-1]
    at = np.arange(len(s))
    first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % LONGEST == 0
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(s)) - 1
    h, own = span_hashes(t.buf, s[begin], e[last], 4), owner[begin]
    # the k-th occurrence of a unit in its text is a digest of its own
    order = np.lexsort((h, own))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    at = np.arange(len(h))
    nth = np.empty(len(h), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), own


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0xA5A5A5A5)).astype(np.uint32)


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """One cell in each third: a remainder, so that of a table it folds to follows from it."""
    third = cells // 3
    return [j * third + (mix(keys ^ np.uint64(j + 1)) % np.uint64(third)).astype(np.int64) for j in range(3)]


def cells_for(n: np.ndarray) -> np.ndarray:
    """Cells of the first table that is tried for n digests."""
    third = np.maximum(CELLS // 3, np.ceil((LOAD * np.asarray(n) + 12) / 3)).astype(np.int64)
    return 3 * (1 << np.ceil(np.log2(third)).astype(np.int64))


class Tables:
    """Tables of several texts side by side."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.sum = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        s, c = keys * sign.astype(np.uint64), _check(keys) * sign.astype(np.uint32)
        for p in _places(keys, self.cells):
            at = owner * self.cells + p
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, s)
            np.add.at(self.check, at, c)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes all digests out that can be found: their tables, the digests,
        +1 or -1, and which tables are empty then."""
        found: list[tuple] = []
        at = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(ROUNDS):
            if not len(at):
                break
            sign = self.count[at]
            keys = self.sum[at] * sign.astype(np.uint64)
            single = (np.abs(sign) == 1) & (_check(keys) * sign.astype(np.uint32) == self.check[at])
            at, sign, keys = at[single], sign[single], keys[single]
            owner = at // self.cells
            _, first = np.unique(mix(keys) + owner.astype(np.uint64), return_index=True)
            owner, keys, sign = owner[first], keys[first], sign[first]
            if not len(keys):
                break
            self.add(owner, keys, -sign)
            found.append((owner, keys, sign))
            touched = np.unique(np.concatenate([owner * self.cells + p for p in _places(keys, self.cells)]))
            at = touched[np.abs(self.count[touched]) == 1]
        stuck = ((self.count != 0) | (self.sum != 0) | (self.check != 0)).reshape(self.n, self.cells).any(axis=1)
        empty = np.zeros(0, np.int64)
        owner, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty.astype(np.uint64), empty)
        return owner, keys, sign, ~stuck

    def as_text(self, sizes: np.ndarray) -> list[str]:
        """Each table, after the number of its digests, in base64."""
        cells = np.empty(self.n * self.cells, _CELL)
        cells["count"], cells["sum"], cells["check"] = self.count, self.sum, self.check
        raw, step = cells.tobytes(), self.cells * _CELL.itemsize
        return [base64.b64encode(struct.pack("<I", int(k)) + raw[i * step:(i + 1) * step]).decode() for i, k in enumerate(sizes)]

    @classmethod
    def of_text(cls, text: str) -> tuple[Tables, int]:
        """A single table, and the number of its digests."""
        raw = base64.b64decode(text)
        cells = np.frombuffer(raw[4:], _CELL)
        t = cls(1, len(cells))
        t.count[:], t.sum[:], t.check[:] = cells["count"], cells["sum"], cells["check"]
        return t, struct.unpack("<I", raw[:4])[0]

    def folded(self, cells: int) -> Tables:
        """A single table at a smaller size."""
        t = Tables(1, cells)
        for name in ("count", "sum", "check"):
            getattr(t, name)[:] = getattr(self, name).reshape(3, -1, cells // 3).sum(1, dtype=getattr(t, name).dtype).ravel()
        return t

    def digests(self) -> np.ndarray:
        """All digests of a single table that peels by itself."""
        copy = self.folded(self.cells)
        return copy.peel()[1]


def compare(a: str, b: str) -> tuple[float, list[int], list[int]]:
    """Likeness of two fingerprints, and the digests only in the first and
    only in the second."""
    (one, n_one), (two, n_two) = Tables.of_text(a), Tables.of_text(b)
    cells = min(one.cells, two.cells)
    x, y = one.folded(cells), two.folded(cells)
    x.count -= y.count
    x.sum -= y.sum
    x.check -= y.check
    _, keys, sign, done = x.peel()
    while not done[0]:
        # larger tables, made of the digests that the fingerprints give away
        cells *= 2
        x = Tables(1, cells)
        for t, side in ((one, 1), (two, -1)):
            own = t.digests()
            x.add(np.zeros(len(own), np.int64), own, side)
        _, keys, sign, done = x.peel()
    more, less = keys[sign > 0].tolist(), keys[sign < 0].tolist()
    total = n_one + len(less)
    return (n_one - len(more)) / total if total else 1.0, more, less


def _csr(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(owner, minlength=n)
    return keys, np.append(0, np.cumsum(size))


def _filled(some: np.ndarray, cells: int, sides: list[tuple[tuple, np.ndarray, int]]) -> Tables:
    """Tables of ``cells`` cells with the digests of each side's texts."""
    t = Tables(len(some), cells)
    for (keys, off), who, sign in sides:
        n = off[who + 1] - off[who]
        at = np.repeat(off[who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        t.add(np.repeat(np.arange(len(some)), n), keys[at], sign)
    return t


def _by_size(sizes: np.ndarray, todo: np.ndarray):
    """Rows of equal size, a bounded number of cells at a time."""
    for cells in np.unique(sizes[todo]).tolist():
        same = todo[sizes[todo] == cells]
        step = max(1, 500_000 // cells)
        for lo in range(0, len(same), step):
            yield cells, same[lo:lo + step]


def fingerprints_of(texts: tuple[np.ndarray, np.ndarray], n: int) -> tuple[list[str], np.ndarray]:
    """Fingerprints of the first n texts of (digests, offsets), and their cells."""
    count = np.diff(texts[1])[:n]
    sizes, out, todo = cells_for(count), [""] * n, np.arange(n)
    while len(todo):
        stuck = []
        for cells, some in _by_size(sizes, todo):
            t = _filled(some, cells, [(texts, some, 1)])
            prints = t.as_text(count[some])
            fits = (np.abs(t.count) < 128).reshape(len(some), cells).all(1)
            done = t.peel()[3] & fits
            for k in np.flatnonzero(done).tolist():
                out[some[k]] = prints[k]
            stuck.append(some[~done])
        todo = np.concatenate(stuck)
        sizes[todo] *= 2
    return out, sizes


def likenesses(a: tuple, b: tuple, pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likeness of text pairs[:, 0] of ``a`` to pairs[:, 1] of ``b``, each a
    (digests, offsets): that of their fingerprints, which have ``sizes`` in
    common.  The difference of two tables is the table of the difference, so
    it is filled from the digests; pairs that get stuck are tried again in
    tables twice as large."""
    out, todo, sizes = np.ones(len(pairs)), np.arange(len(pairs)), sizes.copy()
    while len(todo):
        stuck = []
        for cells, some in _by_size(sizes, todo):
            who = pairs[some]
            owner, _, sign, done = _filled(some, cells, [(a, who[:, 0], 1), (b, who[:, 1], -1)]).peel()
            more = np.bincount(owner[sign > 0], minlength=len(some))
            less = np.bincount(owner[sign < 0], minlength=len(some))
            own = a[1][who[:, 0] + 1] - a[1][who[:, 0]]
            total = own + less
            out[some[done]] = np.where(total > 0, (own - more) / np.maximum(total, 1), 1.0)[done]
            stuck.append(some[~done])
        todo = np.concatenate(stuck)
        sizes[todo] *= 2
    return out


def _fingerprint_group(ids: list, texts: list[str]) -> pa.RecordBatch:
    """texts: one more than ids, the last is what follows."""
    n = len(ids)
    half = [len(t) // 2 for t in texts[:n]]
    edited = [t[:len(t) - h] + after[:h] for t, after, h in zip(texts[:n], texts[1:], half, strict=True)]
    own = _csr(*unit_digests(Texts.of(texts)), n + 1)
    new = _csr(*unit_digests(Texts.of(edited)), n)
    prints, sizes = fingerprints_of(own, n + 1)
    new_prints, new_sizes = fingerprints_of(new, n)
    k = np.arange(n)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(prints[:n]), pa.array(new_prints),
        pa.array(likenesses(own, new, np.stack([k, k], 1), np.minimum(sizes[:n], new_sizes))),
        pa.array(likenesses(own, own, np.stack([k, k + 1], 1), np.minimum(sizes[:-1], sizes[1:])))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _fingerprints(batches):
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc, text, ahead in zip(*(batch.column(k) for k in ("doc_id", "text", "ahead")), strict=True):
            if ahead.as_py():       # what follows the last row; all rows behind it are ahead as well
                if ids:
                    yield _fingerprint_group(ids, [*texts, text.as_py() or ""])
                ids, texts = [], []
                break
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > GROUP_CHARS and len(ids) > 1:
                yield _fingerprint_group(ids[:-1], texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document, in ascending id order: fingerprints of its text and of
    the text in which the next document's beginning replaces its second half,
    and the likeness of its own to that one and to the next document's."""
    first_of_all = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(first_of_all)).alias("ord"))
    n = ranges or max(2, 2 * docs.select(text_col).rdd.getNumPartitions())
    cut = rows.agg(F.min("ord").alias("low"), F.percentile_approx(
        "ord", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("bounds")).first()
    # the bounds are ids that occur, as many as there are partitions
    low = cut["low"] if cut["low"] is not None else 0
    bounds = np.array(sorted({b for b in cut["bounds"] or [] if b > low}), np.int64)
    last = len(bounds)

    @F.pandas_udf("range int, first boolean")
    def place(order: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(bounds, order.to_numpy(), "right")
        return pd.DataFrame({"range": at.astype(np.int32), "first": order.to_numpy() == np.append(low, bounds)[at]})

    put = rows.withColumn("at", place("ord"))
    here = F.struct(F.col("at.range").alias("range"), F.lit(False).alias("ahead"))
    before = F.struct(F.when(F.col("at.range") > 0, F.col("at.range") - 1).otherwise(F.lit(last)).cast("int").alias("range"),
                      F.lit(True).alias("ahead"))
    dealt = put.withColumn("to", F.explode(F.when(F.col("at.first"), F.array(here, before)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", "ord", F.col("to.range").alias("range"), F.col("to.ahead").alias("ahead"))
    return (dealt.repartitionById(last + 1, "range").sortWithinPartitions("ahead", "ord", "text")
            .select("doc_id", "text", "ahead")
            .mapInArrow(_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double"))
