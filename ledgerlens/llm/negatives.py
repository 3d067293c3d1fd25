"""Hard-negative mining (operator 11): for anchors and their positives, rows of
other labels whose score lies in a window below the positive's.

Components are integers and a score is an integer inner product with the
anchor.  The rows are cut into blocks of ``BLOCK``; a block holds its rows and,
for each dimension, the list of its rows sorted by that component.  For an
anchor a block is searched by Fagin's threshold algorithm: the lists are read
from the end that the sign of the anchor's component asks for (sorted access),
every row seen is scored in full (random access), and what the components at
the present depth would score is a bound for all rows not seen.  The search of
a block ends once that bound is strictly below the score of the k-th row found
of every window (below the window's lower end where fewer are found): a row
that ties with the k-th could still come before it by its id.  So the result is
that of a full scan.

Anchors are the stated query set.  They are gathered into groups of ``GROUP``
and every block meets every group, as one row a pair; a pair gives at most k
rows per anchor and window, which are ranked over all blocks.  This runs twice:
first for the positives (rows of the same label), then for the windows that
they open.

Defined results: rows with a null label, a null vector, or a null or
non-finite component take no part; shorter vectors count as filled up with
zeros; a null id sorts last among equal scores and is no anchor; repeated rows
are rows of their own, also as positives of each other; a window that is empty
(also that of every negative positive score) has no negatives; empty tables
give empty results; other columns are not read.  Components must be so small
that all scores fit in 63 bits, else a ValueError tells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .textnum import return_memory

BLOCK, GROUP = 8192, 1024
#: groups of anchors are broadcast to the blocks up to so many bytes of vectors
BROADCAST_BYTES = 64_000_000
NONE = np.iinfo(np.int64).min

_BLOCK_SCHEMA = "first long, ids array<long>, labels array<long>, dims int, vectors binary, orders binary"


def whole_components(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: float) -> DataFrame:
    """(id, label, v): rows that take part, with components floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(label.isNotNull() & x.isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """A matrix of the vectors, filled up with zeros."""
    n, at = len(lists), lists.offsets.to_numpy()
    out = np.zeros((n, dims), np.int64)
    sizes = np.diff(at)
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = lists.flatten().to_numpy()
    return out


def _build_blocks(dims: int, size: int, narrow: bool):
    kind = np.int16 if narrow else np.int64

    def block(first: int, rows: pa.Table) -> pa.RecordBatch:
        m = _matrix(rows.column("v").combine_chunks(), dims)
        orders = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
        one = [pa.array([first]), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
               pa.array([rows.column("label").to_pylist()], pa.list_(pa.int64())), pa.array([dims], pa.int32()),
               pa.array([np.ascontiguousarray(m, kind).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(orders).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(one, ["first", "ids", "labels", "dims", "vectors", "orders"])

    def run(batches):
        # rows are numbered by partition and place in it
        first, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield block(first, rows.slice(0, size))
                first, n = first + size, n - size
                held = rows.slice(size).combine_chunks().to_batches()
        if n:
            yield block(first, pa.Table.from_batches(held))
        return_memory()
    return run


def sorted_blocks(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """The stored table of blocks; rows are dealt out evenly, whatever their values."""
    rows = stored(rows, "negatives_rows")
    size = F.size("v")
    n, dims, low, high = rows.agg(F.count("*"), F.max(size), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    top = max(abs(low or 0), abs(high or 0))
    if top * top * max(dims or 0, 1) >= 1 << 62:
        raise ValueError(f"components up to {top} in {dims} dimensions: scores may not fit in 63 bits")
    parts = max(1, -(-n // block_rows))
    return stored(rows.repartition(parts).mapInArrow(_build_blocks(max(dims or 0, 1), block_rows, top < 1 << 15), _BLOCK_SCHEMA), "negatives_blocks")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(row["ids"])
    kind = np.int16 if len(row["vectors"]) == 2 * n * row["dims"] else np.int64
    return np.frombuffer(row["vectors"], kind).reshape(n, row["dims"]), np.frombuffer(row["orders"], np.int32).reshape(row["dims"], n)


def exact_kind(top: int, dims: int) -> type:
    """The cheapest number in which sums of ``dims`` products of integers up to ``top`` are exact."""
    bound = top * top * max(dims, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def threshold_search(anchor: np.ndarray, vectors: np.ndarray, orders: np.ndarray, ok: np.ndarray, windows: np.ndarray, k: int,
                     ids: np.ndarray, step: int = 16) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For every window (low, high) the first k rows of ``ok`` by (score
    descending, id) with low <= score <= high: their numbers, their scores;
    and how many rows were scored.  ``anchor`` and ``vectors`` hold integers
    in a type in which scores are exact."""
    n = len(vectors)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool)
    none = np.zeros(0, np.int64)
    best_rows, best_scores = [none] * len(windows), [none] * len(windows)
    kth = np.empty(len(windows), np.int64)
    at = 0
    while True:
        depth = min(n, at + step) if len(up) + len(down) else n
        # sorted access: each list from the end where its products with the anchor are greatest
        met = np.zeros(n, bool)
        if len(up) + len(down):
            met[orders[up, n - depth:n - at]] = True
            met[orders[down, at:depth]] = True
        else:
            met[:] = True                                     # every score is 0
        new = np.flatnonzero(met & ~seen)
        seen |= met
        # random access: whole scores of the rows met for the first time
        found = new[ok[new]]
        scores = (vectors[found] @ anchor).astype(np.int64)
        for w, (low, high) in enumerate(windows):
            # rows below the k-th found so far can't come before it
            inside = (scores >= (low if len(best_rows[w]) < k else max(low, kth[w]))) & (scores <= high)
            r, s = np.concatenate([best_rows[w], found[inside]]), np.concatenate([best_scores[w], scores[inside]])
            if len(r) > k:
                order = np.lexsort((ids[r], -s))[:k]
                r, s = r[order], s[order]
            best_rows[w], best_scores[w] = r, s
            kth[w] = -(NONE + 1) if low > high else s.min() if len(r) == k else low     # nothing lies in an empty window
        at, step = depth, step * 4
        if at >= n or seen.all():
            break
        edge = (vectors[orders[up, n - at], up] * anchor[up]).astype(np.int64).sum() + (
            vectors[orders[down, at - 1], down] * anchor[down]).astype(np.int64).sum()
        if (edge < kth).all():
            break
    return best_rows, best_scores, int(seen.sum())


def _search(k: int, same_label: bool):
    """Of each pair of a block and a group of anchors: (anchor, window, row,
    id, label, score), at most k rows per anchor and window."""
    names = ["anchor", "window", "row", "id", "label", "score"]

    def pair(row: dict) -> pa.RecordBatch:
        vectors, orders = _unpack(row)
        top = max(abs(int(vectors.min())), abs(int(vectors.max()))) if vectors.size else 0
        kind = exact_kind(max([top, *(abs(x) for a in row["anchors"] for x in a["v"])]), row["dims"])
        vectors = vectors.astype(kind)
        first = row["first"]
        labels = np.array(row["labels"], np.int64)
        missing = np.array([x is None for x in row["ids"]], bool)
        ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        # null ids after all others, also after the greatest
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, missing))] = np.arange(len(ids))
        out = [[] for _ in range(5)]
        by_label = {x: labels == x for x in set(labels.tolist())}
        none = np.zeros(len(ids), bool)
        for a in row["anchors"]:
            windows = np.array([(w["low"], w["high"]) for w in a["windows"]], np.int64).reshape(-1, 2)
            ok = by_label.get(a["label"], none)
            if same_label:
                ok = ok.copy()
                if first <= a["row"] < first + len(ids):
                    ok[a["row"] - first] = False
            else:
                ok = ~ok
            vector = np.zeros(row["dims"], kind)
            vector[:len(a["v"])] = a["v"]
            if not ok.any() or not len(windows):
                continue
            rows, scores, _ = threshold_search(vector, vectors, orders, ok, windows, k, rank)
            for w, (r, s) in enumerate(zip(rows, scores, strict=True)):
                out[0].append(np.full(len(r), a["row"]))
                out[1].append(np.full(len(r), w))
                out[2].append(r)
                out[3].append(labels[r])
                out[4].append(s)
        anchor, window, at, label, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(first + at),
                                           pa.array(ids[at], mask=missing[at]), pa.array(label), pa.array(score)], names)

    def run(batches):
        for batch in batches:
            for k_ in range(batch.num_rows):
                yield pair(batch.slice(k_, 1).to_pylist()[0])
            return_memory()
    return run


_FOUND = "anchor long, window int, row long, id long, label long, score long"


def _meet(blocks: DataFrame, anchors: DataFrame, k: int, same_label: bool, group: int) -> DataFrame:
    """The first k rows of each window of each anchor, over all blocks.
    ``anchors``: row, id, label, v, windows."""
    n, dims = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    groups = max(1, -(-n // group))
    asked = stored(anchors.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")).agg(
        F.collect_list(F.struct("row", "label", "v", "windows")).alias("anchors")), "negatives_anchors")
    small = n * (dims or 0) * 8 <= BROADCAST_BYTES
    pairs = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(
        F.broadcast(asked) if small else asked, "group")
    # one pair a row; a task holds a few at a time
    found = pairs.drop("group").mapInArrow(_search(k, same_label), _FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives_found")


def _hundredth(x: Column) -> Column:
    """floor(x / 100) of an integer."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100).cast("long"))


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding",
         label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, block_rows: int = BLOCK, group: int = GROUP) -> DataFrame:
    """For every anchor (``is_anchor`` of its id) and each of its first
    ``positives`` rows of the same label: the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    rows = whole_components(vectors, id_col, F.col("label") if label is None else label, vector_col, scale)
    blocks = sorted_blocks(rows, block_rows)
    each = blocks.select("first", F.posexplode(F.arrays_zip("ids", "labels")).alias("at", "x"), "dims", "vectors")
    chosen = each.where(F.col("x.ids").isNotNull() & is_anchor(F.col("x.ids"))).groupBy("first").agg(
        F.collect_list(F.struct("at", F.col("x.ids").alias("id"), F.col("x.labels").alias("label"))).alias("chosen"))
    anchors = stored(blocks.select("first", "dims", F.size("ids").alias("n"), "vectors").join(chosen, "first").mapInArrow(
        _take_anchors, "row long, id long, label long, v array<long>"), "negatives_queries")
    everything = F.array(F.struct(F.lit(NONE).alias("low"), F.lit(-(NONE + 1)).alias("high")))
    pos = _meet(blocks, anchors.select("row", "label", "v", everything.alias("windows")), positives, True, group)
    # exact ends of the window: low * p <= 100 * s <= high * p
    p = F.col("score")
    window = F.struct((-_hundredth(-p * low)).alias("low"), _hundredth(p * high).alias("high"))
    opened = pos.withColumn("w", window).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "id", "score"))).alias("opened"))
    asked = anchors.join(opened, anchors["row"] == opened["anchor"]).drop("anchor")
    neg = _meet(blocks, asked.select("row", "label", "v", F.expr("transform(opened, x -> x.w)").alias("windows")), negatives, False, group)
    mined = neg.join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "opened"), "anchor")
    positive = F.col("opened")[F.col("window")]
    return mined.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def _take_anchors(batches):
    """The anchors of each block, with their vectors."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            kind = np.int16 if len(row["vectors"]) == 2 * row["n"] * row["dims"] else np.int64
            m = np.frombuffer(row["vectors"], kind).reshape(row["n"], row["dims"])
            at = [x["at"] for x in row["chosen"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["first"] + x for x in at], pa.int64()), pa.array([x["id"] for x in row["chosen"]], pa.int64()),
                 pa.array([x["label"] for x in row["chosen"]], pa.int64()), pa.array(list(m[at].astype(np.int64)), pa.list_(pa.int64()))],
                ["row", "id", "label", "v"])
