"""N-gram Jaccard join (operator 4): a chosen-path join over word shingles.

A text is the set of its runs of five words (all its words, if it has fewer).
Equal sets are put together first, whatever their number, so only different
sets are compared.  Each set carries ``COORDS`` min-wise samples of its
shingles; sets that share the sample at a coordinate share that shingle.

A run starts at the root and splits the sets by two sampled coordinates; sets
with the same sample go down together.  A bucket of at most ``limit`` sets is
compared by brute force; a larger one is split again by two coordinates that
its path chooses, to a fixed depth.  A bucket of which most pairs agree
on the coordinates is not split any more: its sets are mostly similar, and it
is compared by brute force, in blocks, so that no task holds a whole bucket.
A pair of similarity s survives a level with probability 1 - (1 - s)^2, or,
if it is split without end, with 1 - q, q = (1 - s + s q)^2.  Runs are
repeated until a pair at the threshold is missed with probability 1 -
``recall`` at most; all start in one pass.

Buckets are compared twice.  First by the samples alone: a set goes on only if
some other one in the bucket agrees in at least ``least`` samples (a pair at
the threshold fails that with probability below 1e-5).  Then the whole sets of
those that are left are made again from their texts, and the exact similarity
decides.  A pair that meets in several buckets is dealt with in the smallest
common one alone, so no list of pairs is needed to count each link once; a
task gives out one row per set: its number of links and one set to which it is
connected.  Classes are the connected components of these, found by repeated
joins.

Defined results: null, empty and blank texts have no links and are classes by
themselves; texts of fewer than five words agree only if all their words do;
repeated rows and equal texts are linked; a class has the smallest document
id in it (nulls last); an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textnum import Texts, mix, return_memory, shingle_hashes, span_hashes, stream
from .token_files import groups

COORDS = 40             # samples of each set
DEEP = 16               # those from here on are for deeper levels
BLOCK = 512             # sets of one bucket that a task holds, twice at most


def runs_needed(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is missed with at most 1 - recall."""
    q = 0.0
    for _ in range(200):
        q = (1 - threshold + threshold * q) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def least_agreeing(threshold: float, miss: float = 1e-5) -> int:
    """The greatest number of agreeing samples that a pair at the threshold
    falls short of with probability ``miss`` at most."""
    below = 0.0
    for k in range(COORDS + 1):
        below += math.comb(COORDS, k) * threshold ** k * (1 - threshold) ** (COORDS - k)
        if below > miss:
            return k
    return COORDS


# --- sets of whole texts -------------------------------------------------------------------

def _sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and the numbers of their texts, ascending."""
    s, e, owner = t.words()
    h, own = shingle_hashes(span_hashes(t.buf, s, e), owner, len(t), width)
    _, first = np.unique(mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return h[first], own[first]


def _keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that stand for a whole set, one per start in ``at``."""
    return np.stack([np.add.reduceat(h, at), np.add.reduceat(mix(h ^ np.uint64(0x9D2C5680)), at)], 1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as fixed-size binary values."""
    width = rows.shape[1] * rows.itemsize if len(rows) else 16
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _sketch(width: int):
    flips, mults = stream(11, COORDS), stream(13, COORDS) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for k, m, t in groups(Texts.of(batch.column(2))):
                h, own = _sets(t, width)
                n = np.bincount(own, minlength=m - k)
                full = np.flatnonzero(n)
                some = batch.slice(k, m - k)
                key = np.full(m - k, None, object)
                sig = np.full(m - k, None, object)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    best = np.stack([np.minimum.reduceat(((h ^ f) * a) >> np.uint64(32), at)
                                     for f, a in zip(flips, mults, strict=True)], 1).astype("<u4")
                    raw, rows = _keys(h, at).tobytes(), best.tobytes()
                    for i, j in enumerate(full.tolist()):
                        key[j], sig[j] = raw[16 * i:16 * i + 16], rows[4 * COORDS * i:4 * COORDS * (i + 1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(key, pa.binary()), pa.array(n.astype(np.int32)),
                     pa.array(sig, pa.binary())], ["doc_id", "tie", "skey", "n", "sig"])
    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for _, _, t in groups(Texts.of(batch.column(0))):
                h, own = _sets(t, width)
                n = np.bincount(own, minlength=len(t))
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                off = np.append(0, np.cumsum(n[full]))
                order = np.lexsort((h, own))
                yield pa.RecordBatch.from_arrays(
                    [_binary(_keys(h, off[:-1])), pa.Array.from_buffers(pa.large_binary(), len(full), [
                        None, pa.py_buffer(off * 8), pa.py_buffer(h[order])]).cast(pa.binary())], ["skey", "shingles"])
    return run


# --- buckets -------------------------------------------------------------------------------

def _value(sig: str, coord: int | str) -> Column:
    return F.expr(f"substring({sig}, 4 * ({coord}) + 1, 4)")


def buckets(sets: DataFrame, runs: int, limit: int, depth: int) -> DataFrame:
    """(leaf, skey, size): the buckets with at least two sets that are to be compared."""
    if 2 * runs > DEEP:
        raise ValueError("too many runs for the number of samples")
    first = F.explode(F.array(*[F.xxhash64(F.lit(c), _value("sig", c)) for c in range(2 * runs)]))
    rows = sets.select(first.alias("leaf"), "skey")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    cur = stored(rows.join(sizes, "leaf"), "join_level")
    done = [cur.where(F.col("size") <= limit)]
    for level in range(depth):
        big = cur.where(F.col("size") > limit)
        if big.isEmpty():
            return _all(done)
        span = COORDS - DEEP
        one = F.pmod(F.xxhash64("leaf"), F.lit(span)).cast("int")
        two = (one + 1 + F.pmod(F.xxhash64("leaf", F.lit(level)), F.lit(span - 1)).cast("int")) % span
        split = (big.join(sets.select("skey", "sig"), "skey")
                 .withColumn("coord", F.explode(F.array(one + DEEP, two + DEEP)))
                 .select("leaf", "skey", "size", F.xxhash64("leaf", "coord", _value("sig", "coord")).alias("child")))
        split = stored(split, "join_split")
        kids = stored(split.groupBy("leaf", "size", "child").agg(F.count("*").alias("n")), "join_kids")
        dense = (kids.groupBy("leaf").agg((F.sum(F.col("n") * F.col("n")) / (F.first("size") * F.first("size")) / 2).alias("agree"))
                 .select("leaf", (F.col("agree") >= 0.5).alias("dense")))
        dense = stored(dense, "join_dense")
        done.append(big.join(dense.where("dense"), "leaf", "left_semi"))
        alive = kids.where("n > 1").join(dense.where("not dense"), "leaf", "left_semi").select("child", F.col("n").alias("kid_size"))
        cur = stored(split.join(alive, "child").select(F.col("child").alias("leaf"), "skey", F.col("kid_size").alias("size")), "join_level")
        done.append(cur.where(F.col("size") <= limit))
    done.append(cur.where(F.col("size") > limit))
    return _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tasks_of(members: DataFrame) -> DataFrame:
    """Members of buckets dealt to tasks: (leaf, one, two, side, ...).  A large
    bucket falls into blocks by hash; each pair of blocks is a task."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("skey"), n.cast("long")).cast("int")
    rows = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other")).drop("other", "size")


# --- comparing in a task -------------------------------------------------------------------

def _stack(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _earlier(leaf: int, lists: list) -> np.ndarray:
    """Which pairs have a common bucket before this one."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    early = flat < leaf
    flat, row = flat[early], row[early]
    values, inverse = np.unique(flat, return_inverse=True)
    common = np.zeros((len(lists), len(lists)), bool)
    for lo in range(0, len(values), 4096):
        use = (inverse >= lo) & (inverse < lo + 4096)
        m = np.zeros((len(lists), min(4096, len(values) - lo)), np.float32)
        m[row[use], inverse[use] - lo] = 1
        common |= (m @ m.T) > 0
    return common


def _candidates(leaf: int, one: int, two: int, mine: np.ndarray, n: np.ndarray, sig: np.ndarray, lists: list,
                threshold: float, least: int) -> np.ndarray:
    """Matrix of pairs (upper triangle) that may be similar and belong to this bucket."""
    m = len(n)
    agree = np.zeros((m, m), np.int16)
    for c in range(COORDS):
        agree += sig[:, c][:, None] == sig[:, c][None, :]
    ok = (agree >= least) & (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]))
    if one != two:
        ok &= mine[:, None] != mine[None, :]
    ok = np.triu(ok, 1)
    if ok.any():
        ok &= ~_earlier(leaf, lists)
    return ok


def _by_task(batches, heads: int):
    """The rows of one task after the other, as a table; rows come sorted by (leaf, one, two)."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        t = t.combine_chunks()
        leaf, one, two = (t.column(k).to_numpy() for k in range(heads))
        cut = np.flatnonzero((leaf[1:] != leaf[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        at = [0, *cut.tolist()]
        for a, b in zip(at, cut.tolist(), strict=False):
            if b - a > 1:
                yield int(leaf[a]), int(one[a]), int(two[a]), t.slice(a, b - a)
        rest = t.slice(at[-1]) if len(leaf) else None
    if rest is not None and len(rest) > 1:
        yield int(rest.column(0)[0].as_py()), int(rest.column(1)[0].as_py()), int(rest.column(2)[0].as_py()), rest


def _prepare(task: pa.Table):
    col = {k: task.column(k).combine_chunks() for k in task.schema.names}
    return (col["mine"].to_numpy(), col["n"].to_numpy(), _stack(col["sig"], "<u4", COORDS),
            [x.as_py() for x in col["leaves"]], col["skey"].to_pylist(), col)


def _sift(threshold: float, least: int):
    def run(batches):
        out: list[tuple] = []
        for leaf, one, two, task in _by_task(batches, 3):
            mine, n, sig, lists, keys, _ = _prepare(task)
            ok = _candidates(leaf, one, two, mine, n, sig, lists, threshold, least)
            for k in np.flatnonzero(ok.any(axis=0) | ok.any(axis=1)).tolist():
                out.append((leaf, one, two, keys[k]))
            if len(out) > 20_000:
                yield _kept(out)
                out = []
        if out:
            yield _kept(out)
    return run


def _kept(out: list[tuple]) -> pa.RecordBatch:
    leaf, one, two, key = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(one, pa.int32()), pa.array(two, pa.int32()),
                                       pa.array(key, pa.binary())], ["leaf", "one", "two", "skey"])


def _common(sets: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Number of common shingles of the pairs in ``ok``."""
    out = np.zeros(ok.shape, np.int64)
    rows, cols = np.nonzero(ok)
    if len(rows) < 4 * len(sets):
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[i, j] = np.count_nonzero(b[at] == a)
        return out
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.zeros(ok.shape, np.float32)
    order = np.argsort(inverse, kind="stable")
    inverse, row = inverse[order], row[order]
    for lo in range(0, len(values), 4096):
        a, b = np.searchsorted(inverse, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, len(values) - lo)), np.float32)
        m[row[a:b], inverse[a:b] - lo] = 1
        total += m @ m.T
    return np.where(ok, total.astype(np.int64), 0)


def _compare(threshold: float, least: int):
    def run(batches):
        for leaf, one, two, task in _by_task(batches, 3):
            if len(task) > BLOCK // 2:
                return_memory()
            mine, n, sig, lists, keys, col = _prepare(task)
            ok = _candidates(leaf, one, two, mine, n, sig, lists, threshold, least)
            if not ok.any():
                continue
            sets = [np.frombuffer(x, "<u8") for x in col["shingles"].to_pylist()]
            common = _common(sets, ok)
            # similarity common / union, compared without rounding
            linked = ok & (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9)
            linked |= linked.T
            weight = col["copies"].to_numpy()
            links = linked.astype(np.int64) @ weight
            root = _components(linked)
            has = np.flatnonzero(linked.any(axis=1))
            if len(has):
                least_key: dict[int, bytes] = {}
                for k in has.tolist():
                    r = int(root[k])
                    least_key[r] = min(least_key.get(r, keys[k]), keys[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in has.tolist()], pa.binary()), pa.array(links[has]),
                     pa.array([least_key[int(root[k])] for k in has.tolist()], pa.binary())], ["skey", "links", "other"])
    return run


def _components(linked: np.ndarray) -> np.ndarray:
    """Number of the component of each row of a symmetric matrix."""
    root = np.arange(len(linked))
    big = len(linked)
    while True:
        low = np.where(linked, root[None, :], big).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


# --- classes -------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): the least node of each
    connected component.  Alternates two joins that hang every node, and the
    nodes near it, below the least one near it, until nothing changes."""
    def below(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    cur = stored(below(edges), "class_edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a != b").distinct(), "class_edges")      # each node with one below it
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
        cur = stored(below(small), "class_edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots


def similar_documents(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.99999, limit: int = 256,
                      depth: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, tie (hash of the text), set_id (key of its class,
    null without words), class_id (the smallest doc_id among all that are
    connected by links) and n_links (documents whose similarity is at least
    ``threshold``)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"),
                        F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_sketch(width), "doc_id long, tie long, skey binary, n int, sig binary"), "join_rows")
    sets = stored(rows.where("skey is not null").groupBy("skey").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.min("doc_id").alias("least_id")), "join_sets")
    least = least_agreeing(threshold)

    member = stored(buckets(sets, runs_needed(threshold, recall), limit, depth), "join_members")
    lists = member.groupBy("skey").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    known = stored(sets.select("skey", "n", "sig", "copies").join(lists, "skey"), "join_known")
    dealt = tasks_of(member).join(known.drop("copies"), "skey").select("leaf", "one", "two", "mine", "skey", "n", "sig", "leaves")
    task = ["leaf", "one", "two"]
    sifted = stored(dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(
        _sift(threshold, least), "leaf long, one int, two int, skey binary"), "join_sifted")

    # whole sets only of those that are left, made from their texts once more
    wanted = stored(sifted.select("skey").distinct().join(sets.select("skey", "least_id"), "skey"), "join_wanted")
    source = texts.join(wanted.select("least_id").distinct(), F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    full = (source.select("text").mapInArrow(_full_sets(width), "skey binary, shingles binary")
            .join(wanted.select("skey"), "skey", "left_semi").groupBy("skey").agg(F.first("shingles").alias("shingles")))
    block = F.ceil(F.col("size") / BLOCK).cast("int")
    place = member.select("leaf", "skey", F.pmod(F.xxhash64("skey"), block.cast("long")).cast("int").alias("mine"))
    exact = (sifted.join(place, ["leaf", "skey"]).join(known, "skey").join(full, "skey")
             .select("leaf", "one", "two", "mine", "skey", "n", "sig", "leaves", "copies", "shingles"))
    found = stored(exact.repartition(*task).sortWithinPartitions(*task).mapInArrow(
        _compare(threshold, least), "skey binary, links long, other binary"), "join_links")

    links = found.groupBy("skey").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("skey").alias("a"), F.col("other").alias("b")))
    tied = sets.select("skey", "copies", "least_id").join(roots, F.col("skey") == F.col("node"), "left").join(links, "skey", "left").select(
        "skey", F.coalesce("root", "skey").alias("root"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    tied = stored(tied, "join_tied")
    classes = tied.groupBy("root").agg(F.min("least_id").alias("class_id"))
    final = tied.join(classes, "root").select("skey", F.col("root").alias("set_id"), "class_id", "n_links")
    return rows.select("doc_id", "tie", "skey").join(final, "skey", "left").select(
        "doc_id", "tie", "set_id", F.when(F.col("skey").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
