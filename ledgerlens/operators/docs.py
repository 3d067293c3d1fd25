"""Account documentation: generation, chunking, embedding, exact and indexed
top-k similarity search, and retrieval context for flagged anomalies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..schemas import (CHUNK_OVERLAP, CHUNK_SIZE, HISTORY_QUERY_PREFIX, NO_DOCUMENTATION, RETRIEVAL_K,
                       SIMILAR_CASES_K)
from ..session import materialize
from .detect import real_text

# --------------------------------------------------------------------------
# Generated documentation (one markdown document per account)
# --------------------------------------------------------------------------


def account_docs(accounts: DataFrame) -> DataFrame:
    """A markdown document per account from the master's fields."""
    rng = F.coalesce(F.concat(F.lit("$"), real_text(F.col("typical_min")), F.lit(" to $"),
                              real_text(F.col("typical_max"))), F.lit("not set"))
    seasonal = F.when(F.col("is_seasonal"), F.concat(
        F.lit("Seasonal account. Expected pattern: "), F.coalesce(F.col("seasonal_pattern"), F.lit("not stated")),
        F.lit("."))).otherwise(F.lit("Not seasonal: month-to-month movement should be small."))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("account_id"), F.lit(" "), F.col("account_name")),
        F.lit(""),
        F.lit("## Purpose"),
        F.concat(F.lit("Ledger account for "), F.col("account_name"), F.lit(" ("), F.col("category"),
                 F.lit(", "), F.coalesce(F.col("subcategory"), F.lit("general")), F.lit(").")),
        F.coalesce(F.col("description"), F.lit("")),
        F.lit(""),
        F.lit("## Expected monthly range"),
        rng,
        F.lit(""),
        F.lit("## Variance policy"),
        F.format_string("Movements above %.1f%% need a written explanation.",
                        F.coalesce(F.col("variance_threshold_pct"), F.lit(15.0))),
        F.lit("Changes above 15% go to the controller; above 30% to the CFO."),
        F.lit(""),
        F.lit("## Seasonality"),
        seasonal,
    )
    return accounts.select(
        "account_id",
        F.concat(F.col("account_id"), F.lit("_"), slug(F.col("account_name")), F.lit(".md")).alias("source_file"),
        text.alias("text"))


def missing_docs(accounts: DataFrame, existing: DataFrame) -> DataFrame:
    """Accounts whose documentation file does not exist yet."""
    docs = account_docs(accounts)
    return docs.join(existing.select("source_file"), "source_file", "left_anti")


# --------------------------------------------------------------------------
# Chunking
# --------------------------------------------------------------------------


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                text_col: str = "text") -> DataFrame:
    """Fixed-stride chunks of ``size`` characters overlapping by ``overlap``,
    over the whole text.  An empty text gives no chunk; a text up to
    ``size`` characters gives one.  Pure built-in expressions."""
    step = size - overlap
    n = F.length(F.col(text_col))
    n_chunks = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - overlap) / F.lit(step)))
    starts = F.sequence(F.lit(0), (n_chunks - 1) * step, F.lit(step))
    d = docs.filter(n > 0)
    ex = d.select("*", F.posexplode(starts).alias("chunk_no", "_start"))
    return (ex.withColumn("chunk_text", F.substring(F.col(text_col), F.col("_start") + 1, size))
            .withColumn("chunk_start", F.col("_start")).drop("_start", text_col))


#: fixed values: where texts are split, in this order; what is left is cut by characters
SEPARATORS = ("\n\n", "\n", " ")


def _pieces(text: Column, size: int, level: int, run: Column) -> Column:
    """A text as neighbouring pieces (length, run): cut before each separator
    of this level; pieces of ``size`` characters or more are cut again at the
    next one.  Pieces of one run come from the same cut; characters of a word
    that no separator cuts are one piece with a run that ends in ``c``."""
    if level == len(SEPARATORS):
        return F.array(F.struct(F.length(text).cast("int").alias("n"), F.concat(run, F.lit("c")).alias("run")))
    sep = SEPARATORS[level]
    parts = F.split(text, sep)        # no separator is special in a pattern
    cut = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p)))

    def piece(p: Column, i: Column) -> Column:
        whole = F.array(F.struct(F.length(p).cast("int").alias("n"), run.alias("run")))
        return F.when(F.length(p) < size, whole).otherwise(
            _pieces(p, size, level + 1, F.concat(run, F.lit("."), i.cast("string"))))
    return F.filter(F.flatten(F.transform(cut, piece)), lambda x: x["n"] > 0)


def _spans(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks as (start, end): neighbouring pieces of a run put together up to
    ``size`` characters; the next chunk begins with the pieces of the last
    ``overlap`` characters.  ``recent`` holds where the pieces of the open
    chunk begin, as far as an overlap can reach back."""
    span = "array<struct<s:int,e:int>>"

    def chars(begin: Column, end: Column) -> Column:
        starts = F.sequence(begin, F.greatest(end - overlap - 1, begin), F.lit(size - overlap))
        return F.transform(starts, lambda x: F.struct(x.alias("s"), F.least(x + size, end).alias("e"))).cast(span)

    def closed(acc: Column) -> Column:
        """The chunks so far with the open one."""
        one = F.when(acc["run"].endswith("c"), chars(acc["start"], acc["pos"])).otherwise(
            F.array(F.struct(acc["start"].alias("s"), acc["pos"].alias("e"))).cast(span))
        return F.when(acc["pos"] > acc["start"], F.concat(acc["out"], one)).otherwise(acc["out"])

    def add(acc: Column, p: Column) -> Column:
        end = acc["pos"] + p["n"]
        own = F.array(acc["pos"])
        other = ~acc["run"].eqNullSafe(p["run"])
        full = (end - acc["start"] > size) & (acc["pos"] > acc["start"])
        least = F.greatest(acc["pos"] - overlap, end - size)
        back = F.filter(F.concat(acc["recent"], own), lambda x: x >= least)
        fresh = F.struct(end.alias("pos"), acc["pos"].alias("start"), p["run"].alias("run"), own.alias("recent"), closed(acc).alias("out"))
        moved = F.struct(end.alias("pos"), F.coalesce(F.array_min(back), acc["pos"]).alias("start"), p["run"].alias("run"), back.alias("recent"),
                         closed(acc).alias("out"))
        more = F.struct(end.alias("pos"), acc["start"].alias("start"), p["run"].alias("run"),
                        F.filter(F.concat(acc["recent"], own), lambda x: x >= end - overlap).alias("recent"), acc["out"].alias("out"))
        return F.when(other, fresh).when(full, moved).otherwise(more)
    begin = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("run"),
                     F.array().cast("array<int>").alias("recent"), F.array().cast(span).alias("out"))
    return F.aggregate(pieces, begin, add, closed)


#: white space at either end
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    text_col: str = "text") -> DataFrame:
    """Separator-aware chunks of at most ``size`` characters: texts are cut
    before paragraphs, lines and blanks (and by characters where none is
    left), the shortest cut that does, and neighbouring pieces are put
    together again with about ``overlap`` characters of the chunk before.

    Separators stay with the piece that follows them, so chunks are parts of
    the text, without the white space at their ends; chunks of white space
    alone, and null or empty texts, give no row.  A fold over the pieces of
    each text, in array functions: nothing is shuffled, no Python runs."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    text = F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    pieces = _pieces(text, size, 0, F.lit(""))
    spans = _spans(pieces, size, overlap)
    chunks = F.filter(F.transform(spans, lambda x: F.regexp_replace(F.substr(text, x["s"] + 1, x["e"] - x["s"]), F.lit(_ENDS), F.lit(""))),
                      lambda c: c != "")
    return docs.where(F.length(text) > 0).select(*rest, F.posexplode(chunks).alias("chunk_no", "chunk_text"))


def dedupe_chunks(chunks: DataFrame, key: str = "account_id",
                  order: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """One row per (key, content hash): the first by ``order``, with the
    number of copies.  An aggregate, not a window: a chunk repeated in a
    third of all documents is combined map-side, never sorted in one task."""
    h = chunks.withColumn("content_hash", F.sha2(F.col("chunk_text"), 256))
    rest = [c for c in h.columns if c not in (key, "content_hash", *order)]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_first")
    g = h.groupBy(key, "content_hash").agg(first, F.count(F.lit(1)).alias("copies"))
    return g.select(key, "content_hash", *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)], "copies")


def add_documents(chunks: DataFrame, new_docs: DataFrame, key: str = "account_id",
                  order: tuple[str, ...] = ("doc_id", "chunk_no"), chunk: Callable[..., DataFrame] | None = None, **kw) -> DataFrame:
    """Chunk new documents (by separators, or with ``chunk``) and append them
    to a chunk table, without repeats."""
    new = (chunk or chunk_recursive)(new_docs, **kw)
    return dedupe_chunks(chunks.unionByName(new, allowMissingColumns=True), key, order)


# --------------------------------------------------------------------------
# Embedding (feature hashing with inverse document frequencies)
# --------------------------------------------------------------------------


def _buckets(text_col: str, dim: int) -> Column:
    """The lower-cased word tokens of a text, each hashed into one of ``dim``
    buckets by the first 32 bits of its md5, so the same text gives the same
    buckets on any engine (null: none)."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def token_idf(df: DataFrame, text_col: str, dim: int = 256) -> DataFrame:
    """(bucket, idf): ln((texts + 1) / (texts with the bucket + 1)) + 1, so
    that a bucket found in every text still counts; ``dim`` rows at most.
    Only counts per bucket are shuffled."""
    held = df.select(F.explode(F.array_append(F.array_distinct(_buckets(text_col, dim)), F.lit(-1))).alias("bucket"))
    counts = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("_df"))
    n = F.max(F.when(F.col("bucket") == -1, F.col("_df"))).over(Window.partitionBy(F.lit(0)))     # dim + 1 rows
    return (counts.withColumn("_n", n).where(F.col("bucket") >= 0)
            .select("bucket", (F.log((F.col("_n") + 1.0) / (F.col("_df") + 1.0)) + 1.0).alias("idf")))


def _rounded(m: np.ndarray, decimals: int) -> np.ndarray:
    """Numbers from -1 to 1 rounded as ``F.round`` does, half up on their
    decimal form, without a decimal number for each: only for those too near
    a half for their product with the scale to tell."""
    out = np.zeros_like(m)
    some = np.nonzero(m)
    v = m[some]
    scale = 10.0 ** decimals
    size = np.abs(v) * scale
    whole = np.floor(size)
    rest = size - whole
    r = np.copysign((whole + (rest > 0.5)) / scale, v)
    for i in np.flatnonzero(np.abs(rest - 0.5) < 1e-6):
        r[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    out[some] = r + 0.0             # no negative zero
    return out


def embed_text(df: DataFrame, text_col: str, idf: DataFrame, out_col: str = "embedding", dim: int = 256,
               decimals: int | None = None) -> DataFrame:
    """L2-normalised tf-idf vectors as ``array<double>``, one per row,
    rounded if ``decimals`` (at most 9) is given.  A local stand-in for a
    remote embedding model.  A text without known tokens has the zero vector.

    Each row is embedded where it lies: its buckets are counted in one Arrow
    pass, no token is shuffled.  ``idf`` has ``dim`` rows at most, which go to
    the tasks with the plan."""
    weights = np.zeros(dim)
    for r in idf.limit(dim).collect():
        weights[r.bucket] = r.idf
    out = T.StructType([f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    rows = df.select(*[F.col(f"`{f.name}`") for f in out.fields[:-1]], _buckets(text_col, dim).alias(out_col))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column(part.num_columns - 1)
                sizes = np.diff(lists.offsets.to_numpy())
                cell = np.repeat(np.arange(len(lists)), sizes) * dim + lists.flatten().to_numpy()
                v = np.bincount(cell, minlength=len(lists) * dim).reshape(len(lists), dim) * weights
                norm = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                if decimals is not None:
                    v = _rounded(v, decimals)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _as_lists(v)], part.schema.names)

    return rows.mapInArrow(run, out)


def _as_lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def embed_chunks(chunks: DataFrame, dim: int = 256, text_col: str = "chunk_text", decimals: int | None = None) -> DataFrame:
    """Chunks with vectors, weighted by their own frequencies."""
    return embed_text(chunks, text_col, token_idf(chunks, text_col, dim), dim=dim, decimals=decimals)


def embed_with(df: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dim: int,
               out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """Vectors from a model of the caller's: ``load()`` sets it up once in
    each Python worker task and returns a function from a list of at most
    ``batch`` texts to as many vectors of ``dim`` numbers.

    A null text has a null vector and is not given to the model.  A model that
    returns another number of vectors, or a vector of another length or with a
    number that is not finite, fails the job and the message tells which."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in parts:
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            given = np.flatnonzero(valid)
            out = np.zeros((len(given), dim))
            for k in range(0, len(given), batch):
                some = texts.take(pa.array(given[k:k + batch])).to_pylist()       # no more texts than these are Python's
                made = [np.asarray(v, dtype=float) for v in model(some)]
                if len(made) != len(some):
                    raise ValueError(f"the embedding function returned {len(made)} vectors for {len(some)} texts")
                for i, v in enumerate(made):
                    if v.shape != (dim,) or not np.isfinite(v).all():
                        raise ValueError(f"the embedding function returned a vector of shape {v.shape}, not of {dim} finite numbers, for {some[i][:40]!r}")
                    out[k + i] = v
            ends = np.concatenate([[0], np.cumsum(valid * dim)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~valid))
    return df.withColumn(out_col, embed(F.col(text_col)))


# --------------------------------------------------------------------------
# Exact top-k similarity search, blocked
# --------------------------------------------------------------------------


def _vector(df: DataFrame) -> Column:
    """The embedding as it is if in single precision (half the bytes, the same numbers), else in double."""
    kept = df.schema["embedding"].dataType.simpleString()
    return F.col("embedding").cast(kept if kept == "array<float>" else "array<double>").alias("embedding")


def _blocked(df: DataFrame, id_col: str, key: str | None, own: Column, other: Column, tag: str) -> DataFrame:
    """Vectors in blocks by hash of their id, once for each block of the
    other side that the block has to meet.  ``own`` and ``other`` are the
    numbers of blocks of the two sides within the key."""
    d = df.withColumn(f"_{tag}_block", F.pmod(F.xxhash64(F.col(id_col)), own))
    groups = d.groupBy(*([key] if key else []), f"_{tag}_block", other.alias("_n")).agg(
        F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("embedding").alias("v"))).alias(f"_{tag}"))
    met = "_c_block" if tag == "q" else "_q_block"
    return groups.withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


#: fixed values: a key's vectors are cut for at most so many pairs of blocks, and into blocks of at most so many vectors
MOST_PAIRS, MOST_VECTORS = 64, 32768


def _n_blocks(nq: Column, nc: Column, block_size: int) -> tuple[Column, Column]:
    """Into how many blocks the ``nq`` queries and ``nc`` corpus vectors of a
    key are cut.  Pairs of ``block_size`` vectors each, but not more than
    ``MOST_PAIRS``, with the larger side cut into more blocks: a vector is
    copied once for each block of the other side, so copies grow with the
    vectors, not with their square.  No block exceeds ``MOST_VECTORS``."""
    def cut(n: Column, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")
    pairs = F.least(cut(nq, block_size) * cut(nc, block_size), F.lit(MOST_PAIRS))
    wanted = F.round(F.sqrt(pairs * nq / F.greatest(nc, F.lit(1)))).cast("long")
    q = F.greatest(cut(nq, MOST_VECTORS), F.least(pairs, F.greatest(wanted, F.lit(1))))
    return q, F.greatest(cut(nc, MOST_VECTORS), F.floor(pairs / q).cast("long"))


def _ids_and_matrix(block: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids in ascending order and their vectors, from the values buffer."""
    order = pc.sort_indices(block.field(0))
    ids, v = block.field(0).take(order), block.field(1).take(order)
    sizes = np.diff(v.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one search must have the same length")
    return ids, v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)


#: fixed values: so many queries and corpus vectors are compared at a time, and so many of the latter at first
TILE, FIRST = (512, 2048), 256


def _nearest(qm: np.ndarray, cm: np.ndarray, k: int, qcode: np.ndarray | None = None,
             ccode: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, corpus, similarity): every query's ``k`` nearest corpus rows by
    cosine rounded to 6 decimals, ties by the smaller row; pairs of one code
    and vectors without a direction are left out.

    Tile by tile: a product of unit vectors in single precision, whose error is
    less than ``slack``, tells which pairs can beat the k-th one found so far,
    and only those are worked out in double precision."""
    qn, cn = np.linalg.norm(qm, axis=1), np.linalg.norm(cm, axis=1)
    qrow, crow = (np.flatnonzero(np.isfinite(n) & (n > 0)) for n in (qn, cn))
    qu, cu = ((m[r] / n[r, None]).astype(np.float32) for m, n, r in ((qm, qn, qrow), (cm, cn, crow)))
    slack = (qm.shape[1] + 8) * 2.0 ** -23 + 1e-6
    own = 0 if ccode is None or not len(ccode) else int(np.bincount(ccode).max())       # so many of a query's nearest can be itself
    cuts = [0, *range(FIRST, len(crow), TILE[1]), len(crow)] if len(crow) else []
    out = []
    for a in range(0, len(qrow), TILE[0]):
        rows = qrow[a:a + TILE[0]]
        best, at = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1)
        for b, end in pairwise(cuts):
            near = qu[a:a + TILE[0]] @ cu[b:end].T
            kth = best[:, -1]
            bound = kth - slack
            if np.isinf(kth).any() and k + own < near.shape[1]:
                bound = np.maximum(bound, np.partition(near, near.shape[1] - k - own, axis=1)[:, -k - own] - 2 * slack)
            bound[kth >= 1.0] = np.inf           # nothing is nearer, and later rows lose ties
            i, j = np.nonzero(near >= bound[:, None])
            j = crow[b + j]
            if ccode is not None:
                other = qcode[rows[i]] != ccode[j]
                i, j = i[other], j[other]
            sims = np.empty(len(i))
            for lo in range(0, len(i), 32768):
                x, y = rows[i[lo:lo + 32768]], j[lo:lo + 32768]
                with np.errstate(all="ignore"):
                    sims[lo:lo + 32768] = np.round(np.einsum("ij,ij->i", qm[x], cm[y]) / (qn[x] * cn[y]), 6)
            better = np.isfinite(sims) & (sims > kth[i])
            i, j, sims = i[better], j[better], sims[better]
            if not len(i):
                continue
            some = np.unique(i)
            held = at[some] >= 0
            i, j, sims = (np.concatenate(x) for x in ((np.repeat(some, held.sum(1)), i), (at[some][held], j), (best[some][held], sims)))
            order = np.lexsort((j, -sims, i))
            i, j, sims = i[order], j[order], sims[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, sims, rank = (x[rank < k] for x in (i, j, sims, rank))
            best[i, rank], at[i, rank] = sims, j
        i, r = np.nonzero(at >= 0)
        out.append((rows[i], at[i, r], best[i, r]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_pairs(k: int, exclude_self: bool):
    """Of each pair of a query block and a corpus block: every query's ``k``
    nearest corpus vectors (ties by the smaller id)."""
    def run(pairs: pa.Table) -> pa.Table:
        out = []
        for r in range(pairs.num_rows):
            (qids, qm), (cids, cm) = (_ids_and_matrix(pairs.column(x)[r].values) for x in ("_q", "_c"))
            codes = ()
            if exclude_self:
                code = pa.concat_arrays([qids, cids]).dictionary_encode().indices.to_numpy()
                codes = code[:len(qids)], code[len(qids):]
            i, j, sims = _nearest(qm, cm, k, *codes)
            out.append(pa.Table.from_arrays([qids.take(pa.array(i)), cids.take(pa.array(j)), pa.array(sims)], ["_qid", "_cid", "similarity"]))
        return pa.concat_tables(out)
    return run


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int = RETRIEVAL_K,
                 key: str | None = None, query_id: str = "query_id", corpus_id: str = "chunk_id",
                 exclude_self: bool = False, block_size: int = 4096) -> DataFrame:
    """Exact k nearest corpus vectors by cosine similarity for every query,
    restricted to the same ``key`` when given (filter before ranking).

    Plan: queries and corpus are cut into blocks per key; each (query
    block, corpus block) pair meets once, under a shuffle key of its own, so
    the pairs of a hot key spread over all tasks; matrix products
    yield each query's best ``k`` in that block; a final top-k per query
    over its block winners (``k`` x blocks rows) gives the exact answer.  No
    row per pair is ever materialised, and a Python worker holds one pair of
    blocks at a time.  A block of vectors is shuffled once for each block it
    meets, see :func:`_n_blocks`.  An id that the corpus has several times (one
    vector in several cells of an index) counts once.  Null vectors take no
    part.  Ties are broken by the smaller corpus id.  Output: query id, corpus
    id, rank (1 = nearest), similarity rounded to 6 decimals.
    """
    def side(df: DataFrame, id_col: str, name: str) -> DataFrame:
        return df.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias(name), _vector(df), *([key] if key else []))
    q, c = side(queries, query_id, "_qid"), side(corpus, corpus_id, "_cid")

    if key:
        both = q.select(key, F.lit(1).alias("_q1"), F.lit(0).alias("_c1")).unionByName(
            c.select(key, F.lit(0).alias("_q1"), F.lit(1).alias("_c1")))
        nq, nc = _n_blocks(F.sum("_q1"), F.sum("_c1"), block_size)
        sizes = both.groupBy(key).agg(nq.alias("_nq"), nc.alias("_nc"))
        q, c = q.join(sizes, key), c.join(sizes, key)
        nq, nc = F.col("_nq"), F.col("_nc")
    else:
        nq, nc = _n_blocks(*(F.lit(d.count()) for d in (q, c)), block_size)     # two numbers
    pair = [*([key] if key else []), "_q_block", "_c_block"]
    pairs = _blocked(q, "_qid", key, nq, nc, "q").join(_blocked(c, "_cid", key, nc, nq, "c"), pair)
    out_schema = T.StructType([T.StructField("_qid", queries.schema[query_id].dataType),
                               T.StructField("_cid", corpus.schema[corpus_id].dataType),
                               T.StructField("similarity", T.DoubleType())])
    # grouped as they are dealt out already: a worker is given one pair at a time
    found = pairs.groupBy(*pair).applyInArrow(_best_pairs(k, exclude_self), out_schema).distinct()
    w = Window.partitionBy("_qid").orderBy(F.col("similarity").desc(), F.col("_cid"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_id), F.col("_cid").alias(corpus_id), "rank", "similarity"))


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between vectors (zero ones: nan) and centres of length one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def _matrix_of(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _in_cells(centres: np.ndarray):
    """(id, embedding) to (id, embedding, cell, angle): the nearest centre; zero vectors are left out."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = _angles(_matrix_of(batch.column(1)), centres)
            some = pa.array(np.flatnonzero(~np.isnan(a[:, 0])))
            a = a[some.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(a.argmin(1).astype(np.int32)), pa.array(a.min(1))],
                                             ["id", "embedding", "cell", "angle"])
    return run


def _open_cells(centres: np.ndarray, radius: np.ndarray):
    """(id, embedding, cell, kth) to a row for each other cell that may hold a
    vector at least as near as the k-th one found so far."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):        # a row can become one for each cell
                part = batch.slice(at, 512)
                a = _angles(_matrix_of(part.column(1)), centres)
                # no vector of a cell is nearer than the angle to its centre less its radius
                nearest = np.cos(np.maximum(a - radius[None, :] - 1e-7, 0.0))
                kth = part.column(3).fill_null(-2.0).to_numpy()
                may = (nearest + 1e-6 >= kth[:, None]) & (radius >= 0)[None, :]
                may[np.arange(len(may)), part.column(2).to_numpy()] = False
                i, j = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(j.astype(np.int32))],
                                                 ["id", "embedding", "cell"])
    return run


def topk_pruned(queries: DataFrame, corpus: DataFrame, k: int = SIMILAR_CASES_K, query_id: str = "query_id", corpus_id: str = "chunk_id",
                exclude_self: bool = False, cells: int = 256, block_size: int = 4096) -> DataFrame:
    """Exact k nearest vectors as :func:`topk_similar` finds them without a
    key, but a query meets only cells that can hold one of them.

    Every vector belongs to the nearest of ``cells`` centres (corpus vectors
    chosen by hash), and a cell has the radius of its farthest member.  A query
    is searched in its own cell first; the k-th similarity found there rules
    out every cell whose radius can't reach nearer.  Queries are shuffled to
    the cells that are left.  Where vectors have no neighbourhoods nothing is
    ruled out, and the work is that of :func:`topk_similar`."""
    def side(df: DataFrame, id_col: str) -> DataFrame:
        return df.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), _vector(df))
    q, c = side(queries, query_id), side(corpus, corpus_id)
    some = c.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("id", F.col("embedding").cast("array<double>"))).limit(cells)     # cells x length numbers
    centres = np.array([r.embedding for r in some.select("embedding").collect()], float)
    if not len(centres):
        return topk_similar(queries, corpus, k, None, query_id, corpus_id, exclude_self, block_size)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    c, q = (materialize(d.mapInArrow(_in_cells(centres), T.StructType([*d.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
            for d in (c, q))
    radius = np.full(len(centres), -1.0)
    for r in c.groupBy("cell").agg(F.max("angle").alias("far")).collect():         # cells rows
        radius[r.cell] = r.far
    c = c.select(F.col("id").alias("_c"), "embedding", "cell")

    def search(rows: DataFrame) -> DataFrame:
        return topk_similar(rows.select(F.col("id").alias("_q"), "embedding", "cell"), c, k, "cell", "_q", "_c", exclude_self, block_size)
    own = materialize(search(q))
    kth = own.where(F.col("rank") == k).select(F.col("_q").alias("id"), F.col("similarity").alias("kth"))
    others = q.join(kth, "id", "left").select("id", "embedding", "cell", "kth").mapInArrow(
        _open_cells(centres, radius), q.select("id", "embedding", "cell").schema)
    found = own.unionByName(search(others)).select("_q", "_c", "similarity").distinct()
    w = Window.partitionBy("_q").orderBy(F.col("similarity").desc(), F.col("_c"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_q").alias(query_id), F.col("_c").alias(corpus_id), "rank", "similarity"))


# --------------------------------------------------------------------------
# Approximate search: an index of random projections
# --------------------------------------------------------------------------


def _cells(df: DataFrame, model: BucketedRandomProjectionLSHModel, tables: int) -> DataFrame:
    """Each row once per hash table, with ``table`` and ``cell``: the table's
    share of the model's projections, each rounded to a bucket, as one key."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    hashed = model.transform(df.withColumn("_unit", array_to_vector(unit)))
    per = model.getNumHashTables() // tables
    keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *[
        vector_to_array(F.col("_hashes")[i])[0] for i in range(t * per, (t + 1) * per)]).alias("cell")) for t in range(tables)]
    return hashed.withColumn("_at", F.explode(F.array(*keys))).select(*df.columns, "_at.table", "_at.cell")


def build_lsh_index(corpus: DataFrame, path: str, corpus_id: str = "chunk_id", key: str | None = None, tables: int = 16,
                    projections: int = 2, bucket: float = 1.5, seed: int = 7) -> None:
    """Store an index of every corpus vector under ``path``: the model, and a
    table of cells partitioned by hash table.

    A table hashes the direction of a vector by ``projections`` random
    projections cut into buckets of length ``bucket``; near vectors fall into
    the same cell of some table.  More tables find more, more projections or
    shorter buckets search fewer vectors.  A vector is stored once a table."""
    rows = corpus.where(F.col("embedding").isNotNull()).select(
        F.col(corpus_id).alias("id"), _vector(corpus), *([F.col(key).alias("key")] if key else []))
    lsh = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hashes", bucketLength=bucket, numHashTables=tables * projections, seed=seed)
    # the projections depend on the seed and the number of dimensions alone
    model = lsh.fit(rows.limit(1).withColumn("_unit", array_to_vector("embedding")))
    model.write().overwrite().save(f"{path}/model")
    _cells(rows, model, tables).write.mode("overwrite").partitionBy("table").parquet(f"{path}/cells")


def topk_docs_lsh(spark: SparkSession, queries: DataFrame, path: str, k: int = RETRIEVAL_K, query_id: str = "query_id",
                  corpus_id: str = "chunk_id", key: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest vectors of an index among those that share a cell
    (and the ``key``) with the query in any table.  All of these are compared
    exactly, block by block as in :func:`topk_similar`: a crowded cell is cut
    into blocks, and no candidate is left out.  Same columns as there; a
    query without enough neighbours in its cells gets fewer rows."""
    model = BucketedRandomProjectionLSHModel.load(f"{path}/model")
    index = spark.read.parquet(f"{path}/cells")
    tables = index.agg(F.max("table")).first()[0]
    if tables is None:
        tables = 0      # an empty index finds nothing
    q = queries.where(F.col("embedding").isNotNull()).select(
        F.col(query_id).alias("_query"), _vector(queries), *([F.col(key).alias("key")] if key else []))
    where = F.struct(*(["key"] if key else []), "table", "cell")
    c = index.select(F.col("id").alias("_id"), "embedding", where.alias("_place"))
    # of one type, so that pairs are grouped as they were joined; the cells are spread already, so blocks are large
    where = where.cast(c.schema["_place"].dataType)
    found = topk_similar(_cells(q, model, tables + 1).select("_query", "embedding", where.alias("_place")), c, k=k, key="_place",
                         query_id="_query", corpus_id="_id", exclude_self=exclude_self, block_size=16384)
    return found.withColumnsRenamed({"_query": query_id, "_id": corpus_id})


# --------------------------------------------------------------------------
# Retrieval context for flagged anomalies
# --------------------------------------------------------------------------


def retrieval_queries(flags: DataFrame) -> DataFrame:
    """One query sentence per flagged account-month."""
    pct = F.round(F.col("variance_percent").cast("decimal(38,6)"), 2).cast("double")   # half-up on the decimal
    q = F.format_string("%s %s changed %.2f%% in %s (%s)", F.col("gl_account_id"), F.col("account_name"),
                        pct, F.col("current_month"), F.col("direction"))
    return flags.select(F.concat(F.date_format("month", "yyyyMM"), F.lit("-"), F.col("gl_account_id")).alias("anomaly_id"),
                        "gl_account_id", "month", q.alias("query_text"))


def context_rollup(hits: DataFrame, chunks: DataFrame, query_id: str = "anomaly_id") -> DataFrame:
    """Per query: best chunk text, the next (at most two) chunks as a list
    and the file name of each hit, in rank order (a file that gave several
    hits is named as often).  At most ``k`` rows per group."""
    j = hits.join(chunks.select("chunk_id", "chunk_text", "source_file"), "chunk_id", "inner")
    g = j.groupBy(query_id).agg(F.sort_array(F.collect_list(
        F.struct("rank", "chunk_text", "source_file"))).alias("_h"))
    return g.select(
        query_id,
        F.coalesce(F.col("_h")[0]["chunk_text"], F.lit(NO_DOCUMENTATION)).alias("account_documentation"),
        F.transform(F.slice("_h", 2, 2), lambda x: x["chunk_text"]).alias("similar_cases"),
        F.transform("_h", lambda x: x["source_file"]).alias("source_files"))


#: turns (rows, text column) into rows with a column ``embedding``
Embedder = Callable[[DataFrame, str], DataFrame]


def _embedded(queries: DataFrame, chunks: DataFrame, dim: int, embed: Embedder | None) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks with vectors: by ``embed`` if given, else tf-idf
    with the frequencies of the chunks.  Chunks that have vectors keep them."""
    if embed is None:
        idf = token_idf(chunks, "chunk_text", dim)

        def embed(df, text_col):
            return embed_text(df, text_col, idf, dim=dim)
    return embed(queries, "query_text"), chunks if "embedding" in chunks.columns else embed(chunks, "chunk_text")


def retrieve_context(flags: DataFrame, chunks: DataFrame, history_counts: DataFrame | None = None,
                     k: int = RETRIEVAL_K, dim: int = 256, only_high: bool = False, embed: Embedder | None = None) -> DataFrame:
    """Context for every flagged row in one plan: query sentence, top-k
    chunks of the same account, roll-up, capped history count.  Flags with
    no documentation get the default text.  ``embed`` makes the vectors, for
    instance with :func:`embed_with`."""
    f = flags.filter(F.col("severity") == "high") if only_high else flags
    q, c = _embedded(retrieval_queries(f), chunks, dim, embed)
    c = c.withColumnRenamed("account_id", "gl_account_id") if "account_id" in c.columns else c
    hits = topk_similar(q, c, k=k, key="gl_account_id", query_id="anomaly_id", corpus_id="chunk_id")
    ctx = context_rollup(hits, c)
    out = q.select("anomaly_id", "gl_account_id").join(ctx, "anomaly_id", "left")
    out = out.withColumn("account_documentation", F.coalesce("account_documentation", F.lit(NO_DOCUMENTATION)))
    out = (out.withColumn("similar_cases", F.coalesce("similar_cases", F.array().cast("array<string>")))
              .withColumn("source_files", F.coalesce("source_files", F.array().cast("array<string>"))))
    if history_counts is not None:
        out = (out.join(history_counts, "gl_account_id", "left")
               .withColumn("past_anomaly_count", F.coalesce("history_count", F.lit(0)).cast("long"))
               .drop("history_count"))
    else:
        out = out.withColumn("past_anomaly_count", F.lit(0).cast("long"))
    return out


def similar_past_anomalies(flags: DataFrame, chunks: DataFrame, k: int = SIMILAR_CASES_K,
                           dim: int = 256, embed: Embedder | None = None) -> DataFrame:
    """The ``k`` chunks nearest to each flagged row's query sentence, with
    the history prefix and no account filter (all accounts' chunks)."""
    q = retrieval_queries(flags).withColumn("query_text", F.concat(F.lit(HISTORY_QUERY_PREFIX), F.col("query_text")))
    q, c = _embedded(q, chunks, dim, embed)
    return topk_pruned(q.select(F.col("anomaly_id").alias("query_id"), "embedding"), c.select("chunk_id", "embedding"), k=k)


def attach_context(flags: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags joined to their context, and the flags skipped for want of it."""
    keyed = flags.withColumn("anomaly_id", F.concat(F.date_format("month", "yyyyMM"), F.lit("-"), F.col("gl_account_id")))
    ctx = context.drop("gl_account_id")
    return keyed.join(ctx, "anomaly_id", "inner"), keyed.join(ctx, "anomaly_id", "left_anti")
