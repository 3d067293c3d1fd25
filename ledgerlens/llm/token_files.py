"""Token-id output (operator 2): ORC files of whole documents' ids.

Documents are range-partitioned by id and sorted, so the files, in the order
of their part number, hold the documents in ascending id order.  ORC writes
the ids as run-length encoded integers in stripes, keeps minimum and maximum
of every column per stripe and row group (row index) and a Bloom filter of
the document ids, so a lookup of some ids skips stripes by metadata and a
full read runs stripe by stripe in parallel.

Defined results: a null text is an empty one (its ids are the end id alone);
a null id sorts first; rows with equal ids are all kept, ordered by text;
an empty table gives an empty folder of valid files; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textnum import Texts, ranges, return_memory
from .tokenizer import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: rows, one per file, that are broadcast at most
MAX_BROADCAST = 1_000_000
#: texts of one Arrow batch are encoded and sent on in groups of so many bytes
GROUP = 2_000_000
#: and of so many where they are encoded, as larger groups have fewer distinct pieces
ENCODED = 4_000_000


def groups(t: Texts, size: int = GROUP) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive texts with about ``size`` bytes (one text at least)."""
    k = 0
    while k < len(t):
        m = max(k + 1, int(np.searchsorted(t.ends, t.starts[k] + size, "right")))
        lo, hi = int(t.starts[k]), int(t.ends[m - 1])
        yield k, m, Texts(t.buf[lo:hi], t.starts[k:m] - lo, t.ends[k:m] - lo)
        k = m


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new counts."""
    out = np.full(len(ids) + len(counts), end_id, "<u4")
    ends = np.cumsum(counts + 1)
    out[ranges(ends - counts - 1, counts)] = ids
    return out, counts + 1


def _encode_parts(path: str, end_id: int):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        enc = encoder(path, special=True)
        for batch in batches:
            doc = batch.column(0)
            for k, m, t in groups(Texts.of(batch.column(1)), ENCODED):
                ids, n = with_end(*enc.encode(t), end_id)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(k, m - k), pa.array(np.full(m - k, part, np.int32)), pa.array(start + ends - n),
                     pa.array(n), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                                           pa.array(ids.view(np.int32)))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])
            return_memory()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Encode every whole text, append ``end_id`` and write ORC files to
    ``path`` in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    (ordered.mapInArrow(_encode_parts(tokenizer_path, end_id), SCHEMA).write
     .option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", index_stride).option("orc.create.index", True)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.  With
    ``doc_ids`` only those: the predicate reaches the ORC reader, which skips
    stripes and row groups by their index and Bloom filter.

    ``start`` is the place within the file plus the ids of all earlier files,
    one row per file."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    few = parts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST      # else a plain join
    return rows.join(F.broadcast(offsets) if few else offsets, "part").select(
        "doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        if not len(lists):
            continue
        off = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)
        raw = memoryview(np.asarray(lists.values).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(off).astype(np.int64)),
             pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per document of :func:`read_token_files`: doc_id, start, n_tokens as
    counted from the ids, and the crc32 of the ids (little-endian uint32)."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
