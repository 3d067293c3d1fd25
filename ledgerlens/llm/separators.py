"""Token counts (operator 8): separator scan over flat token files.

A flat file is nothing but 16-bit little-endian ids; the end-of-document id
parts the documents and there is no index.  Files are read as records of
``block`` bytes, so a task reads its byte range of a file of any length.  Each
block is searched for the separator in one vectorised comparison of its
aligned 16-bit words.  Documents that lie within a block are told there; of
the others each block gives its pieces: what comes before its first separator
and what comes behind its last.  A prefix scan over the blocks' numbers of
separators then numbers the documents, and pieces with the same number are put
together.  Blocks are summed where they lie, so the scan works on one row a
task.

:func:`write_flat_files` makes such files from texts.  So that counts can be
led back to documents, it puts the document id in front of each document as
``HEADER`` words of 13 bits, which can't be mistaken for the separator; and it
fills each file up to whole blocks with a last document of padding words.

Defined results: a null text has no ids; a null id is kept as such; repeated
rows are documents of their own; ids behind the last separator of a folder
count as a document; an empty folder has none; documents of padding are left
out; other columns are not read.  A file whose length is no multiple of
``block`` fails the read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_totals, stored
from .textnum import Texts, ranges, return_memory
from .token_files import ENCODED, groups
from .tokenizer import encoder

HEADER = 5
_NULL, _PAD = 0x7FFF, 0x7FFE
#: bytes of a block
BLOCK = 1 << 18


def _headers(ids: pa.Array) -> np.ndarray:
    """HEADER words for each document id, most significant first."""
    known = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    words = np.stack([(known >> np.uint64(13 * k)) & np.uint64(0x1FFF) for k in range(HEADER - 1, -1, -1)], 1).astype("<u2")
    words[np.asarray(ids.is_null()), 0] = _NULL
    return words


def _encode(path: str, block: int):
    def run(batches):
        enc, size = encoder(path), 0
        for batch in batches:
            for k, m, t in groups(Texts.of(batch.column(1)), ENCODED):
                ids, n = enc.encode(t)
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("the vocabulary has ids that do not fit in 16 bits")
                out = np.empty(len(ids) + HEADER * (m - k), "<u2")
                ends = np.cumsum(n + HEADER)
                out[ranges(ends - n, n)] = ids
                head = ranges(ends - n - HEADER, np.full(m - k, HEADER))
                out[head] = _headers(batch.column(0).slice(k, m - k)).ravel()
                size += 2 * (len(out) + m - k)
                yield _raw(np.append(0, ends * 2), out)
            return_memory()
        if size % block:
            # its own separator counts as well
            words = (block - size % block) // 2 - 1
            yield _raw(np.array([0, 2 * words]), np.full(words, _PAD, "<u2"))
    return run


def _raw(offsets: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())], ["raw"])


def write_flat_files(docs: DataFrame, path: str, tokenizer_path: str, separator: int, id_col: str = "doc_id",
                     text_col: str = "text", block: int = BLOCK) -> None:
    """Header words, ids and the separator of each document, one after the
    other, a file for each partition of ``docs``.  The text writer puts out
    bytes as they are, and its line separator is the two bytes of the
    end-of-document id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    (rows.mapInArrow(_encode(tokenizer_path, block), "raw binary").select(F.col("raw").cast("string").alias("value")).write
     .option("lineSep", separator.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def search_block(words: np.ndarray, separator: int, header: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]:
    """Of one block: the places where its inner documents begin, their numbers
    of words, and its pieces as (separators of the block before it, words,
    its first words)."""
    at = np.flatnonzero(words == separator)
    if not len(at):
        return at, at, [(0, len(words), words[:header].tobytes())]
    pieces = [(0, int(at[0]), words[:min(header, at[0])].tobytes()), (len(at), len(words) - int(at[-1]) - 1, words[at[-1] + 1:at[-1] + 1 + header].tobytes())]
    return at[:-1] + 1, np.diff(at) - 1, pieces


def _ids(words: np.ndarray, begin: np.ndarray, n: np.ndarray, header: int) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and 0 for an id, 1 for none, 2 for padding."""
    kind, value = np.ones(len(begin), np.int64), np.zeros(len(begin), np.int64)
    if header:
        padded = (n > 0) & (words[np.minimum(begin, len(words) - 1)] == _PAD)
        there = np.flatnonzero(n >= header)
        head = words[begin[there][:, None] + np.arange(header)].astype(np.int64)
        value[there] = (head & 0x1FFF) @ (np.int64(1) << 13 * np.arange(header - 1, -1, -1, dtype=np.int64))
        kind[there[head[:, 0] != _NULL]] = 0
        kind[padded] = 2
    return value, kind


_FOUND = "part int, block long, nth long, doc_id long, n_words long, seps long, head binary"


def _search(separator: int, header: int):
    def run(part, records):
        for k, record in enumerate(records):
            words = np.frombuffer(record, "<u2")
            begin, n, pieces = search_block(words, separator, header)
            value, kind = _ids(words, begin, n, header)
            for j in np.flatnonzero(kind < 2).tolist():
                yield part, k, j + 1, int(value[j]) if kind[j] == 0 else None, int(n[j]), None, None
            for nth, length, head in pieces:
                # the block's number of separators goes with its first piece
                yield part, k, nth, None, length, (len(begin) + 1 if len(pieces) > 1 else 0) if nth == 0 else 0, bytearray(head)
    return run


def count_documents(spark: SparkSession, path: str, separator: int, header: int = HEADER, block: int = BLOCK) -> DataFrame:
    """Per document of the files in ``path``: ordinal (over all files, in
    the order they are read), doc_id (null without header) and n_tokens
    (without header and separator)."""
    records = spark.sparkContext.binaryRecords(path, block)
    found = stored(spark.createDataFrame(records.mapPartitionsWithIndex(_search(separator, header)), _FOUND), "flat_found")
    pieces = found.where("seps IS NOT NULL")
    blocks = pieces.groupBy("part", "block").agg(F.sum("seps").alias("seps"))
    before = running_totals(blocks, [], [F.col("part"), F.col("block")], {"before": F.col("seps")}, "flat_blocks").drop("seps")
    inner = found.where("seps IS NULL").join(before, ["part", "block"]).select(
        (F.col("before") + F.col("nth")).alias("ordinal"), "doc_id", (F.col("n_words") - header).alias("n_tokens"))
    # pieces in order; few are needed for the first words of a document
    across = pieces.join(before, ["part", "block"]).groupBy((F.col("before") + F.col("nth")).alias("ordinal")).agg(
        F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("part", "block", "nth", "head"))).alias("heads"))
    some = F.slice(F.filter("heads", lambda x: F.octet_length(x["head"]) > 0), 1, header + 1)
    head = F.substring(F.aggregate(some, F.lit(b""), lambda a, x: F.concat(a, x["head"])), 1, 2 * max(header, 1))

    def word(k: int):
        low, high = (F.conv(F.hex(F.substring(head, 2 * k + j, 1)), 16, 10).cast("long") for j in (1, 2))
        return low + high * 256
    doc_id = F.lit(None).cast("long")
    if header:
        value = F.lit(0).cast("long")
        for k in range(header):
            value = F.shiftleft(value, 13).bitwiseOR(word(k).bitwiseAND(F.lit(0x1FFF)))
        doc_id = F.when((F.col("n_words") >= header) & (word(0) != _NULL), value)
        across = across.where(F.coalesce(word(0) != _PAD, F.lit(True)))
    # nothing behind the last separator is no document
    total = blocks.agg(F.sum("seps")).first()[0] or 0
    across = across.where((F.col("ordinal") < total) | (F.col("n_words") > 0))
    return inner.unionByName(across.select("ordinal", doc_id.alias("doc_id"), (F.col("n_words") - header).alias("n_tokens")))
