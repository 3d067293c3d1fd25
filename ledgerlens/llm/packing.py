"""Packing (operator 3): bounded-space online packing of token sequences.

Each task reads its documents once and keeps at most ``open_windows`` open
windows.  A document's ids are cut into full windows; the rest is placed in
the open window that it fits best.  If it fits none, the fullest window is
emitted: as it is when at most ``max_gap`` places are free, else filled up by
a cut of the piece.  What is open at the end of a task is merged in rounds
over ever fewer tasks by the same rule, and the last task joins the rest end
to end.  So memory is bounded by ``open_windows`` times the window in every
task, and no document is ever gathered.

A window that is not full is padded to the window's length, except where its
fill is a power of two: the ids left at the very end are cut into powers of
two, so they need no padding.

Defined results: a null text is empty and becomes its end id alone; equal
rows are packed as often as they occur; a null id stays null; an empty table
gives no sequence; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textnum import Texts, return_memory
from .token_files import ENCODED, groups, with_end
from .tokenizer import encoder

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("task", pa.int64()), ("open", pa.bool_()), ("fill", pa.int32()),
                     ("padded", pa.int32()), ("pieces", pa.list_(_PIECE)), ("ids", pa.binary())])
SCHEMA = ("sequence_id long, task long, open boolean, fill int, padded int, "
          "pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long>>, ids binary")


class _Out:
    """Rows of sequences, given out as Arrow batches of a few megabytes."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id, self.task = window, first_id, TaskContext.get().partitionId()
        self.rows: list[tuple] = []
        self.n = 0

    def add(self, pieces: list[tuple], is_open: bool = False) -> None:
        """pieces: (doc_id, start, ids as bytes, doc_tokens)."""
        ids = b"".join([p[2] for p in pieces])
        fill = len(ids) // 4
        padded = fill if fill & (fill - 1) == 0 else self.window
        self.rows.append((self.next_id, self.task, is_open, fill, padded,
                          [(d, s, len(b) // 4, n) for d, s, b, n in pieces], ids))
        self.next_id += 1
        self.n += len(ids)

    def batch(self, least: int = 4_000_000):
        if self.rows and self.n >= least:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _SCHEMA, strict=True)]
            self.rows, self.n = [], 0
            yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


class _Windows:
    """At most ``most`` open windows, sorted by fill."""

    def __init__(self, out: _Out, window: int, most: int, max_gap: int):
        self.out, self.window, self.most, self.max_gap = out, window, most, max_gap
        self.fill: list[int] = []
        self.pieces: list[list[tuple]] = []

    def _put(self, fill: int, pieces: list[tuple]) -> None:
        if fill == self.window:
            self.out.add(pieces)
            return
        k = bisect.bisect_left(self.fill, fill)
        self.fill.insert(k, fill)
        self.pieces.insert(k, pieces)

    def place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        while ids:
            n = len(ids) // 4
            k = bisect.bisect_right(self.fill, self.window - n) - 1      # the fullest window with room for it
            if k >= 0:
                fill, pieces = self.fill.pop(k), self.pieces.pop(k)
                self._put(fill + n, [*pieces, (doc_id, start, ids, doc_tokens)])
                return
            if len(self.fill) < self.most:
                self._put(n, [(doc_id, start, ids, doc_tokens)])
                return
            fill, pieces = self.fill.pop(), self.pieces.pop()
            gap = self.window - fill
            if gap > self.max_gap:
                pieces = [*pieces, (doc_id, start, ids[:4 * gap], doc_tokens)]
                start, ids = start + gap, ids[4 * gap:]
            self.out.add(pieces)

    def place_document(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        full = len(ids) // step
        for k in range(full):
            self.out.add([(doc_id, k * self.window, ids[k * step:(k + 1) * step], total)])
        self.place(doc_id, full * self.window, ids[full * step:], total)

    def leave_open(self) -> None:
        for pieces in self.pieces:
            self.out.add(pieces, is_open=True)

    def join_rest(self) -> None:
        """All open windows end to end, cut at the window and, at the end, into powers of two."""
        left = sum(self.fill)
        room, row = 0, []
        for d, s, ids, n in [p for pieces in self.pieces for p in pieces]:
            while ids:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) // 4)
                row.append((d, s, ids[:4 * take], n))
                s, ids, room = s + take, ids[4 * take:], room - take
                if not room:
                    self.out.add(row)
                    row = []


def _pack(path: str, end_id: int, window: int, most: int, max_gap: int):
    def run(batches):
        out = _Out(window, TaskContext.get().partitionId() << 32)
        windows = _Windows(out, window, most, max_gap)
        enc = encoder(path, special=True)
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for k, m, t in groups(Texts.of(batch.column(1)), ENCODED):
                ids, n = with_end(*enc.encode(t), end_id)
                raw, ends = ids.tobytes(), np.cumsum(n)
                for d, a, b in zip(doc[k:m], (ends - n).tolist(), ends.tolist(), strict=True):
                    windows.place_document(d, raw[4 * a:4 * b])
                    yield from out.batch()
            return_memory()
        windows.leave_open()
        yield from out.batch(0)
    return run


def _merge(level: int, last: bool, window: int, most: int, max_gap: int):
    def run(batches):
        out = _Out(window, (level << 56) | (TaskContext.get().partitionId() << 32))
        windows = _Windows(out, window, most, max_gap)
        for batch in batches:
            for pieces, ids in zip(batch.column("pieces").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                at = 0
                for p in pieces:
                    b = ids[at:at + 4 * p["length"]]
                    at += len(b)
                    windows.place(p["doc_id"], p["start"], b, p["doc_tokens"])
                yield from out.batch()
        if last:
            windows.join_rest()
        else:
            windows.leave_open()
        yield from out.batch(0)
    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, open_windows: int = 64,
         max_gap: int = 24, fan_in: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``window`` ids: sequence_id, fill, padded (the
    length with padding), pieces (doc_id, start, length, doc_tokens, in the
    order in which they lie there without gaps), ids (little-endian uint32).

    Windows left open by ``fan_in`` tasks meet in one task of the next round;
    a task therefore reads ``fan_in * open_windows`` windows at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = stored(rows.mapInArrow(_pack(tokenizer_path, end_id, window, open_windows, max_gap), SCHEMA), "packed")
    done = [packed.where(~F.col("open"))]
    rest = packed.where("open")
    tasks = rest.agg(F.max("task")).first()[0]
    level = 0
    while tasks is not None:
        level += 1
        tasks = tasks // fan_in
        dealt = rest.repartitionById(tasks + 1, (F.col("task") / fan_in).cast("int"))
        merged = stored(dealt.sortWithinPartitions("sequence_id").mapInArrow(
            _merge(level, tasks == 0, window, open_windows, max_gap), SCHEMA), "merged")
        done.append(merged.where(~F.col("open")))
        rest = merged.where("open")
        if tasks == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", "fill", "padded", "pieces", "ids")


def _pieces(batches):
    for batch in batches:
        out: list[tuple] = []
        for sequence, pieces, ids in zip(batch.column("sequence_id").to_pylist(), batch.column("pieces").to_pylist(),
                                         batch.column("ids").to_pylist(), strict=True):
            at, raw = 0, memoryview(ids)
            for p in pieces:
                crc = zlib.crc32(raw[4 * at:4 * (at + p["length"])])
                out.append((p["doc_id"], p["start"], p["length"], crc, p["doc_tokens"], sequence, at))
                at += p["length"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, read from the packed sequences."""
    return sequences.select("sequence_id", "pieces", "ids").mapInArrow(
        _pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
