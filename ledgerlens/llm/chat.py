"""Chat formatting (operator 9): token-level assembly of conversations.

Every segment (role, escaped text) is encoded by itself with a byte-level
vocabulary, and ids reserved beyond that vocabulary are spliced in between:

    TURN  role ids  SEP  text ids  END        for each turn

No text can produce those ids, whatever it contains.  In the rendered form
the reserved ids read ``### ``, ``:\\n`` and ``</turn>\\n``; so that this form
can be taken apart again too, control strings in a text are broken by a
backslash after their first character, and a backslash is doubled.  The loss
mask is the prefix sum of +1 at the first text id of a turn that is learnt
and -1 behind its END.

Turns are escaped and encoded where they lie.  Their ids are then sorted by
conversation and turn within hash partitions and streamed; a conversation with
many turns is given out in parts of about ``part_tokens`` ids, so none has to
fit in memory.

Defined results: a null text or role is an empty one; null turns come first;
turns with equal numbers are kept, ordered by role and text; rows with a null
conversation form one conversation; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import ranges, return_memory
from .tokenizer import encoder

#: what the reserved ids stand for in the rendered form
TURN, SEP, END = "### ", ":\n", "</turn>\n"
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)

SCHEMA = "conv_id long, part int, n_turns int, ids array<int>, loss_mask array<byte>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()),
                    ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])


def escape(text: str) -> str:
    """No control string is left in the result, and :func:`unescape` gives the text back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_TURN = "conv_id long, turn long, role string, text string, ids array<int>, learnt int"


def _encode_turns(path: str, first_reserved: int, learnt: frozenset):
    """The ids of each turn by itself, and where its learnt ids begin (-1: nowhere)."""
    turn, sep, end = first_reserved, first_reserved + 1, first_reserved + 2

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                role = some.column(2).to_pylist()
                role_ids, role_n = enc.encode([escape(r or "") for r in role])
                text_ids, text_n = enc.encode([escape(t or "") for t in some.column(3).to_pylist()])
                stop = np.cumsum(role_n + text_n + 3)
                begin = stop - (role_n + text_n + 3)
                ids = np.empty(int(stop[-1]), np.int32)
                ids[begin], ids[begin + 1 + role_n], ids[stop - 1] = turn, sep, end
                ids[ranges(begin + 1, role_n)] = role_ids
                ids[ranges(begin + 2 + role_n, text_n)] = text_ids
                first = np.where(np.array([r in learnt for r in role]), 2 + role_n, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids)), pa.array(first)],
                    [*some.schema.names, "ids", "learnt"])
            return_memory()
    return run


def _join_turns(part_tokens: int):
    """Turns in order to conversations, or parts of them."""
    def run(batches):
        pending: list[np.ndarray] = []       # ids of turns of the conversation that is open
        firsts: list[int] = []
        current, part, size, started = None, 0, 0, False

        def row():
            ids, n = np.concatenate(pending), np.array([len(p) for p in pending])
            stop, first = np.cumsum(n), np.array(firsts)
            step, wanted = np.zeros(len(ids) + 1, np.int32), first >= 0
            np.add.at(step, (stop - n + first)[wanted], 1)
            np.add.at(step, stop[wanted], -1)
            return current, part, len(pending), ids, np.cumsum(step[:-1]).astype(np.int8)

        for batch in batches:
            out: list[tuple] = []
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (c, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if started and (c != current or size >= part_tokens):
                    out.append(row())
                    part = part + 1 if c == current else 0
                    pending, firsts, size = [], [], 0
                current, started = c, True
                # a part may outlive its batch
                pending.append(flat[at[k]:at[k + 1]].copy())
                firsts.append(first)
                size += len(pending[-1])
            if out:
                yield _batch(out)
        if pending:
            yield _batch([row()])
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    off = pa.array(np.append(0, np.cumsum([len(r[3]) for r in rows])).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.int32()),
         pa.ListArray.from_arrays(off, pa.array(np.concatenate([r[3] for r in rows]))),
         pa.ListArray.from_arrays(off, pa.array(np.concatenate([r[4] for r in rows])))], schema=_ARROW)


def format_conversations(turns: DataFrame, tokenizer_path: str, first_reserved: int,
                         learnt_roles: Sequence[str] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", part_tokens: int = 500_000) -> DataFrame:
    """conv_id, part, n_turns, ids, loss_mask.  A conversation's parts lie in
    one partition, one after the other.  ``first_reserved`` is the first of
    three ids that the vocabulary does not use."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # turns are encoded where they lie, so a conversation of any length is not one task's work
    encoded = rows.mapInArrow(_encode_turns(tokenizer_path, first_reserved, frozenset(learnt_roles)), _TURN)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "learnt").mapInArrow(_join_turns(part_tokens), SCHEMA)


class _Digest:
    """What is read back of one conversation, part after part."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self, conv):
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(path: str, first_reserved: int):
    turn, sep, end = first_reserved, first_reserved + 1, first_reserved + 2

    def run(batches):
        decode = encoder(path).plain.decode
        current, digest = None, None
        for batch in batches:
            out = []
            for conv, ids, mask in zip(*(batch.column(k) for k in ("conv_id", "ids", "loss_mask")), strict=True):
                conv = conv.as_py()
                ids, mask = np.asarray(ids.values), np.asarray(mask.values)
                if digest is None or conv != current:
                    if digest is not None:
                        out.append(digest.row(current))
                    current, digest = conv, _Digest()
                for a, m, b in zip(np.flatnonzero(ids == turn).tolist(), np.flatnonzero(ids == sep).tolist(),
                                   np.flatnonzero(ids == end).tolist(), strict=True):
                    role = decode(ids[a + 1:m].tolist(), skip_special_tokens=False)
                    text = decode(ids[m + 1:b].tolist(), skip_special_tokens=False)
                    digest.turns += 1
                    digest.chars += len(TURN) + len(role) + len(SEP) + len(text) + len(END)
                    digest.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    learnt = ids[m + 1:b][mask[m + 1:b] > 0]
                    if len(learnt):
                        part = unescape(decode(learnt.tolist(), skip_special_tokens=False))
                        digest.loss_chars += len(part)
                        digest.loss.update(part.encode())
            if out:
                yield _rows(out)
        if digest is not None:
            yield _rows([digest.row(current)])
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                      ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digests(formatted: DataFrame, tokenizer_path: str, first_reserved: int) -> DataFrame:
    """Read the output of :func:`format_conversations` back: the turns, the
    text under the loss mask, and the length of the rendered form."""
    return formatted.mapInArrow(
        _read_back(tokenizer_path, first_reserved),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
