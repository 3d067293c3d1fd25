"""Token ids of many texts with the tokenizers library, piece by piece.

Neither vocabulary of this library joins characters across a blank or a line
end that stands between two non-blank characters, nor across the end of a run
of ASCII letters before ASCII punctuation other than the apostrophe.  So
texts are cut there; where the vocabulary has lower case only, capital ASCII
letters are made small first.  Equal pieces of a batch are found by sorting
(pieces of up to 16 bytes are compared as they are, longer ones by 128 bits of
hash), each distinct one is encoded once, and the ids are gathered back into
texts.  Distinct pieces are also remembered between batches; that memory is
bounded.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .textnum import Texts, mix, ranges, span_hashes

_SEPARATOR = "<|endoftext|>"
#: a word of Latin letters, perhaps after a blank
_LETTERS = re.compile(r" ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+\Z")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: bytes that are, or may begin, white space
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
STEP = 4_000_000


def cut_points(t: Texts) -> np.ndarray:
    """Positions where a piece begins, ascending: the starts of the texts that
    are not empty, and all safe places within them."""
    b = t.buf
    n = len(b)
    begin = t.starts[t.starts < t.ends]
    if not n:
        return begin
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    edge[n] = True
    at = np.flatnonzero((b == 32) | (b == 10))
    at = at[(at > 0) & (at < n - 1)]
    at = at[~edge[at] & ~edge[at + 1]]
    before = b[at - 1]
    late = before >= 0x80
    odd = late & ((b[np.maximum(at - 2, 0)] == 0xC2) | np.isin(b[np.maximum(at - 3, 0)], [0xE1, 0xE2, 0xE3]))
    safe = at[~(_MAY_BE_BLANK[before] & ~late) & ~odd & ~_MAY_BE_BLANK[b[at + 1]]]
    edge[safe] = True
    edge[safe[b[safe] == 10] + 1] = True
    marks = np.flatnonzero(_IS_MARK[b])
    marks = marks[marks > 0]
    edge[marks[_IS_LETTER[b[marks - 1]]]] = True
    return np.flatnonzero(edge[:n])


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself
    if it is printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def words16(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each piece that differ between different pieces
    of one length: its bytes themselves, or hashes if it has more than 16."""
    padded = np.concatenate([buf, np.zeros(32, np.uint8)])
    phases = [padded[k:k + (len(padded) - k) // 8 * 8].view("<u8") for k in range(8)]
    out = []
    for shift in (0, 8):
        at = s + shift
        n = np.clip(e - at, 0, 8)
        value = np.zeros(len(s), np.uint64)
        phase = at & 7
        for k in range(8):
            here = np.flatnonzero((phase == k) & (n > 0))
            value[here] = phases[k][at[here] >> 3]
        out.append(value & _LOW_BYTES[n])
    long = np.flatnonzero(e - s > 16)
    if len(long):
        out[0][long], out[1][long] = span_hashes(buf, s[long], e[long], 1, 2)
    return out[0], out[1]


class PieceEncoder:
    """``encode(texts)`` gives the ids of all texts in one uint32 array and
    the number of ids of each text; equal to
    ``Tokenizer.encode(text, add_special_tokens=False)``.  None counts as
    empty.  With ``special`` the strings of the vocabulary's special tokens
    give their ids, as in a tokenizer that is used as it is loaded; without,
    they are ordinary text."""

    def __init__(self, path: str, special: bool = False, max_pieces: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.path, self._loaded = path, None
        added = self.plain.get_added_tokens_decoder().values() if special else []
        if any(x.normalized for x in added):
            raise ValueError("special tokens that are looked for in normalised text are not supported")
        self.marks = [x.content.encode() for x in added]
        self.model = self.plain.model
        self.max_pieces, self.longest = max_pieces, longest
        #: ids of pieces: those used since the last change of generations, and those used in the one before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chars, self.lower = byte_characters(), False
        seen = [self._model_view(w) for w in (" Ab", " Éßñ")]
        self.lower = seen[0] == "ab"           # blanks dropped, lower case
        self.direct = seen == [self._mapped(" Ab"), self._mapped(" Éßñ")]

    def _model_view(self, text: str) -> str | None:
        """What the model is given for a text, if that is a single word."""
        if self.plain.normalizer is not None:
            text = self.plain.normalizer.normalize_str(text)
        words = [w for w, _ in self.plain.pre_tokenizer.pre_tokenize_str(text)]
        return words[0] if len(words) == 1 else None

    def _mapped(self, word: str) -> str:
        if self.lower:
            word = unicodedata.normalize("NFC", word.strip(" ")).lower()
        return word.encode().decode("latin-1").translate(self.chars)

    def one(self, text: str) -> bytes:
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if self.direct and _LETTERS.match(text) and "\u0130" not in text:      # a single word for the model
            return np.array([x.id for x in self.model.tokenize(self._mapped(text))], "<u4").tobytes()
        return self.one(text)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known, older = self.known, self.older
        got = [known.get(p) for p in pieces]
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    piece = pieces[k]
                    got[k] = ids = older.get(piece) or self._learn(piece)
                    if len(piece) <= self.longest:
                        known[piece] = ids
            if 2 * len(known) > self.max_pieces:       # pieces that are not used for a while are forgotten
                self.known, self.older = {}, known
        return got

    def _group(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of ids of each piece."""
        lo, hi = words16(buf, s, e)
        n = (e - s).astype(np.uint64)
        h = mix(lo + n * np.uint64(0x9E3779B97F4A7C15)) + mix(hi ^ np.uint64(0x5851F42D4C957F2D))
        order = np.argsort(h)
        hs = h[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        kind = np.empty(len(hs), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        same = first[kind]
        if not (np.array_equal(lo, lo[same]) and np.array_equal(hi, hi[same]) and np.array_equal(n, n[same])):
            first, kind = np.arange(len(s)), np.arange(len(s))        # two pieces with one sort key: all by themselves
        raw = buf.tobytes()
        ids = self._ids([raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        counts = sizes[kind]
        return flat[ranges((np.cumsum(sizes) - sizes)[kind], counts)], counts

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        t = texts if isinstance(texts, Texts) else Texts.of(texts)
        marked = self._marked(t)
        if not len(marked):
            return self._encode(t)
        # texts with a special token's string are left to the tokenizer itself
        out, counts = [], []
        for k, m in zip(np.append(0, marked + 1).tolist(), np.append(marked, len(t)).tolist(), strict=True):
            if m > k:
                lo, hi = int(t.starts[k]), int(t.ends[m - 1])
                ids, n = self._encode(Texts(t.buf[lo:hi], t.starts[k:m] - lo, t.ends[k:m] - lo))
                out.append(ids)
                counts.append(n)
            if m < len(t):
                text = t.buf[int(t.starts[m]):int(t.ends[m])].tobytes().decode()
                ids = np.asarray(self.loaded().encode(text, add_special_tokens=False).ids, "<u4")
                out.append(ids)
                counts.append(np.array([len(ids)], np.int64))
        return np.concatenate(out), np.concatenate(counts)

    def loaded(self):
        """The tokenizer as its file has it; few texts need it."""
        if self._loaded is None:
            from tokenizers import Tokenizer
            self._loaded = Tokenizer.from_file(self.path)
        return self._loaded

    def _marked(self, t: Texts) -> np.ndarray:
        """Numbers of the texts that hold the string of a special token."""
        raw, found = t.buf.tobytes() if self.marks else b"", []
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                k = int(t.owner(np.array([at]))[0])
                if at + len(mark) <= t.ends[k]:          # not across two texts
                    found.append(k)
                at = raw.find(mark, at + 1)
        return np.unique(np.array(found, np.int64))

    def _encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            t = Texts(_SMALL[t.buf], t.starts, t.ends)
        s = cut_points(t)
        e = np.append(s[1:], len(t.buf))
        if not len(s):
            return np.zeros(0, "<u4"), np.zeros(len(t), np.int64)
        out, counts = [], []
        k = 0
        while k < len(s):
            m = max(k + 1, int(np.searchsorted(e, s[k] + STEP, "right")))
            lo, hi = int(s[k]), int(e[m - 1])
            ids, n = self._group(t.buf[lo:hi], s[k:m] - lo, e[k:m] - lo)
            out.append(ids)
            counts.append(n)
            k = m
        per_text = np.bincount(t.owner(s), np.concatenate(counts), len(t)).astype(np.int64)
        return np.concatenate(out), per_text


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> PieceEncoder:
    """One encoder per Python worker, vocabulary file and treatment of special tokens."""
    return PieceEncoder(path, special)
