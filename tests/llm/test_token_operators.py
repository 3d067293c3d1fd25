"""Token files, packing and separator counts against direct encoding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, hard_rows

from ledgerlens.llm import packing, separators, token_files
from ledgerlens.llm.q_tokens import vocabulary
from ledgerlens.llm.tokenizer import PieceEncoder
from ledgerlens.session import scratch_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, special=False):
    """The tokenizer as it is loaded (special), or with special strings as ordinary text."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary(name))
    if not special:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_same_ids_as_whole_texts(name):
    r = random.Random(2)
    parts = ["a", "b", "Zed", " ", " ", "\n", "\t", "'s", "é", "<|endoftext|>", "1", "!", "\u00a0", "\u0301", "Σ", "\u2003", "  ", "'ll",
             "#", ",", "b.", "\u2028", "\x1c", "\x85", "\x0b", "\u3000", "à", "\u0958", "İ", "中"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)] + [None, ""]
    small = PieceEncoder(vocabulary(name), max_pieces=50)     # forgets all the time
    encode = plain(name)
    for enc in (PieceEncoder(vocabulary(name)), small):
        for lo in range(0, len(texts), 500):
            ids, n = enc.encode(texts[lo:lo + 500])
            at = 0
            for text, k in zip(texts[lo:lo + 500], n.tolist(), strict=True):
                assert ids[at:at + k].tolist() == encode(text), repr(text)
                at += k


def test_special_strings_give_their_ids():
    for name in NAMES:
        want, enc = plain(name, special=True), PieceEncoder(vocabulary(name), special=True)
        texts = ["a<|endoftext|>b", "plain", None, "<|endoftext|>", "<|endoftext|> <|startoftext|><|endoftext|>", "<|endo", "ftext|>", "", "é <|ENDOFTEXT|>"]
        for some in (texts, texts[1:3], texts[5:], texts[:1]):
            ids, n = enc.encode(some)
            assert n.tolist() == [len(want(t)) for t in some]
            assert ids.tolist() == [i for t in some for i in want(t)]


def test_token_files(spark):
    rows = hard_rows()
    path = scratch_path(spark, "t_tokens")
    token_files.write_token_files(documents(spark, rows), path, vocabulary(NAMES[1]), end_id=2)
    got = token_files.token_digests(token_files.read_token_files(spark, path)).collect()
    encode = plain(NAMES[1], special=True)
    at, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*encode(text), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = token_files.read_token_files(spark, path, doc_ids=[9, 12, 777]).collect()
    assert sorted(r.doc_id for r in some) == [9, 12, 12]
    assert {r.start for r in some} <= {w[1] for w in want if w[0] in (9, 12)}
    plan = token_files.read_token_files(spark, path, doc_ids=[9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_token_files_of_an_empty_table(spark):
    path = scratch_path(spark, "t_tokens")
    token_files.write_token_files(documents(spark, []), path, vocabulary(NAMES[1]), end_id=2)
    assert token_files.token_digests(token_files.read_token_files(spark, path)).collect() == []


def check_packing(rows, sequences, window):
    """Every id of every row in one piece; returns pad ids over all ids."""
    encode = plain(NAMES[0], special=True)
    full = [[*encode(text), 1] for _, text, *_ in rows]
    spans = defaultdict(list)
    pad = total = 0
    for s in sequences:
        ids = [int.from_bytes(s.ids[k:k + 4], "little") for k in range(0, len(s.ids), 4)]
        assert 0 < len(ids) == s.fill <= window
        assert s.padded == (s.fill if s.fill & (s.fill - 1) == 0 else window)
        pad, total, at = pad + s.padded - s.fill, total + s.fill, 0
        for p in s.pieces:
            spans[(p.doc_id, p.doc_tokens)].append((p.start, tuple(ids[at:at + p.length])))
            at += p.length
        assert at == len(ids)
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    want = defaultdict(Counter)
    for (i, *_), ids in zip(rows, full, strict=True):
        want[(i, len(ids))].update(enumerate(ids))
    assert set(spans) == set(want)
    for k, pieces in spans.items():
        got = Counter()
        for start, ids in pieces:
            got.update(enumerate(ids, start))
        assert got == want[k]
    return pad / max(1, total)


@pytest.mark.parametrize("parts,open_windows,fan_in", [(1, 4, 2), (5, 3, 2), (3, 64, 32)])
def test_packing(spark, parts, open_windows, fan_in):
    rows = hard_rows()
    got = packing.pack(documents(spark, rows, parts), vocabulary(NAMES[0]), 1, window=256, open_windows=open_windows,
                       max_gap=8, fan_in=fan_in).collect()
    assert check_packing(rows, got, 256) < 0.03


def test_packing_digests_and_empty_table(spark):
    empty = packing.pack(documents(spark, []), vocabulary(NAMES[0]), 1)
    assert packing.piece_digests(empty).collect() == []
    rows = hard_rows()
    got = packing.piece_digests(packing.pack(documents(spark, rows), vocabulary(NAMES[0]), 1)).collect()
    encode = plain(NAMES[0], special=True)
    ids = {i: [*encode(t), 1] for i, t, *_ in rows}
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (crc(piece), len(ids[r.doc_id]))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_separator_counts(spark, block):
    rows = hard_rows()
    path = scratch_path(spark, "t_flat")
    separators.write_flat_files(documents(spark, rows), path, vocabulary(NAMES[1]), 49407, block=block)
    got = separators.count_documents(spark, path, 49407, block=block).collect()
    encode = plain(NAMES[1])
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(encode(t))) for i, t, *_ in rows)
    assert len({r.ordinal for r in got}) == len(got)


def test_separator_counts_without_header_and_with_an_open_end(spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 9, 1, 2, 3, separators._PAD, 9, 4]
    (tmp_path / "x.bin").write_bytes(b"".join(i.to_bytes(2, "little") for i in ids))
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (2, 4, 6, 24):
        got = separators.count_documents(spark, str(tmp_path), 9, header=0, block=block).collect()
        assert sorted((r.ordinal, r.n_tokens, r.doc_id) for r in got) == [(0, 2, None), (1, 0, None), (2, 1, None), (3, 4, None), (4, 1, None)]
    with pytest.raises(Exception, match="(?i)partial record|multiple|length"):
        separators.count_documents(spark, str(tmp_path), 9, header=0, block=10).collect()
    path = scratch_path(spark, "t_flat")
    separators.write_flat_files(documents(spark, []), path, vocabulary(NAMES[1]), 49407)
    assert separators.count_documents(spark, path, 49407).collect() == []


@pytest.mark.parametrize("separator,block", [(49407, 64), (9, 64), (0x0909, 4096), (49407, 12000 + 2)])
def test_separator_counts_of_one_file(spark, tmp_path, separator, block):
    """Bytes that look like a separator across two ids; documents over many blocks."""
    r, low, high = random.Random(4), separator & 255, separator >> 8
    odd = [low << 8 | 1, 0x0100 | high, low << 8 | high if low != high else 1, 7, separator]
    ids = [r.choice(odd) for _ in range(4000)] + [7] * 1500 + [separator] + [r.choice(odd) for _ in range(498)] + [separator, 3]
    ids += [7] * (-len(ids) % (block // 2))
    (tmp_path / "one.bin").write_bytes(b"".join(i.to_bytes(2, "little") for i in ids))
    ends = [k for k, i in enumerate(ids) if i == separator] + [len(ids)]
    want = [(k, e - b - 1) for k, (b, e) in enumerate(zip([-1, *ends], ends))]
    got = separators.count_documents(spark, str(tmp_path), separator, header=0, block=block).collect()
    assert sorted((d.ordinal, d.n_tokens) for d in got) == want


def test_search_of_a_block():
    words = np.array([4, 9, 5, 6, 9, 9, 7], "<u2")
    begin, n, pieces = separators.search_block(words, 9, 2)
    assert (begin.tolist(), n.tolist()) == ([2, 5], [2, 0])
    assert pieces == [(0, 1, words[:1].tobytes()), (3, 1, words[6:].tobytes())]
    assert separators.search_block(words[2:4], 9, 1)[2] == [(0, 2, words[2:3].tobytes())]
