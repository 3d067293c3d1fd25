"""Quality rules, fingerprints and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, hard_rows, words

from ledgerlens.llm import chat, fingerprints, quality
from ledgerlens.llm.q_chat import FIRST_RESERVED, HARD_TEXT
from ledgerlens.llm.q_tokens import vocabulary
from ledgerlens.llm.textnum import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rows = hard_rows()
    r = random.Random(5)
    rows += [(500 + k, "".join(r.choice(["a", "b", " ", "\n", "é", "#", "\x0b", "a b a", " \r\n"]) for _ in range(r.randint(0, 200))), "en", "x")
             for k in range(300)]
    got = quality.text_counts(documents(spark, rows)).collect()
    have = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got)
    assert have == Counter((i, *brute_counts(t)) for i, t, *_ in rows)


def test_certified_is_the_exact_bound():
    for n, k, p in [(50, 0, .05), (200, 3, .04), (1000, 7, .02), (10, 10, .5), (400, 30, .05)]:
        cdf = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality.log_binomial_cdf(k, n, p)), cdf, rel_tol=1e-9)
        assert quality.is_certified(k, n, p, 0.05) == (k <= n * p and cdf <= 0.05)


def test_false_rejections_stay_within_the_limit():
    rng = np.random.default_rng(3)
    bad, runs = 0, 200
    for _ in range(runs):
        good = np.bincount(np.minimum(rng.geometric(0.05, 3000), quality.BINS), minlength=quality.BINS + 1)
        poor = np.bincount(np.minimum(rng.geometric(0.02, 600), quality.BINS), minlength=quality.BINS + 1)
        cut = quality.best_cutoff(good, poor, 0.02, 0.05, 1.0)
        if cut is not None:
            bad += (0.95 ** cut) > 0.02           # true share of good documents above the cutoff
    assert bad <= 0.05 * runs + 3 * math.sqrt(0.05 * runs)


def test_rules_reject_junk_and_keep_the_rest(spark):
    rows, labels = [], []
    for k in range(1500):
        junk = k % 5 == 0
        text = words(k, 80, 100_000)
        rows.append((k, " | ".join(text.split(" ")) if junk else text, "en", "a"))
        if k % 2:
            labels.append((k, int(not junk), 0))
    rows += [(5000 + k, words(k, 80, 100_000) + " ##" * 70, "fr", "a") for k in range(10)]       # a stratum without labels
    labels += [(None, 1, 0), (7, None, 0), (99_999, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features = quality.text_counts(documents(spark, rows))
    cuts = quality.cutoffs(quality.with_labels(features, marks))
    got = {r.doc_id: r.kept for r in quality.judge(features, cuts).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == (k % 5 != 0) for k in range(1500))
    assert all(got[5000 + k] for k in range(10))
    few = quality.cutoffs(quality.with_labels(features, marks.limit(20)))
    assert all(r.kept for r in quality.judge(features, few).collect())          # nothing certified, nothing rejected
    none = quality.text_counts(documents(spark, []))
    assert quality.judge(none, quality.cutoffs(quality.with_labels(none, marks))).collect() == []


def test_awkward_rows_are_judged(spark):
    features = quality.text_counts(documents(spark, hard_rows()))
    marks = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    got = quality.judge(features, quality.cutoffs(quality.with_labels(features, marks))).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def brute_likeness(a, b):
    sets = []
    for t in (a, b):
        keys, _ = fingerprints.unit_digests(Texts.of([t]))
        sets.append(set(keys.tolist()))
        assert len(sets[-1]) == len(keys)
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 1.0


@pytest.mark.parametrize("n_ranges", [1, 2, 5, 40])
def test_fingerprints(spark, n_ranges):
    rows = [r for r in hard_rows() if r[0] != 12] + [(12, words(4, 90), "en", "hot")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents(spark, rows), ranges=n_ranges).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r.near_edited, brute_likeness(text, edited))
        assert math.isclose(r.near_next, brute_likeness(text, after))
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1.0
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[1].near_next == 1.0 and got[2].near_next > 0.7


def test_fingerprints_of_tiny_tables(spark):
    assert fingerprints.fingerprint_edits(documents(spark, [])).collect() == []
    one = fingerprints.fingerprint_edits(documents(spark, [(3, "a b c d", "en", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    repeated = fingerprints.fingerprint_edits(documents(spark, [(3, "a b", "en", "a")] * 4)).collect()
    assert len(repeated) == 4 and all(r.near_next == 1.0 for r in repeated)


@pytest.mark.parametrize("texts", [
    (words(7, 300), words(7, 290) + " " + words(8, 20)), (words(1, 2000), words(2, 2000)), (words(1, 5), words(2, 9000)), ("", words(3, 700)), ("", ""),
    ("a b c", "a b c")])
def test_differing_digests_are_recovered(texts):
    """From the fingerprints alone, whatever the sizes of the texts."""
    keys, owner = fingerprints.unit_digests(Texts.of(list(texts)))
    (a, b), sizes = fingerprints.fingerprints_of(fingerprints._csr(keys, owner, 2), 2)
    near, more, less = fingerprints.compare(a, b)
    one, two = set(keys[owner == 0].tolist()), set(keys[owner == 1].tolist())
    assert (set(more), set(less)) == (one - two, two - one)
    assert math.isclose(near, len(one & two) / len(one | two) if one | two else 1.0)
    for text, own in ((a, one), (b, two)):
        assert set(fingerprints.Tables.of_text(text)[0].digests().tolist()) == own


def test_given_fingerprints_have_the_given_likeness(spark):
    """All documents of a table, each compared by what the query returns."""
    rows = fingerprints.fingerprint_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).orderBy("doc_id").collect()
    assert len(rows) == 200
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert math.isclose(fingerprints.compare(r.fingerprint, r.edited_fingerprint)[0], r.near_edited)
        assert math.isclose(fingerprints.compare(r.fingerprint, after.fingerprint)[0], r.near_next)


def digests(turns):
    """Expected row of one conversation: turns in order as (role, text)."""
    alltext = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    chars = sum(len(f"### {chat.escape(r or '')}:\n{chat.escape(t or '')}</turn>\n") for r, t in turns)
    return (len(turns), hashlib.sha256(alltext.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)


@pytest.mark.parametrize("part_tokens", [1, 500_000])
def test_chat_round_trip(spark, part_tokens):
    texts = [HARD_TEXT, None, "", "\\", "\\\\### x\\", "</turn></turn>", "<|endoftext|>", "####  a", "<\\/turn>", "é\U0001f600\n\n \t", words(3, 4000)]
    r = random.Random(4)
    rows = [(c, k, r.choice(["user", "assistant", "system", None, "### tool"]), r.choice(texts)) for c in range(12) for k in range(r.randint(1, 9))]
    rows += [(50, k // 2, "assistant", f"t{k}") for k in range(3000)]              # one long conversation, ties in turn
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (60, 1, "user", "same"), (60, 1, "user", "same")]
    turns = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, part int, ids string").repartition(4)
    path = vocabulary("byte_bpe_50k.json")
    formatted = chat.format_conversations(turns, path, FIRST_RESERVED, part_tokens=part_tokens)
    got = {x.conv_id: tuple(x)[1:] for x in chat.conversation_digests(formatted, path, FIRST_RESERVED).collect()}
    want = {}
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        want[c] = digests([(x[2], x[3]) for x in own])
    assert got == want
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0), path, FIRST_RESERVED), path, FIRST_RESERVED).collect() == []


def test_escape_leaves_no_control_string():
    r = random.Random(1)
    parts = ["\\", "#", "##", "### ", " ", "<", "/", "</turn>", "turn>", "a"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and "### " not in e and "</turn>" not in e
