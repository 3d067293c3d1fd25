"""Licence scans, divergence audit and hard negatives against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, hard_rows, words

from ledgerlens.llm import divergence, licenses, negatives, q_licenses

# ---------------------------------------------------------------- licences
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_scan(text, templates, phrases, threshold):
    ws = LICENSE_WORD.findall(lower(text))
    places = [(i, label) for phrase, label in phrases for i in range(len(ws)) if ws[i:i + len(phrase.split(" "))] == phrase.split(" ")]
    labels, best = {n for _, n in places}, 0.0
    for label, body in templates:
        if label is None or body is None:
            continue
        tw = LICENSE_WORD.findall(lower(body))
        if not tw:
            continue
        tokens, w = set(tw), max(4, 1 << (len(tw) - 1).bit_length())
        for start in range(0, len(ws), w):
            c = len(tokens & set(ws[start:start + 2 * w]))
            if c >= math.ceil(len(tokens) * threshold - 1e-9):
                labels.add(label)
                best = max(best, c / len(tokens))
    base = sorted({n for _, n in places})
    at = [i for i, _ in places]
    return (len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(labels)), 1.0 if places else best)


def license_rows():
    gpl = "This work is licensed under the GNU General Public License, version 3."
    filler = words(5, 9000)
    split = filler.split(" ")
    split[4090:4090] = gpl.split(" ")                  # across the end of a section
    return hard_rows() + [
        (200, "Released UNDER the mit\nLicense. " + filler[:300], "en", "a"), (201, " ".join(split), "en", "a"), (202, gpl.replace("work", "thing"), None, "a"),
        (203, "gnu general public", "en", "a"), (204, "Licensed under CC BY-NC 4.0. cc by nc", "en", "a"), (205, "under the mit license " * 3, "en", "a"),
        (206, gpl, "en", "a"), (206, gpl, "en", "a"), (None, gpl, "en", "a"), (207, "ünder the mit license", "en", "a")]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_license_scan_equals_brute_force(spark, threshold):
    rows = license_rows()
    templates = [*q_licenses.TEMPLATES, ("one", "zebra"), ("empty", " .. "), (None, "gnu"), ("long", words(5, 300))]
    frame = spark.createDataFrame(templates, "label string, text string")
    got = licenses.scan_licenses(documents(spark, rows), frame, q_licenses.PHRASES, threshold)
    want = Counter((i, *plain_scan(t, templates, q_licenses.PHRASES, threshold)) for i, t, _, _ in rows)
    assert Counter(map(tuple, got.collect())) == want
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert "gpl-3" in labels[201] and "mit" in labels[200] and labels[203] in ("", "gpl-3")


def test_license_scan_of_empty_tables(spark):
    frame = spark.createDataFrame(q_licenses.TEMPLATES, "label string, text string")
    assert licenses.scan_licenses(documents(spark, []), frame, q_licenses.PHRASES).count() == 0
    got = licenses.scan_licenses(documents(spark, hard_rows()), frame.limit(0), []).collect()
    assert len(got) == len(hard_rows()) and all(r.labels == "" and r.score == 0 and r.n_base == 0 for r in got)


# -------------------------------------------------------------- divergence
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, top):
    rows = [(la or "", s or "", TERM.findall(lower(t))) for _, t, la, s in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for la, _, ts in rows if la == lang for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = defaultdict(Counter)
        for la, s, ts in rows:
            if la == lang:
                count[s].update({t: n for t, n in Counter(ts).items() if docs[t] >= least})

        def p(c, kept=kept):
            bottom = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // bottom for t in kept}
        q = p(sum(count.values(), Counter()))
        ps = {s: p(c) for s, c in count.items()}
        for s in ps:
            pairs = sorted(((sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in ps if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((ps[s][t] - q[t], t) for t in kept if count[s][t] and ps[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, kind, item, v, k) for kind, xs in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(xs, 1)]
    return Counter(out)


def letters(seed, n, vocabulary):
    r = np.random.default_rng(seed)
    return " ".join("".join("abcdefghij"[int(d)] for d in str(k)) for k in r.integers(0, vocabulary, n))


@pytest.mark.parametrize("strip,band,leaf,block", [(2048, 128, 64, 16), (16, 4, 4, 2), (7, 3, 3, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, strip, band, leaf, block):
    for name, value in (("STRIP", strip), ("BAND", band), ("LEAF", leaf), ("ROWS", block)):
        monkeypatch.setattr(divergence, name, value)
    rows = hard_rows() + [(300 + k, letters(k, 40, 30 + 10 * (k % 9)).title(), "xy"[k % 2], f"s{k % 9}") for k in range(120)]
    rows += [(500, None, "x", "none"), (501, "Éé é ÉÉ", "x", None)]
    want = plain_audit(rows, 3, 5)
    for r in want:
        assert want[r] == 1
    # worker processes read the sizes from the module, so they are set there as well
    got = spark_audit(spark, rows, strip, band, leaf, block)
    assert got == want


def spark_audit(spark, rows, strip, band, leaf, block):
    plain = divergence._traverse

    def traverse(key, part):
        divergence.STRIP, divergence.BAND, divergence.LEAF, divergence.ROWS = strip, band, leaf, block
        return plain(key, part)
    divergence._traverse = traverse
    try:
        return Counter(map(tuple, divergence.audit(documents(spark, rows), 3, 5).collect()))
    finally:
        divergence._traverse = plain


def test_divergence_of_empty_tables_and_shares(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    none = divergence.audit(documents(spark, hard_rows()), least_docs=1000).collect()
    assert none and all(r.part == "pair" and r.value == 0 for r in none)
    cases = [(0, 0, 0), (0, 0, 1), (7, 19, 3), (10**13, 10**14, 10**7), (10**14, 10**14, 1)]
    frame = spark.createDataFrame(cases, "c long, n long, v long")
    for r in frame.select("*", divergence.share(frame.c, frame.n, frame.v).alias("p")).collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // max(1, r.n + 5 * r.v)


def test_quadtree_skips_zero_quadrants():
    rows, columns = np.array([0, 5, 6, 40]), np.array([3, 900, 3, 64])
    t = divergence.Quadtree(rows, columns, np.array([50, 60, 70, 80]), np.full(41, 10), 1000)
    assert t.levels[0].sum() == 3 and t.levels[-1].all() and t.levels[0].shape == (4, 16)
    full = np.full((41, 1000), 10)
    full[rows, columns] = [50, 60, 70, 80]
    want = np.abs(full[:, None, :] - full[None, :, :]).sum(2)
    assert np.array_equal(np.triu(divergence.joint_corrections(t, t, True), 1), np.triu(want, 1))


# ---------------------------------------------------------- hard negatives
def plain_mine(rows, low=50, high=95, positives=5, negatives_=3):
    take = [(i, la, [math.floor(256 * float(x)) for x in v]) for i, v, la in rows
            if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, la, v) in enumerate(take):
        if i is None or i % 50:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, j, lb) for b, (j, lb, w) in enumerate(take) if b != a]
        score.sort(key=lambda x: x[:3])
        for p in [x for x in score if x[4] == la][:positives]:
            s = -p[0]
            near = [x for x in score if x[4] != la and low * s <= -100 * x[0] <= high * s][:negatives_]
            out.update((i, p[3], k, x[3], s, -x[0]) for k, x in enumerate(near, 1))
    return out


def vectors(n, dims, seed, labels=4):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.round(r.normal(size=dims) + (k % labels), 2)], k % labels) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(50, rows[50][1], 2), (50, rows[50][1], 1), (None, rows[3][1], 1), (900, None, 1), (950, [0.0] * dims, 1), (1000, [nan] * dims, 1),
                   (1050, [inf] + [0.0] * (dims - 1), 2), (1100, [None] * dims, 2), (1150, rows[7][1], None), (1200, [], 3), (1250, [1.0], 0),
                   *[(2000 + k, rows[4][1], 0) for k in range(8)], *[(2100 + k, rows[5][1], 1) for k in range(8)]]


@pytest.mark.parametrize("block,group", [(8192, 1024), (16, 3)])
def test_hard_negatives_equal_brute_force(spark, block, group):
    rows = vectors(160, 6, 3)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rank string, window int").repartition(3)
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    got = Counter(map(tuple, negatives.mine(frame, lambda i: i % 50 == 0, block_rows=block, group=group).collect()))
    assert got and got == plain_mine(exact)


def test_hard_negatives_of_empty_table_and_great_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), lambda i: i % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        negatives.mine(spark.createDataFrame([(0, [1e12, 1.0], 1)], schema), lambda i: i % 50 == 0)


def test_threshold_search_stops_early_and_is_exact():
    r = np.random.default_rng(5)
    m = r.integers(-50, 50, (4000, 3))
    m[:40] += 300                                       # a few rows far out in every dimension
    orders, ids = np.argsort(m, axis=0, kind="stable").T, np.arange(4000)
    anchor = np.array([3, 2, 1])
    windows = np.array([(1500, 10**9), (-10**9, 10**9)])
    rows, scores, scored = negatives.threshold_search(anchor, m, orders, np.ones(4000, bool), windows, 5, ids)
    s = m @ anchor
    for w, (low, high) in enumerate(windows):
        inside = np.flatnonzero((s >= low) & (s <= high))
        want = inside[np.lexsort((inside, -s[inside]))][:5]
        assert rows[w].tolist() == want.tolist() and scores[w].tolist() == s[want].tolist()
    assert scored < 1000
