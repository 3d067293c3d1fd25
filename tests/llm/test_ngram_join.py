"""Chosen-path join against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from helpers import documents, hard_rows, words

from ledgerlens.llm import ngram_join


def shingles(text, width=5):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, threshold=0.8):
    """Multiset of (doc_id, class_id, n_links)."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, min(least[find(k)], default=None), links[k]) for k, (i, *_) in enumerate(rows))


def found(spark, rows, **how):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(documents(spark, rows), **how).collect())


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
    return " ".join(w)


def near_rows():
    """Groups of near copies at similarities around the threshold, a shared passage, exact copies."""
    rows, i = [], 0
    passage = words(999, 60)
    for g in range(25):
        base = words(g, 150, 5000)
        for k in range(6):
            rows.append((i, edited(base, k if g % 2 else 2 * k, 100 * g + k), "en", "a"))
            i += 1
    for k in range(60):
        rows.append((i, passage + " " + words(5000 + k, 120, 5000), "en", "a"))
        i += 1
    base = words(77, 100, 5000)
    rows += [(i + k, base, "en", "a") for k in range(40)]                  # exact copies
    rows += [(i + 40 + k, edited(base, 1, k), "en", "a") for k in range(120)]   # a large group of near copies
    return rows


@pytest.mark.parametrize("limit,block", [(256, 2048), (8, 2048), (8, 16)])
def test_join_finds_all_links(spark, limit, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows()
    assert found(spark, rows, limit=limit) == brute(rows)


def test_awkward_rows(spark):
    rows = [r for r in hard_rows()]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None, None, None), (2, "", None, None)]) == Counter([(1, 1, 0), (2, 2, 0)])


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (1002, 1001)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert all(got.get(k, 0) == 0 for k in range(n)) and got[1001] == got[1002] == 1000


def test_runs_reach_the_recall():
    assert ngram_join.runs_needed(0.8, 0.99999) == 5 and 2 * 5 <= ngram_join.DEEP
    assert ngram_join.least_agreeing(0.8) >= 18
