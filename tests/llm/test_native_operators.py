"""Mixing, sharding and URL rules against brute force."""

import math
import re
import zlib
from collections import defaultdict

import pytest
from helpers import documents, hard_rows, words
from pyspark.sql import functions as F

from ledgerlens.llm import kdtree, mixing, q_native, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, budget, epochs):
    """Targets by sharing the excess again until none is above its limit."""
    target = {s: 0.0 for s in sizes}
    open_, left = set(sizes), budget
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w >= epochs * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_whole_documents(spark):
    rows = hard_rows()
    docs = documents(spark, rows)
    got = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    out = defaultdict(int)
    for r in mixed.collect():
        out[r.source] += len(WORD.findall(r.text or ""))
    for s in sizes:
        assert abs(out[s] - target[s]) <= 2 * largest[s]
    again = sorted(map(str, mixing.mix_plan(documents(spark, rows, 7)).collect()))
    assert again == sorted(map(str, got))


def test_mixing_prefers_documents_of_high_quality(spark):
    rows = [(k, words(k, 50), "en", "a" if k < 400 else "b") for k in range(800)]
    docs = documents(spark, rows).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0))
    got = mixing.mix_plan(docs, cycle=(1, 1), budget=0.5, quality=F.col("q")).collect()
    even = sum(r.taken > 0 for r in got if r.doc_id % 2 == 0)
    odd = sum(r.taken > 0 for r in got if r.doc_id % 2)
    assert even > 1.5 * odd and abs(even + odd - 400) <= 3


def test_mixing_keeps_complete_epochs_and_the_same_documents(spark):
    rows = [(k, words(k, 20 + k % 30), "en", "a" if k % 3 else "b") for k in range(300)]
    docs = documents(spark, rows)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs, cycle=(5, 1)).collect()}
    mixed = defaultdict(int)
    for r in mixing.mix_documents(docs, cycle=(5, 1)).collect():
        mixed[r.doc_id] += 1
    assert {k: v for k, v in plan.items() if v} == dict(mixed)
    assert mixing.mix_plan(documents(spark, [])).collect() == []
    assert mixing.mix_documents(documents(spark, [])).collect() == []


@pytest.mark.parametrize("ids", [0, 1 << 20])
def test_mixing_by_weights_gives_the_planned_copies(spark, monkeypatch, ids):
    monkeypatch.setattr(mixing, "BROADCAST_IDS", ids)
    rows = hard_rows() + [(200 + k, words(k, 60), "en", None if k % 3 else "a") for k in range(200)]
    docs = documents(spark, rows)
    marks = [(i, i % 2) for i in sorted({r[0] for r in rows if r[0] is not None}) if i % 5] + [(None, 1), (77_777, 0), (203, 0)]
    weights = mixing.label_weights(spark.createDataFrame(marks, "doc_id long, quality int"))
    best = {i: q for i, q in sorted(marks[:-3])}
    assert {r.doc_id: r.weight for r in weights.collect()} == {i: 2.0 if q else 0.5 for i, q in {**best, 77_777: 0}.items()}
    plan = defaultdict(int)
    for r in mixing.mix_plan(docs, cycle=(2, 1), budget=0.5, weights=weights).collect():
        plan[r.doc_id] += r.copies
    mixed = defaultdict(int)
    out = mixing.mix_documents(docs, cycle=(2, 1), budget=0.5, weights=weights)
    assert out.columns == docs.columns
    for r in out.where(F.length(F.trim("text")) > 3).collect():
        mixed[r.doc_id] += 1
    wordy = {i for i, t, *_ in rows if len((t or "").strip()) > 3}
    assert {k: v for k, v in plan.items() if v and k in wordy} == dict(mixed)
    plain = {r.doc_id: r.copies for r in mixing.mix_plan(docs, cycle=(2, 1), budget=0.5).collect()}
    assert sum(plain[k] != plan[k] for k in best) > 20 and mixing.mix_documents(docs.limit(0), weights=weights).collect() == []


@pytest.mark.parametrize("n", [1, 3, 8])
def test_kd_shards(spark, n):
    rows = hard_rows() + [(1000 + k, words(9, 70), "en", "hot") for k in range(200)]      # copies, a third of all rows
    got = kdtree.kd_shards(documents(spark, rows), n_shards=n).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text_crc32) for r in got) == sorted(
        (i if i is not None else -1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, largest, slots = defaultdict(int), 0, defaultdict(list)
    for r in got:
        assert r.size >= 16
        total[r.shard] += r.size
        largest = max(largest, r.size)
        slots[r.shard].append(r.slot)
    assert sum(total.values()) == sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(total.values()) / n
    assert all(abs(v - mean) <= largest for v in total.values())


def test_kd_shards_are_even_and_stop_at_the_target(spark):
    rows = [(k, words(k, 30 + k % 50), "en" if k % 10 else "fr", f"s{k % 7}") for k in range(2000)]
    docs = documents(spark, rows)
    total = sum(len(t) + 16 for _, t, *_ in rows)
    got = kdtree.kd_shards(docs, target_bytes=total // 10).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(got) in (10, 11)
    assert max(r.n for r in got) < 1.04 * min(r.n for r in got)
    assert kdtree.kd_shards(documents(spark, []), n_shards=4).collect() == []


@pytest.mark.parametrize("n", [5, 16])
def test_kd_cuts_follow_the_widest_dimension(spark, n):
    """Every node, told by its range of shards, is cut along the dimension
    that is widest in it, at the weighted median; sources share ten bytes."""
    rows = [(k * 37 % 1000, words(k, 5 + k * k % 90), ("en", "fr", None)[k % 3], f"https://xy/{k % 23:03d}") for k in range(1500)]
    size = {i: len(t) + 16 for i, t, *_ in rows}
    assert len(size) < len(rows)
    rows = list({r[0]: r for r in rows}.values())
    size = {i: len(t) + 16 for i, t, *_ in rows}
    place = {v: k for k, v in enumerate(sorted({s for *_, s in rows}))}
    langs = {None: 0.0, "en": 1.0, "fr": 2.0}
    dims = {i: (float(i), math.log2(size[i] + 1), langs[la], float(place[s])) for i, _, la, s in rows}
    got = {r.doc_id: r.shard for r in kdtree.kd_shards(documents(spark, rows), n_shards=n).collect()}
    whole = [max(d[a] for d in dims.values()) - min(d[a] for d in dims.values()) for a in range(4)]
    cut_axes = set()

    def node(first, k):
        if k == 1:
            return
        mine = [i for i in got if first <= got[i] < first + k]
        width = [(max(dims[i][a] for i in mine) - min(dims[i][a] for i in mine)) / whole[a] for a in range(4)]
        axis = max(range(4), key=lambda a: (width[a], -a))
        cut_axes.add(axis)
        left, right = ([i for i in mine if (got[i] < first + k // 2) == side] for side in (True, False))
        low, step = min(dims[i][axis] for i in mine), (max(dims[i][axis] for i in mine) - min(dims[i][axis] for i in mine)) / kdtree.BINS
        assert max(math.floor((dims[i][axis] - low) / step) for i in left) <= min(math.floor((dims[i][axis] - low) / step) for i in right)
        goal = sum(size[i] for i in mine) * (k // 2) / k
        assert abs(sum(size[i] for i in left) - goal) <= max(size.values())
        node(first, k // 2)
        node(first + k // 2, k - k // 2)
    node(0, n)
    assert 3 in cut_axes or n < 16


def test_mixing_prefers_good_documents(spark):
    rows = [(k, words(k, 60), "en", "a") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(0, 600, 3)] + [(None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    plan = mixing.mix_plan(documents(spark, rows), budget=0.5, weights=mixing.label_weights(labels)).collect()
    assert len(plan) == 600
    kept = {r.doc_id for r in plan if r.copies}
    good, poor = [k for k in range(0, 600, 6)], [k for k in range(3, 600, 6)]
    assert sum(k in kept for k in good) > 1.5 * sum(k in kept for k in poor)


def test_mixing_carries_columns_of_any_name(spark):
    names = ["__key", "__tie", "__mix", "__other", "__copy", "row", "key", "tie", "mix", "id"]
    rows = [(k, words(k, 60), "a", *[100 * k + j for j in range(len(names))]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = mixing.mix_documents(docs, weights=mixing.label_weights(labels)).collect()
    assert got and set(map(tuple, got)) <= set(rows)


def brute_url(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("".join(c.lower() if "A" <= c <= "Z" else c for c in h), p, v) for h, p, v in rules]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, "allow", None)
    return host, path, best[3], best[2]


def test_url_rules(spark):
    rules = [*q_native.RULES, ("a.b.net", "/x", "allow"), ("b.net", "/xyz", "allow"), ("b.net", "/xyz", "block"), ("c.d", "", "block"), ("ÉX.Org", "/q", "block")]
    urls = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "http://net/", "http://xnet/", "HTTP://EXAMPLE.NET/en/a?b#c",
            "http://example.net/en", "http://www.example.net/en/", "http://example.com/de/1", "http://Éxample.ORG/fr/", "http://org/fr/x",
            "http://z.a.b.net/xyz/1", "http://a.b.net/x", "http://b.net/xyzz", "x://c.d", "x://c.d?q", "x://e.c.d/#f", "http://a.net:80/",
            "http://..net/", "http://a.net/://b.org/fr/", "http://example.org/fr/" + "y/" * 3000, "a://b://example.com/de/", "http://a.net/\n/x", "http://ÉX.org/q", "http://éx.org/q"] * 2
    pages = spark.createDataFrame([(k, u, "h", "x", "y") for k, u in enumerate(urls)],
                                  "page_id long, url string, host string, rule string, prefix string").repartition(3)
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, known).collect()}
    assert got == {k: brute_url(u, rules) for k, u in enumerate(urls)}
    none = url_rules.judge_urls(pages, known.limit(0)).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), known).collect() == []
    plan = url_rules.judge_urls(pages, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
