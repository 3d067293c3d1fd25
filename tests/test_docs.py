"""Chunking boundaries, exact top-k against brute force, context roll-up."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import docs as dc


def test_fixed_chunks_boundaries(spark):
    df = spark.createDataFrame([(1, ""), (2, "a" * 500), (3, "b" * 501), (4, "c" * 950), (5, "d" * 951)],
                               "doc_id int, text string")
    n = {r["doc_id"]: r["count"] for r in dc.chunk_fixed(df).groupBy("doc_id").count().collect()}
    assert n == {2: 1, 3: 2, 4: 2, 5: 3}
    last = dc.chunk_fixed(df).filter(F.col("doc_id") == 5).orderBy("chunk_no").collect()
    assert [r["chunk_start"] for r in last] == [0, 450, 900] and len(last[-1]["chunk_text"]) == 51


def test_recursive_splitter(spark):
    texts = [("Para one. " * 30).strip() + "\n\n" + ("Second para words " * 40).strip(), "", "short", "x" * 1200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in dc.chunk_recursive(df).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert all(len(c) <= 500 for c in got[0]) and len(got[0]) >= 2
    assert 1 not in got and got[2] == ["short"]
    assert [len(c) for c in got[3]] == [500, 500, 300]


def test_scan_docs_account_id(spark, tmp_path):
    (tmp_path / "4000_product_sales.md").write_text("# Doc\nbody")
    (tmp_path / "nounderscore.txt").write_text("x")
    (tmp_path / "skip.csv").write_text("a,b")
    from ledgerlens.sources.files import scan_docs
    got = {r["source_file"]: r["account_id"] for r in scan_docs(spark, str(tmp_path)).collect()}
    assert got == {"4000_product_sales.md": "4000", "nounderscore.txt": "nounderscore"}


def test_topk_matches_brute_force(spark):
    rnd = np.random.default_rng(0)
    n, d = 300, 16
    vecs = rnd.normal(size=(n, d)).astype(np.float32)
    keys = rnd.integers(0, 3, size=n)
    rows = [(int(i), [float(x) for x in vecs[i]], int(keys[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, k int")
    q = df.select(F.col("id").alias("query_id"), "embedding", "k")
    c = df.select(F.col("id").alias("chunk_id"), "embedding", "k")
    got = dc.topk_similar(q, c, k=4, key="k", exclude_self=True, block_size=32).collect()
    got_map = {}
    for r in got:
        got_map.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    v64 = vecs.astype(np.float64)
    norm = v64 / np.linalg.norm(v64, axis=1, keepdims=True)
    for qi in range(0, n, 17):
        cand = [j for j in range(n) if keys[j] == keys[qi] and j != qi]
        sims = sorted(((-round(float(norm[qi] @ norm[j]), 6), j) for j in cand))[:4]
        assert [cid for _, cid in sorted(got_map[qi])] == [j for _, j in sims]


def test_context_rollup_default(spark):
    hits = spark.createDataFrame([("q1", "c1", 1), ("q1", "c2", 2), ("q1", "c3", 3)],
                                 "anomaly_id string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("c1", "best", "f1.md"), ("c2", "second", "f1.md"), ("c3", "third", "f2.md")],
                                   "chunk_id string, chunk_text string, source_file string")
    r = dc.context_rollup(hits, chunks).collect()[0]
    assert r["account_documentation"] == "best" and r["similar_cases"] == ["second", "third"]
    assert r["source_files"] == ["f1.md", "f1.md", "f2.md"]      # as often as a file gave a hit


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", 2, 0, "same"), ("a", 1, 3, "same"), ("b", 1, 0, "same"), ("a", 5, 0, "other")],
                               "account_id string, doc_id int, chunk_no int, chunk_text string")
    got = sorted((r["account_id"], r["doc_id"], r["chunk_no"], r["copies"]) for r in dc.dedupe_chunks(df).collect())
    assert got == [("a", 1, 3, 2), ("a", 5, 0, 1), ("b", 1, 0, 1)]


def test_sink_account_docs_folder_per_account(spark):
    from ledgerlens.session import scratch_path
    from ledgerlens.sources.files import sink_account_docs
    docs = spark.createDataFrame([("1", "1_a.md", "# one\nbody"), ("2", "2_b.md", "# two")],
                                 "account_id string, source_file string, text string")
    path = scratch_path(spark, "t_docs")
    sink_account_docs(docs, path, folder_per_account=True)
    back = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"account_id=([^/]+)", 1).alias("a"), "value")
    assert sorted((r["a"], r["value"].rstrip("\n")) for r in back.collect()) == [("1", "# one\nbody"), ("2", "# two")]


def test_retrieve_context_filters_by_account_first(spark):
    import datetime as dt
    flags = spark.createDataFrame(
        [("A", "Rent", dt.date(2025, 2, 1), "2025-02", 50.0, "increase", "high"),
         ("B", "Travel", dt.date(2025, 2, 1), "2025-02", -40.0, "decrease", "high")],
        "gl_account_id string, account_name string, month date, current_month string, variance_percent double, "
        "direction string, severity string")
    chunks = spark.createDataFrame(
        [(f"A_{i}", "A", f"rent changed text {i}", "A_rent.md") for i in range(5)]
        + [("C_0", "C", "rent changed text", "C_other.md")],
        "chunk_id string, account_id string, chunk_text string, source_file string")
    hist = spark.createDataFrame([("A", 7)], "gl_account_id string, history_count long")
    ctx = {r["gl_account_id"]: r for r in dc.retrieve_context(flags, chunks, history_counts=hist).collect()}
    a, b = ctx["A"], ctx["B"]
    assert a["account_documentation"].startswith("rent changed text")
    assert len(a["similar_cases"]) == 2 and a["source_files"] == ["A_rent.md"] * 3   # only A's chunks, k = 3
    assert b["account_documentation"] == "No documentation found" and b["similar_cases"] == []
    assert a["past_anomaly_count"] == 7 and b["past_anomaly_count"] == 0
