"""Separator splitter, embeddings by a model, the stored index."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import docs as dc
from ledgerlens.session import scratch_path


def plain_merge(pieces, size, overlap):
    """Greedy: close a chunk when the next piece does not fit, then drop
    pieces from its front until the overlap is short enough and it does."""
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    return [c.strip() for c in [*out, "".join(held)] if c.strip()]


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1:]
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep != "\n\n" else re.sub("\n\n", "\0\n\n", text).split("\0")) if p] if sep else list(text)
    out, small = [], []
    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        out, small = out + plain_merge(small, size, overlap), []
        out += plain_split(p, size, overlap, rest)
    return out + plain_merge(small, size, overlap)


@pytest.mark.parametrize("size,overlap", [(50, 10), (50, 0), (30, 29), (500, 50)])
def test_recursive_chunks_equal_brute_force(spark, size, overlap):
    r = random.Random(size + overlap)
    parts = ["a", "bb", "ccc ", " ", "\n", "\n\n", "\n\n\n", " \n", "word ", "é ", " ", "\x1f"]
    rows = [(k, "".join(r.choice([*parts, "x" * r.randrange(1, 40), "y" * r.randrange(60)]) for _ in range(r.randrange(100)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "q" * 333), (1004, "q" * 50), (1005, " " + "q" * 50), (1006, "\n\n" + "q" * 49 + " z")]
    docs = spark.createDataFrame([(k, t, 7, "z") for k, t in rows], "_id int, text string, chunk int, pos string").repartition(3)
    got = {}
    for x in dc.chunk_recursive(docs, size, overlap).orderBy("_id", "chunk_no").collect():
        assert x.chunk_no == len(got.setdefault(x._id, [])) and (x.chunk, x.pos) == (7, "z")
        got[x._id].append(x.chunk_text)
    for k, t in rows:
        assert got.get(k, []) == (plain_split(t, size, overlap) if t else [])
    assert all(len(c) <= size for cs in got.values() for c in cs)


def test_recursive_chunks_run_no_python(spark):
    plan = dc.chunk_recursive(spark.createDataFrame([(1, "a b")], "doc_id int, text string"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="overlap"):
        dc.chunk_recursive(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), 10, 10)


def test_tfidf_vectors_without_shuffling_tokens(spark):
    texts = ["Rent rent office", "rent ÉTÉ été 12", "", None, "office supplies, paper", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, chunk_text string").repartition(3)
    got = {r.chunk_id: r.embedding for r in dc.embed_chunks(df, dim=16).collect()}
    import hashlib
    tokens = {i: [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16 for t in re.findall(r"[^\W_]+", (x or "").lower())] for i, x in enumerate(texts)}
    df_ = {b: sum(b in t for t in tokens.values()) for b in range(16)}
    for i, t in tokens.items():
        v = np.array([t.count(b) * (math.log(7 / (df_[b] + 1)) + 1) for b in range(16)])
        want = v / np.linalg.norm(v) if v.any() else v
        assert np.allclose(got[i], want, atol=1e-12)
    plan = dc.embed_text(df, "chunk_text", dc.token_idf(df, "chunk_text", 16), dim=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1          # the test's own repartition


def test_vectors_are_rounded_where_they_are_made(spark):
    """As ``F.round`` rounds them, without a decimal number for each of a vector's numbers."""
    r = np.random.default_rng(4)
    ties = np.array([(2 * k + 1) / 2e6 for k in r.integers(0, 500_000, 400)])
    near = np.concatenate([ties, np.nextafter(ties, 0), np.nextafter(ties, 1)])
    v = np.concatenate([r.random(2000), near, -near[:300], [0.0, -0.0, 1.0, -1.0, 1e-9, -1e-9, 5e-7, 4.9999999999e-7, 0.9999995]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double")
    want = [x.y for x in df.select("i", (F.round("x", 6) + F.lit(0.0)).alias("y")).orderBy("i").collect()]
    got = dc._rounded(v.reshape(1, -1), 6)[0].tolist()
    assert list(map(repr, got)) == list(map(repr, want))

    texts = ["Rent rent office", "rent ÉTÉ été 12", "", None, "office supplies, paper a b c d e f g", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, chunk_text string")
    made = {x.chunk_id: x.embedding for x in dc.embed_chunks(df, dim=16).select(
        "chunk_id", F.transform("embedding", lambda y: F.round(y, 6) + F.lit(0.0)).alias("embedding")).collect()}
    assert {x.chunk_id: x.embedding for x in dc.embed_chunks(df, dim=16, decimals=6).collect()} == made


def test_registered_vectors_are_not_rounded_in_the_plan(spark, tmp_path):
    from ledgerlens.plans import q_docs
    spark.createDataFrame([(1, "a b c"), (2, None), (3, "b " * 400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_docs.embed_chunks(spark, str(tmp_path))
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(x.chunk_id for x in got.collect()) == ["1:0", "3:0", "3:1"]


def test_embedding_by_a_model(spark):
    def _load():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            return [[float(len(t)), float(len(calls) > 0)] for t in texts]
        return embed
    df = spark.createDataFrame([(k, None if k % 5 == 0 else "x" * k) for k in range(700)], "id int, text string").repartition(2)
    got = {r.id: r.embedding for r in dc.embed_with(df, "text", _load, dim=2, batch=64).collect()}
    assert got == {k: None if k % 5 == 0 else [float(k), 1.0] for k in range(700)}
    for bad, message in ((lambda: lambda ts: [[1.0]] * len(ts), "not of 2 finite"), (lambda: lambda ts: [[1.0, 2.0]], "1 vectors for"),
                         (lambda: lambda ts: [[1.0, float("nan")]] * len(ts), "not of 2 finite")):
        with pytest.raises(Exception, match=message):
            dc.embed_with(df, "text", bad, dim=2).collect()
    assert dc.embed_with(df.limit(0), "text", _load, dim=2).count() == 0


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dims))
    return [(int(k), [float(x) for x in centres[k % 40] + 0.4 * r.normal(size=dims)], int(k % 3)) for k in range(n)]


def test_index_finds_nine_of_ten(spark):
    rows = clustered(1500, 32, 1)
    c = spark.createDataFrame(rows + [(9000, [0.0] * 32, 0), (9001, None, 1)], "chunk_id long, embedding array<double>, label int").repartition(4)
    q = c.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    path = scratch_path(spark, "t_lsh")
    dc.build_lsh_index(c, path, key="label", tables=24, projections=6)
    cells = spark.read.parquet(f"{path}/cells")
    assert cells.groupBy("id").count().where("count <> 24").count() == 0 and cells.select("id").distinct().count() == 1501
    found = {(r.query_id, r.chunk_id): r.similarity for r in dc.topk_docs_lsh(spark, q, path, k=5, key="label", exclude_self=True).collect()}
    exact = {(r.query_id, r.chunk_id): r.similarity for r in dc.topk_similar(q, c, k=5, key="label", exclude_self=True).collect()}
    assert len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert all(found[p] == s for p, s in exact.items() if p in found)
    # the cells leave most vectors aside
    met = cells.alias("a").join(cells.alias("b"), ["table", "cell", "key"]).where("a.id % 10 = 0").select("a.id", F.col("b.id").alias("other")).distinct().count()
    assert met < 0.5 * cells.select("id").distinct().count() * 150 / 3


def test_topk_over_small_blocks_and_ties(spark):
    rows = [(k, [1.0, float(k % 4)], "x") for k in range(60)] + [(100, [0.0, 0.0], "x"), (101, None, "x")]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, key string")
    q = c.where("chunk_id IN (0, 1, 100)").withColumnRenamed("chunk_id", "query_id")
    small = sorted(map(tuple, dc.topk_similar(q, c, k=4, key="key", exclude_self=True, block_size=7).collect()))
    assert small == sorted(map(tuple, dc.topk_similar(q, c, k=4, key="key", exclude_self=True).collect()))
    assert [x[1] for x in small if x[0] == 0] == [4, 8, 12, 16] and not [x for x in small if x[0] == 100]


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_pruned_search_is_exact(spark, cells):
    rows = clustered(900, 16, 2) + [(5000 + k, [1.0] * 16, 0) for k in range(30)]          # ties
    c = spark.createDataFrame([*rows, (9000, [0.0] * 16, 0), (9001, None, 1)], "chunk_id long, embedding array<double>, label int").repartition(4)
    q = c.where("chunk_id % 7 = 0 OR chunk_id >= 5000").withColumnRenamed("chunk_id", "query_id")
    got = sorted(map(tuple, dc.topk_pruned(q, c, k=4, exclude_self=True, cells=cells, block_size=50).collect()))
    assert got == sorted(map(tuple, dc.topk_similar(q, c, k=4, exclude_self=True).collect()))
    few = c.limit(2)
    assert sorted(map(tuple, dc.topk_pruned(q, few, k=4).collect())) == sorted(map(tuple, dc.topk_similar(q, few, k=4).collect()))
    assert dc.topk_pruned(q, c.limit(0), k=4).count() == 0


def test_cells_are_ruled_out():
    r = np.random.default_rng(3)
    centres = np.eye(8)
    radius = np.full(8, 0.2)
    q = centres[2] + 0.01 * r.normal(size=8)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([list(q)]), pa.array([2], pa.int32()), pa.array([0.9])], ["id", "embedding", "cell", "kth"])
    assert next(dc._open_cells(centres, radius)([batch])).num_rows == 0
    unknown = batch.set_column(3, "kth", pa.array([None], pa.float64()))
    assert next(dc._open_cells(centres, radius)([unknown])).num_rows == 7


def plain_nearest(qm, cm, k, qcode, ccode):
    """Every pair worked out and sorted."""
    out = []
    for i, q in enumerate(qm):
        with np.errstate(all="ignore"):
            sims = np.round((cm @ q) / (np.linalg.norm(q) * np.linalg.norm(cm, axis=1)), 6)
        some = [(-s, j) for j, s in enumerate(sims) if np.isfinite(s) and qcode[i] != ccode[j]]
        out += [(i, j, -s) for s, j in sorted(some)[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "copies"])
def test_nearest_by_tiles_equals_brute_force(kind):
    r = np.random.default_rng(5)
    q, c = (r.normal(size=(n, 12)) if kind == "spread" else r.integers(-1, 2, size=(n, 12)).astype(float) for n in (600, 2600))
    if kind == "copies":
        c[r.random(2600) < 0.5], q[::3] = c[7], c[7]
        q[1], c[3] = np.nan, 0.0
    qcode, ccode = r.integers(0, 40, 600), r.integers(0, 40, 2600)
    got = dc._nearest(q, c, 4, qcode, ccode)
    assert [tuple(x) for x in zip(*(a.tolist() for a in got), strict=True)] == plain_nearest(q, c, 4, qcode, ccode)


def test_copies_of_vectors_grow_with_their_number(spark):
    """A vector is copied once for each block of the other side: so often at most, whatever the size of its key."""
    sizes = [(1, 1), (63, 65), (200, 0), (0, 7), (1026, 1026), (10256, 10256), (61538, 61538), (15000, 600000), (600000, 15000)]
    df = spark.createDataFrame(sizes, "nq long, nc long")
    for size in (64, 4096):
        nq, nc = dc._n_blocks(F.col("nq"), F.col("nc"), size)
        for r in df.select("nq", "nc", nq.alias("bq"), nc.alias("bc")).collect():
            assert r.bq >= 1 and r.bc >= 1 and r.nq <= r.bq * dc.MOST_VECTORS and r.nc <= r.bc * dc.MOST_VECTORS
            assert r.nq * r.bc + r.nc * r.bq <= 20 * (r.nq + r.nc)
    wide = dc._n_blocks(F.lit(10256), F.lit(10256), 64)
    assert tuple(df.limit(1).select(*wide).first()) == (8, 8)          # a hot key is still spread over 64 tasks


def test_a_worker_is_given_one_pair_of_blocks_at_a_time(spark):
    c = spark.createDataFrame([(k, [1.0, float(k)], k % 2) for k in range(400)], "chunk_id long, embedding array<float>, label int")
    found = dc.topk_similar(c.withColumnRenamed("chunk_id", "query_id"), c, k=2, key="label", exclude_self=True, block_size=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow [" not in plan.replace("FlatMapGroupsInArrow", "")
    # grouped where the pairs lie: the join's own exchanges, none between it and Python
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[1].split("Join")[0]


def test_index_keeps_single_precision_and_joins_once(spark):
    """Vectors are stored as they come, and pairs go to Python as they were joined: no further exchange."""
    rows = clustered(300, 8, 4)
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int")
    path = scratch_path(spark, "t_lsh_f")
    dc.build_lsh_index(c, path, key="label", tables=3)
    assert spark.read.parquet(f"{path}/cells").schema["embedding"].dataType.simpleString() == "array<float>"
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        found = dc.topk_docs_lsh(spark, c.withColumnRenamed("chunk_id", "query_id"), path, k=2, key="label", exclude_self=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[1].split("SortMergeJoin")[0]


def test_a_model_gets_its_texts_in_parts(spark):
    """Python holds ``batch`` texts as strings at a time; the rest of an Arrow batch stays in Arrow."""
    def _load():
        import gc

        def embed(texts):
            held = sum(isinstance(x, str) and x.startswith("held-") for o in gc.get_objects() if isinstance(o, list) for x in o)
            import numpy
            held += sum(o.size for o in gc.get_objects() if isinstance(o, numpy.ndarray) and o.dtype == object)
            return [[float(held), float(len(t))] for t in texts]
        return embed
    df = spark.createDataFrame([(k, None if k % 9 == 0 else f"held-{k}") for k in range(3000)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in dc.embed_with(df, "text", _load, dim=2, batch=50).collect()}
    assert all(v is None if k % 9 == 0 else v[1] == len(f"held-{k}") for k, v in got.items()) and len(got) == 3000
    assert max(v[0] for v in got.values() if v) <= 200
    assert "ArrowEvalPython" in dc.embed_with(df, "text", _load, dim=2)._jdf.queryExecution().executedPlan().toString()


def test_open_cells_are_given_out_in_parts():
    """A batch of queries that every cell may hold is not multiplied by the cells at once."""
    import pyarrow as pa
    r = np.random.default_rng(1)
    centres = np.eye(8)
    v = pa.array(list(r.normal(size=(2000, 8)).astype(np.float32)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), v, pa.array([0] * 2000, pa.int32()), pa.array([None] * 2000, pa.float64())],
                                       ["id", "embedding", "cell", "kth"])
    parts = list(dc._open_cells(centres, np.full(8, 4.0))([batch]))
    assert sum(p.num_rows for p in parts) == 2000 * 7 and max(p.num_rows for p in parts) <= 512 * 7
    assert {p.schema.field("embedding").type for p in parts} == {pa.list_(pa.float32())}
