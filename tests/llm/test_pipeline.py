"""Stages of the corpus pipeline, one after the other, on a small table."""

from collections import Counter

import corpus_pipeline as cp
from helpers import words
from test_ngram_join import brute
from test_token_operators import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path):
    rows = []
    for k in range(700):
        text = words(k, 70, 100_000)
        if k % 5 == 0:
            text = " | ".join(text.split(" "))              # junk
        rows.append((k, text, "en", f"s{k % 3}"))
    base = words(9999, 80, 100_000)
    rows += [(800 + k, base if k < 3 else base + f" end{k}", "en", "s0") for k in range(6)]
    rows += [(900, None, None, None), (901, "", "en", "s1"), (902, words(5, 20), "en", "s1"), (None, words(6, 60, 9999), None, None), (1, rows[1][1], "en", "s1")]
    full = [(i, t, la, s, len(t or "")) for i, t, la, s in rows]
    spark.createDataFrame(full, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, int(k % 5 != 0), 0) for k in range(700)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_join", "mixing", "packing"]
    good = cp.keep_good(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    want = [r for r in rows if r[1] and len(r[1].split()) >= 50 and " | " not in r[1]]
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter((r[0], r[1]) for r in want)
    one = cp.one_of_each_group(spark, good, str(tmp_path))
    assert one.columns == docs.columns
    classes = brute(want)
    assert Counter(r.doc_id for r in one.collect()) == Counter({c for _, c, _ in classes} | {None})
    mixed = cp.mix(spark, one, str(tmp_path))
    assert mixed.columns == docs.columns
    sizes = Counter()
    for r in one.collect():
        sizes[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert 0 < max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in one.collect()}
    total = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(total - 1.5 * sum(sizes.values())) < 200 * len(sizes)
    pieces = cp.pack(spark, mixed, str(tmp_path)).collect()
    from ledgerlens.llm.tokenizer import PieceEncoder
    enc = PieceEncoder(vocabulary("byte_bpe_50k.json"), special=True)
    want_ids = sum(len(enc.encode([r.text])[0]) + 1 for r in mixed.collect())
    assert sum(p.length for p in pieces) == want_ids
    assert sum(p.length for p in cp.run(spark, str(tmp_path)).collect()) == want_ids


def test_stages_take_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_mixing_takes_good_documents_before_poor_ones_of_the_same_kind(spark, tmp_path):
    """Alike texts of 70 words; only the label tells them apart."""
    full = [(k, words(k, 70, 100_000), "en", f"s{k % 3}", 0) for k in range(1500)]
    docs = spark.createDataFrame(full, SCHEMA).repartition(4)
    marks = [(k, k // 3 % 2, 0) for k in range(1500) if k % 5]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    copies, label = Counter(r.doc_id for r in cp.mix(spark, docs, str(tmp_path)).collect()), {k: q for k, q, _ in marks}
    mean = {q: sum(copies[k] for k in range(1500) if label.get(k) == q) / sum(label.get(k) == q for k in range(1500)) for q in (0, None, 1)}
    assert mean[0] + 0.05 < mean[None] < mean[1] - 0.05


def test_stages_carry_columns_of_any_name(spark):
    """Also two rows that differ in their language alone are judged apart."""
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.001"
    names = ["__tie", "__id", "row", "id", "tie", "stratum", "r_id", "k_id"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("*", *[(F.col("doc_id") * 10 + k).alias(n) for k, n in enumerate(names)])
    for stage in (cp.keep_good, cp.one_of_each_group):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all([r[n] for n in names] == [r.doc_id * 10 + k for k, n in enumerate(names)] for r in rows)
