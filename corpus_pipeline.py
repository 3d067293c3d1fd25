"""Corpus pipeline: documents to packed token sequences in four stages.

Each stage takes what the one before it kept.  All but the last return the
columns of the table of documents.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: of each group of similar documents the one with the
   smallest id stays (of repeated rows one; a null id ranks last);
3. mixing: documents are repeated or left out to meet the sources' targets;
4. packing: the pieces of all documents in sequences of at most 2048 ids.

The pipeline's rows can't be expressed in SQL (binomial bounds, tokenizer), so
ORACLE_SQL is None and tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, ngram_join, packing, q_native, q_texts, q_tokens
from ledgerlens.llm.common import stored, table


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one value, so its column names can't clash, beside what it is found again by."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias("tie"), F.col("lang").alias("stratum"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents to be dropped are joined with the texts by id; a
    document is found again by its id, its language and the hash of its text."""
    narrow = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("tie"))
    rejected = q_texts.judged(spark, sf_dir, narrow, ("doc_id", "lang", "tie")).where(~F.col("kept")).select(
        F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie"), F.col("lang").alias("r_stratum")).distinct()
    return _rows(docs).join(rejected, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie"))
                            & F.col("stratum").eqNullSafe(F.col("r_stratum")), "left_anti").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar_documents(docs)
    # texts without words are in no group; all of them stay, repeated rows once
    alone = F.col("set_id").isNull()
    keep = groups.groupBy("set_id", F.when(alone, F.col("doc_id")), F.when(alone, F.col("tie"))).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first"))
    keep = keep.select(F.col("first.doc_id").alias("k_id"), F.col("first.tie").alias("k_tie"))
    kept = _rows(docs).join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")), "left_semi")
    return kept.dropDuplicates(["id", "tie"]).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 2, poor 0.5, those without a label 1."""
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix_documents(docs, weights=weights, seed=q_native.SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(docs, q_tokens.vocabulary("byte_bpe_50k.json"), end_id=1, window=2048))


STAGES = [("quality_rules", keep_good), ("ngram_join", one_of_each_group), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
