"""Queries: token files, packing."""

from __future__ import annotations

from ..session import scratch_path
from . import packing, separators, token_files
from .common import table
from .registry import register


def vocabulary(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@register("op2_token_files")
def op2_token_files(spark, sf_dir):
    """Every document's ids written as ORC files and read back."""
    path = scratch_path(spark, "token_files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.token_digests(token_files.read_token_files(spark, path))


@register("op3_packing")
def op3_packing(spark, sf_dir):
    """Every document packed into sequences of at most 2048 ids; one row per piece."""
    return packing.piece_digests(packing.pack(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, window=2048))


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    """Tokens of every document, counted by scanning flat files for separators."""
    path, separator = scratch_path(spark, "flat_tokens"), 49407
    separators.write_flat_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), separator)
    return separators.count_documents(spark, path, separator).select("doc_id", "n_tokens")
