"""Registered queries: text masking and repair over whole documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as tx
from . import adapters as ad
from .catalog import register


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_repl(r: str) -> str:
    # Java replacement ($1, \$) -> RE2 rewrite (\1, literal $)
    r = r.replace("\\$", "\x00")
    r = re.sub(r"\$(\d)", r"\\\1", r)
    return r.replace("\x00", "$")


def _sql_fold(expr: str, rules) -> str:
    for p, r in rules:
        expr = f"regexp_replace({expr}, {_sql_str(p)}, {_sql_str(_sql_repl(r))}, 'g')"
    return expr


#: endings given to documents by id modulo 6, so that every rule has work
ENDINGS = [" 8,500.00isalsowellabovethetypicalmonthlyrangeof$ 100", " amountiswellbelowthe 15 %rangeof35, iswellwithin",
           " was 35\n000.00 and 7\n 250\n00 in all", " key sk-" + "aB3" * 16 + " given", " Authorization: Bearer abc.def-9_x"]
_ENDED = ("(SELECT * REPLACE (text || CASE doc_id % 6 " + " ".join(
    f"WHEN {k} THEN {' || chr(10) || '.join(_sql_str(x) for x in e.split(chr(10)))}" for k, e in enumerate(ENDINGS))
    + " ELSE '' END AS text) FROM documents)")


def ended_documents(spark, sf):
    """Documents with an ending that the masking and repair rules act on."""
    d = ad.table(spark, sf, "documents")
    ending = F.lit("")
    for k, e in enumerate(ENDINGS):
        ending = F.when(F.col("doc_id") % 6 == k, F.lit(e)).otherwise(ending)
    return d.withColumn("text", F.concat("text", ending))


_MASK_RULES = [(p, r) for _, p, r in tx.MASK_PATTERNS]


@register("mask_sensitive", f"SELECT doc_id, lang, {_sql_fold('text', _MASK_RULES)} AS masked_text FROM {_ENDED}")
def mask_sensitive(spark, sf):
    d = ended_documents(spark, sf)
    return d.select("doc_id", "lang", tx.mask_sensitive(F.col("text")).alias("masked_text"))


def _mask_stats_sql():
    cols, cur = [], "text"
    for name, p, r in tx.MASK_PATTERNS:
        cols.append(f"len(regexp_extract_all({cur}, {_sql_str(p)})) AS {name}_hits")
        cur = f"regexp_replace({cur}, {_sql_str(p)}, {_sql_str(_sql_repl(r))}, 'g')"
    inner = ", ".join(cols)
    sums = ", ".join(f"CAST(sum({n}_hits) AS BIGINT) AS {n}_hits" for n, _, _ in tx.MASK_PATTERNS)
    touched = " + ".join(f"{n}_hits" for n, _, _ in tx.MASK_PATTERNS)
    return (f"SELECT lang, count(*) AS documents, {sums}, count_if(({touched}) > 0) AS documents_touched "
            f"FROM (SELECT lang, {inner} FROM {_ENDED}) GROUP BY lang")


@register("mask_stats", _mask_stats_sql())
def mask_stats(spark, sf):
    d = ended_documents(spark, sf)
    hits = tx.mask_hits(F.col("text"))
    per = d.select("lang", *[v.alias(f"{k}_hits") for k, v in hits.items()])
    touched = sum((F.col(f"{k}_hits") for k in hits), F.lit(0)) > 0
    return per.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(f"{k}_hits").cast("long").alias(f"{k}_hits") for k in hits],
        F.count_if(touched).alias("documents_touched"))


@register("normalize_spacing", "SELECT conv_id, turn, trim(" +
          _sql_fold(_sql_fold("text", tx.SPACING_PHRASES), tx.SPACING_RULES) + ") AS clean_text FROM conversations")
def normalize_spacing(spark, sf):
    c = ad.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.normalize_spacing(F.col("text")).alias("clean_text"))


@register("normalize_spacing_docs", "SELECT doc_id, trim(" +
          _sql_fold(_sql_fold("text", tx.SPACING_PHRASES), tx.SPACING_RULES) + f") AS clean_text FROM {_ENDED}")
def normalize_spacing_docs(spark, sf):
    d = ended_documents(spark, sf)
    return d.select("doc_id", tx.normalize_spacing(F.col("text")).alias("clean_text"))


# RE2 has no look-behind; "\$ or $ -> \$" is the same map.
@register("escape_currency", r"SELECT doc_id, regexp_replace(text, '\\?\$', '\\$', 'g') AS escaped_text FROM documents")
def escape_currency(spark, sf):
    d = ad.table(spark, sf, "documents")
    return d.select("doc_id", tx.escape_currency(F.col("text")).alias("escaped_text"))


@register("join_split_amounts", "SELECT doc_id, " + _sql_fold("text", tx.SPLIT_AMOUNT_RULES) +
          f" AS joined_text FROM {_ENDED}")
def join_split_amounts(spark, sf):
    d = ended_documents(spark, sf)
    return d.select("doc_id", tx.join_split_amounts(F.col("text")).alias("joined_text"))


@register("preview_tokens", "SELECT conv_id, turn, substr(coalesce(text, ''), 1, 100) AS preview, "
          "CAST(floor(length(text) / 4) AS BIGINT) AS token_estimate FROM conversations")
def preview_tokens(spark, sf):
    c = ad.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.preview(F.col("text")).alias("preview"),
                    tx.token_estimate(F.col("text")).alias("token_estimate"))
