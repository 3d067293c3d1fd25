"""Queries: quality rules, fingerprints."""

from __future__ import annotations

from . import fingerprints, ngram_join, quality
from .common import stored, table
from .registry import register


WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6_SQL = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS tx, {WORD_SQL} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS k, ws FROM w WHERE len(ws) >= 3),
g3 AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM g3 WHERE c > 1) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM w),
f AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(tx, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(tx, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(tx, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(tx, '[^A-Za-z]', '', 'g')) AS n_letters,
  length(regexp_replace(tx, '[^!]', '', 'g')) AS n_bangs FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, [{', '.join(
    f"CAST(ceil(CASE WHEN {d} > 0 THEN least(CAST({n} AS DOUBLE) / {d}, 1.0) ELSE 0.0 END * {quality.BINS}) AS INT)"
    for n, d in (("n_symbols", "word_chars"), ("n_upper", "n_letters"), ("n_bangs", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")))}]
  AS bins FROM f),
marks AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT lang, good, unnest(range(1, 6)) AS rule, unnest(bins) AS bin FROM b JOIN marks USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT greatest(count(*), 1) AS n FROM (SELECT DISTINCT lang FROM lab)),
grid AS (SELECT lang, rule, c, CAST(count_if(good) AS BIGINT) AS n, CAST(count_if(good AND bin > c) AS BIGINT) AS k, CAST(count_if(NOT good AND bin > c) AS BIGINT) AS p
  FROM lab, range(0, {quality.BINS + 1}) AS t(c) GROUP BY ALL),
sure AS (SELECT grid.*, grid.n > 0 AND k <= grid.n * 0.01 AND list_sum(list_transform(range(0, CASE WHEN k <= grid.n * 0.01 THEN k + 1 ELSE 1 END),
    lambda i: exp(lgamma(grid.n + 1) - lgamma(i + 1) - lgamma(grid.n - i + 1) + i * ln(0.01) + (grid.n - i) * ln(0.99)))) <= 0.05 / (5 * strata.n) AS ok
  FROM grid, strata),
usable AS (SELECT *, p - 10.0 * k AS gain, max(c) FILTER (WHERE NOT ok) OVER (PARTITION BY lang, rule) AS stop FROM sure),
cuts AS (SELECT lang, rule, c FROM usable WHERE c > coalesce(stop, -1) AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, c DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.lang IS NOT DISTINCT FROM b.lang AND b.bins[cuts.rule] > cuts.c) AS kept
FROM b
"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORD_SQL} AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS gram FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
total AS (SELECT x, count(*) AS c FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(least_.y, d.doc_id)) AS class_id, coalesce(total.c, 0) AS n_links
FROM documents d LEFT JOIN least_ ON least_.x = d.doc_id LEFT JOIN total ON total.x = d.doc_id
"""


@register("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def judged(spark, sf_dir, docs, keep=("doc_id", "lang")):
    """Counts and verdict of all documents; cutoffs from the table of labels."""
    features = stored(quality.text_counts(docs, keep), "quality_counts")
    cuts = quality.cutoffs(quality.with_labels(features, table(spark, sf_dir, "labels")))
    return quality.judge(features, cuts)


@register("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark, sf_dir):
    return judged(spark, sf_dir, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op4_ngram_join", OP4_SQL)
def op4_ngram_join(spark, sf_dir):
    """Class and number of similar documents of every document."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
