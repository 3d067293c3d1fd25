"""URL filters (operator 10): host-suffix and path-prefix rules.

Each distinct (host, path) is expanded into its host suffixes at label
borders, each with those prefixes of the path that have the length of some
rule's path.  The expressions are hashed; an equi-join on the first 32 bits
finds the rules in question, the full sha-256 digest confirms them, and the
longest rule wins (then the one with the longer host; block before allow).

Built from DataFrame functions only.  Pages with equal host and path are
judged once and joined back.

Defined results: a url that is null or has no ``://`` has an empty host and
path, which no rule fits; an empty path fits only rules with an empty path;
a rule with a null verdict is left out, a null host or path of a rule counts
as empty; repeated pages are all kept; without rules everything gets
``default``; an empty table gives an empty one; other columns are kept only
if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _host_part(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)


def _lower(text: Column | str) -> Column:
    """A-Z lower-cased, for the hosts of urls and rules alike."""
    return F.translate(text, _UPPER, _UPPER.lower())


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    return F.coalesce(_lower(_host_part(url)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = _after_scheme(url)
    rest = F.substring(rest, F.length(_host_part(url)) + 1, F.length(rest))
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: Sequence[str] = ("page_id",),
               default: str = "allow", hash_chars: int = 8) -> DataFrame:
    """``keep`` columns plus host, path, rule (host and path joined; null if
    none fits) and verdict.  ``rules`` has host, path, verdict."""
    known = rules.where(F.col("verdict").isNotNull()).select(
        F.coalesce(_lower("host"), F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    known = known.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("r_digest", F.sha2(F.concat("r_host", "r_path"), 256)).withColumn(
        "r_prefix", F.substring("r_digest", 1, hash_chars))
    # as many values as rule paths have lengths and rule hosts have numbers of labels: bounded by the length of a url
    shapes = known.select(F.collect_set(F.length("r_path")).alias("lengths"),
                          F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    lengths, labels = sorted(shapes.lengths), sorted(shapes.labels)

    rows = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
                        url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.array([F.lit(n) for n in labels] or [F.lit(0)]),
                           lambda n: F.when((n > 0) & (n <= F.size(parts)), F.array_join(F.slice(parts, -n, n), ".")))
    prefixes = F.transform(F.array([F.lit(n) for n in lengths] or [F.lit(-1)]),
                           lambda n: F.when((n >= 0) & (n <= F.length("path")), F.substring(F.col("path"), F.lit(1), n)))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    keys = rows.where(F.col("host") != "").select("host", "path").distinct()
    hits = (keys.withColumn("expression", F.explode(F.array_compact(expressions)))
            .withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, hash_chars))
            .join(known, F.col("prefix") == F.col("r_prefix")).where(F.col("digest") == F.col("r_digest")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), "verdict",
        F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    # rows without a host fit no rule; spread out, they share no key (no host holds a /)
    alone = F.concat(F.lit("/"), F.pmod(F.xxhash64(*[f"k_{i}" for i in range(len(keep))]), F.lit(1 << 20)).cast("string"))
    rows = rows.withColumn("at", F.when(F.col("host") != "", F.col("host")).otherwise(alone))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    return rows.join(best, (F.col("at") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
