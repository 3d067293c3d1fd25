"""Licence scans (operator 13): text blocks that contain a licence template.

A template is a short licence notice with a label.  A document is cut into
overlapping blocks: templates of at most w words (w a power of two) are
looked for in blocks of 2w words that begin every w words (at least every
``SECTION``), so each run of w
words lies whole in some block.  A block holds a template if at least
``threshold`` of the template's distinct words are among the block's.

The exact set-similarity join finds these pairs without comparing every block
with every template.  The words of the templates are ordered by the number of
documents that hold them, rarest first.  With ``need`` = ceil(threshold * size)
words to be shared:

* prefix filter: of the first size - need + 2 words of a template a block must
  hold two (one where need is 1), so only those words are joined;
* length filter: a block has at least ``need`` distinct words;
* positional filter: the words shared within the prefix and what can still be
  shared behind it, min(size - prefix, block - shared), must reach ``need``.

What remains is compared word by word.  All of it is DataFrame functions.  The
texts are read twice: for the frequencies of the templates' words, and for the
sections of ``SECTION`` words that hold a prefix word; only those are cut into
blocks (with very many templates all of them), and only blocks that share
prefix words are shuffled.

Beside that, ``phrases`` are looked for word for word: their places are
counted, and their labels always stay.

Defined results: a null or empty text has no words, labels '' and score 0; a
null id is an id like any other; repeated rows have a result each; templates
that are null or without words, or have a null label, are left out; several
templates may share a label; empty tables give empty results; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: what stands between words, once A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words of a text that are cut into blocks at a time
SECTION = 512
#: tables of words are broadcast up to so many rows
BROADCAST_WORDS = 100_000
#: up to so many words, texts without them are left out before any join
LITERAL_WORDS = 1000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are (texts of ASCII alone take the fast way)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def license_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def _literal(words: DataFrame) -> Column | None:
    """The words of a table as a constant array, if it is small."""
    rows = words.limit(LITERAL_WORDS + 1).collect()
    return F.array(*[F.lit(r.word) for r in rows]) if 0 < len(rows) <= LITERAL_WORDS else None


def _near(small: DataFrame, rows: int = BROADCAST_WORDS) -> DataFrame:
    """``small``, to be broadcast if it is counted to have few rows."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def template_words(docs: DataFrame, templates: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """One row per template and distinct word: template, label, word, its
    position in the global order, size, need, prefix (words joined on), width."""
    t = (templates.where(F.col("label").isNotNull()).select("label", license_words(F.col("text")).alias("ws"))
         .where(F.size("ws") > 0).distinct())
    t = t.select(F.xxhash64("label", "ws").alias("template"), "label", F.size("ws").alias("length"), F.array_distinct("ws").alias("tokens"))
    size = F.size("tokens")
    need = F.greatest(F.ceil(size * F.lit(threshold) - 1e-9), F.lit(1)).cast("int")
    t = t.select("template", "label", "tokens", size.alias("size"), need.alias("need"),
                 F.least(size, size - need + 2).alias("prefix"),
                 F.pow(F.lit(2), F.greatest(F.ceil(F.log2("length")), F.lit(2))).cast("int").alias("width"))
    t = stored(t, "license_templates")
    vocabulary = t.select(F.explode("tokens").alias("word")).distinct()
    # how many documents hold each of these words
    held, few = license_words(F.col(text_col)), _literal(vocabulary)
    seen = docs.select(F.explode(F.array_distinct(held) if few is None else F.array_intersect(held, few)).alias("word"))
    seen = seen.join(_near(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    freq = stored(vocabulary.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "license_frequencies")
    ordered = (t.select("template", F.explode("tokens").alias("word")).join(_near(freq), "word")
               .groupBy("template").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ordered")))
    return stored(t.drop("tokens").join(ordered, "template").select("*", F.expr("transform(ordered, x -> x.word)").alias("tokens"))
                  .drop("ordered"), "license_ordered")


def _blocks_of(words: str, width: int) -> Column:
    """The blocks of one width of a section: width, start (within it), distinct words."""
    starts = F.sequence(F.lit(0), F.greatest(F.least(F.size(words), F.lit(SECTION)) - 1, F.lit(0)), F.lit(width))
    return F.transform(starts, lambda i: F.struct(
        F.lit(width).alias("width"), i.alias("start"), F.array_distinct(F.slice(F.col(words), i + F.lit(1), F.lit(2 * width))).alias("held")))


def _sections(words: Column, reach: int, prefix: Column | None) -> Column:
    """Sections of a text, each with ``reach`` words behind it: first word and
    words.  With ``prefix`` only those that hold one of its words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(SECTION))
    cut = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(words, i + F.lit(1), F.lit(SECTION + reach)).alias("part")))
    return cut if prefix is None else F.when(F.arrays_overlap(words, prefix), F.filter(cut, lambda x: F.arrays_overlap(x["part"], prefix)))


def _found_blocks(sections: DataFrame, t: DataFrame, prefix: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Every block of (row, s: section) that holds a template: row, width,
    start (in words from 0), label, shared, size, containment."""
    blocks = sections.select("row", "s.first", F.col("s.part").alias("part")).where(F.size("part") > 0)
    blocks = blocks.select("row", "first", F.explode(F.concat(*[_blocks_of("part", w) for w in widths])).alias("b")).select(
        "row", F.col("b.width").alias("width"), (F.col("first") + F.col("b.start")).cast("long").alias("start"), F.col("b.held").alias("held"))
    hits = (blocks.select("*", F.explode("held").alias("word"))
            .join(_near(prefix), "word").where(F.col("width") == F.col("t_width")).where(F.size("held") >= F.col("need")))
    pairs = hits.groupBy("row", "width", "start", "template").agg(F.countDistinct("word").alias("in_prefix"), F.first("held").alias("held"))
    whole = t.select("template", "label", "size", "need", "prefix", "tokens")
    pairs = pairs.join(_near(whole, 10_000), "template").where(
        F.col("in_prefix") + F.least(F.col("size") - F.col("prefix"), F.size("held") - F.col("in_prefix")) >= F.col("need"))
    shared = F.size(F.array_intersect("held", "tokens"))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).select(
        "row", "width", "start", "label", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def _places(words: Column, phrase: Sequence[str], label: str) -> Column:
    """Array of (start, label) of the places where a phrase stands; null if the text lacks one of its words."""
    def stands(i: Column) -> Column:
        same = F.get(words, i).eqNullSafe(F.lit(phrase[0]))
        for k in range(1, len(phrase)):
            same = same & F.get(words, i + F.lit(k)).eqNullSafe(F.lit(phrase[k]))
        return same
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0))), stands)
    holds = F.lit(True)
    for w in phrase:
        holds = holds & F.array_contains(words, w)      # ends at the first word that is not there
    return F.when(holds, F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))


def phrase_places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Array of (start, label) of all places where a phrase stands word for word."""
    none = F.expr("cast(array() as array<struct<start:bigint,label:string>>)")
    return F.concat(none, *[F.coalesce(_places(words, phrase.split(" "), label), none) for phrase, label in phrases])


def _scan(docs: DataFrame, templates: DataFrame, phrases: Sequence[tuple[str, str]], threshold: float,
          id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Stored rows (row, doc_id, n_words, at), one for each of ``docs``, and the blocks found."""
    t = template_words(docs, templates, threshold, text_col)
    widths = [r.width for r in t.select("width").distinct().orderBy("width").collect()]     # at most 31 powers of two
    prefix = t.select("template", F.col("width").alias("t_width"), "need", F.explode(F.expr("slice(tokens, 1, prefix)")).alias("word"))
    ws = F.col("ws")
    sections = _sections(ws, 2 * max(widths), _literal(prefix.select("word").distinct())) if widths else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("ws"))
    # the texts are read once; a row gets its number as it is written
    rows = stored(rows.select("doc_id", F.size(ws).cast("long").alias("n_words"), phrase_places(ws, phrases).alias("at"), sections.alias("sections"))
                  .withColumn("row", F.monotonically_increasing_id()), "license_rows")
    if not widths:
        return rows, None
    return rows, _found_blocks(rows.select("row", F.explode("sections").alias("s")), t, prefix, widths)


def find_templates(docs: DataFrame, templates: DataFrame, threshold: float = 0.9,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Every block that holds a template: doc_id, width, start (in words from
    0), label, shared, size, containment; None if there is no template."""
    rows, found = _scan(docs, templates, [], threshold, id_col, text_col)
    return None if found is None else found.join(rows.select("row", "doc_id"), "row").drop("row")


def scan_licenses(docs: DataFrame, templates: DataFrame, phrases: Sequence[tuple[str, str]], threshold: float = 0.9,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base (places of phrases),
    first_word, last_word (their smallest and largest start), base_labels,
    labels (those of held templates too), score: 1 where a phrase stands, else
    the greatest containment of a template that a block holds, else 0."""
    rows, blocks = _scan(docs, templates, phrases, threshold, id_col, text_col)
    if blocks is None:
        both = rows.withColumn("found", F.expr("cast(null as array<string>)")).withColumn("best", F.lit(None).cast("double"))
    else:
        both = rows.drop("sections").join(blocks.groupBy("row").agg(
            F.collect_set("label").alias("found"), F.max("containment").alias("best")), "row", "left")
    none = F.expr("cast(array() as array<string>)")
    starts, base = F.expr("transform(at, x -> x.start)"), F.array_sort(F.array_distinct(F.expr("transform(at, x -> x.label)")))
    labels = F.array_sort(F.array_union(base, F.coalesce("found", none)))
    n_base = F.size("at").cast("long")
    return both.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                       F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
