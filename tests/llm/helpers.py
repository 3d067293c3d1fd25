"""Small tables with the awkward cases: nulls, empty and very long texts,
ties, repeated rows, and extra columns whose names an operator may use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long, part int, skey string, leaf long"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, la, s, -1, -5, -6, -7, -8, "x", -9) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def hard_rows():
    """Documents with every awkward case."""
    base = words(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, "a"), (4, None, "en", None), (5, "", None, "b"),
            (6, " \n\t ", "fr", "b"), (7, "one two", "en", "b"), (8, "one two", "en", "b"), (None, words(2, 80), "en", "c"),
            (9, words(3, 30_000), "de", "c"), (10, "x" * 50_000, "de", "c"), (11, "ünï \u00a0 cödé \u2028 \U0001f600 " * 20, "fr", "c"),
            (12, words(4, 90), "en", "hot"), (12, words(4, 90), "en", "hot"), (13, "line\n" * 40, "en", "hot"),
            (14, "<|endoftext|> </turn> ### x", "en", "hot")]
    rows += [(100 + k, words(50 + k, 60 + k), "en", "hot") for k in range(30)]
    return rows
