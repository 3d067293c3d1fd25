"""Registered queries: documentation, chunks, similarity search, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as dc
from ..operators import history as hi
from ..session import scratch_path
from . import adapters as ad
from . import oracle as o
from .catalog import register
from .q_core import nation_flags


def _real(x):
    return o.real_text(x)


ACCOUNT_DOCS_SQL = f"""
docs AS (
  SELECT account_id,
         account_id || '_' || replace(replace(lower(account_name), '&', 'and'), ' ', '_') || '.md' AS source_file,
         concat_ws(chr(10),
           '# ' || account_id || ' ' || account_name,
           '',
           '## Purpose',
           'Ledger account for ' || account_name || ' (' || category || ', ' || coalesce(subcategory, 'general') || ').',
           coalesce(description, ''),
           '',
           '## Expected monthly range',
           coalesce('$' || {_real('typical_min')} || ' to $' || {_real('typical_max')}, 'not set'),
           '',
           '## Variance policy',
           printf('Movements above %.1f%% need a written explanation.', coalesce(variance_threshold_pct, 15.0)),
           'Changes above 15% go to the controller; above 30% to the CFO.',
           '',
           '## Seasonality',
           CASE WHEN is_seasonal THEN 'Seasonal account. Expected pattern: ' || coalesce(seasonal_pattern, 'not stated') || '.'
                ELSE 'Not seasonal: month-to-month movement should be small.' END) AS text
  FROM accounts
)"""


@register("account_docs", o.with_(o.SQL_ACCOUNTS_NATION, ACCOUNT_DOCS_SQL) + "SELECT * FROM docs")
def account_docs(spark, sf):
    return dc.account_docs(ad.accounts_from_nations(spark, sf))


@register("account_docs_customers", o.with_(o.SQL_ACCOUNTS_CUSTOMER, ACCOUNT_DOCS_SQL) + "SELECT * FROM docs")
def account_docs_customers(spark, sf):
    return dc.account_docs(ad.accounts_from_customers(spark, sf))


@register("missing_docs", o.with_(o.SQL_ACCOUNTS_NATION, ACCOUNT_DOCS_SQL) + """,
existing AS (SELECT d.source_file FROM docs d JOIN nation n ON d.account_id = CAST(n.n_nationkey AS VARCHAR)
             WHERE n.n_regionkey <> 4)
SELECT * FROM docs WHERE source_file NOT IN (SELECT source_file FROM existing)""")
def missing_docs(spark, sf):
    """Docs already written for every region but one; the rest are missing."""
    acc = ad.accounts_from_nations(spark, sf)
    nat = ad.table(spark, sf, "nation").filter(F.col("n_regionkey") != 4).select(
        F.col("n_nationkey").cast("string").alias("account_id"))
    existing = dc.account_docs(acc).join(nat, "account_id", "left_semi").select("source_file")
    return dc.missing_docs(acc, existing)


CHUNK_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(i AS INTEGER) AS chunk_no,
       substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk_text, CAST(i * 450 AS INTEGER) AS chunk_start
FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1
                                     ELSE CAST(ceil((length(text) - 50) / 450.0) AS BIGINT) END)) AS i
      FROM documents WHERE length(text) > 0)"""


@register("chunk_docs", CHUNK_SQL)
def chunk_docs(spark, sf):
    return dc.chunk_fixed(ad.table(spark, sf, "documents"))


def recursive_chunks_sql(name: str, src: str, id_col: str, size: int = 500, overlap: int = 50) -> str:
    """CTEs of separator-aware chunks ``{name}(id, chunk_no, chunk_text)`` of
    ``src`` (ids unique, column ``text``); for WITH RECURSIVE.  Pieces get
    their places by running sums, each piece is told by ASOF joins where a
    chunk that begins there ends and where the next one begins, and a walk
    follows these."""
    def cut(level: int, sep: str, below: str, rest: str) -> str:
        return f"""
{name}_{level} AS (SELECT {rest}, CASE WHEN k = 1 THEN p ELSE {sep} || p END AS p, k AS i{level} FROM (
  SELECT {rest}, unnest(string_split(p, {sep})) AS p, generate_subscripts(string_split(p, {sep}), 1) AS k FROM ({below})))"""
    nl = "chr(10)"
    return f"""
{name}_0 AS (SELECT {id_col} AS id, text AS p FROM {src} WHERE length(text) > 0),""" + cut(1, f"{nl} || {nl}", f"SELECT * FROM {name}_0", "id") + "," \
        + cut(2, nl, f"SELECT id, i1, p FROM {name}_1 WHERE length(p) >= {size}", "id, i1") + "," \
        + cut(3, "' '", f"SELECT id, i1, i2, p FROM {name}_2 WHERE length(p) >= {size}", "id, i1, i2") + f""",
{name}_atoms AS (
  SELECT id, i1, 0 AS i2, 0 AS i3, length(p) AS n, 'a' AS run FROM {name}_1 WHERE length(p) BETWEEN 1 AND {size - 1}
  UNION ALL SELECT id, i1, i2, 0, length(p), 'b' || i1 FROM {name}_2 WHERE length(p) BETWEEN 1 AND {size - 1}
  UNION ALL SELECT id, i1, i2, i3, length(p), CASE WHEN length(p) < {size} THEN 'c' || i1 || ':' || i2 ELSE 'd' || i1 || ':' || i2 || ':' || i3 END
  FROM {name}_3 WHERE length(p) > 0),
{name}_placed AS (SELECT *, sum(n) OVER w - n AS s, sum(n) OVER w AS e, run IS DISTINCT FROM lag(run) OVER w AS fresh
  FROM {name}_atoms WINDOW w AS (PARTITION BY id ORDER BY i1, i2, i3)),
{name}_island AS MATERIALIZED (SELECT id, s, e, run[1] = 'd' AS chars, sum(fresh::INT) OVER (PARTITION BY id ORDER BY s) AS island FROM {name}_placed),
{name}_stop AS (SELECT j.id, j.island, j.s, a.s AS stop, greatest(a.s - {overlap}, a.e - {size}) AS least_
  FROM {name}_island j ASOF LEFT JOIN {name}_island a ON j.id = a.id AND j.island = a.island AND j.s + {size} < a.e WHERE NOT j.chars),
{name}_next AS MATERIALIZED (SELECT j.*, b.s AS next FROM {name}_stop j ASOF LEFT JOIN {name}_island b ON j.id = b.id AND j.island = b.island AND j.least_ <= b.s),
{name}_walk AS (SELECT id, island, min(s) AS s FROM {name}_island WHERE NOT chars GROUP BY ALL
  UNION ALL SELECT w.id, w.island, x.next FROM {name}_walk w JOIN {name}_next x ON x.id = w.id AND x.island = w.island AND x.s = w.s WHERE x.stop IS NOT NULL),
{name}_ends AS (SELECT id, island, max(e) AS e FROM {name}_island GROUP BY ALL),
{name}_spans AS (
  SELECT w.id, w.s, coalesce(x.stop, z.e) AS e FROM {name}_walk w JOIN {name}_next x ON x.id = w.id AND x.island = w.island AND x.s = w.s
    JOIN {name}_ends z ON z.id = w.id AND z.island = w.island
  UNION ALL SELECT id, s + k * {size - overlap}, least(e, s + k * {size - overlap} + {size}) FROM (
    SELECT id, s, e, unnest(range(0, greatest(1, CAST(ceil((e - s - {overlap}) / {size - overlap}.0) AS BIGINT)))) AS k FROM {name}_island WHERE chars)),
{name}_texts AS (SELECT c.id, c.s, regexp_replace(substr(d.p, CAST(c.s + 1 AS BIGINT), CAST(c.e - c.s AS BIGINT)),
    '^[\\s\\pZ\\x{{85}}\\x1c-\\x1f]+|[\\s\\pZ\\x{{85}}\\x1c-\\x1f]+$', '', 'g') AS chunk_text FROM {name}_spans c JOIN {name}_0 d ON c.id = d.id),
{name} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS chunk_no, chunk_text FROM {name}_texts WHERE chunk_text <> '')"""


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.strip()[len("WITH"):]


@register("chunk_docs_recursive", "WITH RECURSIVE" + recursive_chunks_sql("ch", "documents", "doc_id") + """
SELECT doc_id, lang, chunk_no, chunk_text FROM ch JOIN documents ON id = doc_id""")
def chunk_docs_recursive(spark, sf):
    """Separator-aware chunks of every document."""
    d = ad.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return dc.chunk_recursive(d)


def vectors_sql(name: str, src: str, id_col: str, text_col: str, corpus: str | None = None) -> str:
    """CTEs of tf-idf vectors ``{name}(id, v)`` of a source (256 hashed
    buckets); ``corpus`` names the vectors whose frequencies are used."""
    freq = corpus or name
    own = "" if corpus else f""",
{name}_idf AS (SELECT b, ln(((SELECT count(*) FROM {src}) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM {name}_tf GROUP BY b)"""
    return f"""
{name}_tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(tx), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t
  FROM (SELECT {id_col} AS id, {text_col} AS tx FROM {src})),
{name}_tf AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 256 AS b, count(*) AS tf FROM {name}_tok GROUP BY ALL){own},
{name}_w AS (SELECT id, f.b, tf * idf AS w FROM {name}_tf f JOIN {freq}_idf USING (b)),
{name}_m AS (SELECT id, map_from_entries(list({{'k': b, 'v': w}})) AS m, sqrt(sum(w * w)) AS n FROM {name}_w GROUP BY id),
{name} AS (SELECT s.{id_col} AS id, list_transform(range(256), lambda i: CASE WHEN n > 0 THEN coalesce(m[i], 0.0) / n ELSE 0.0 END) AS v
  FROM {src} s LEFT JOIN {name}_m ON s.{id_col} = {name}_m.id)"""


EMBED_SQL = "WITH c AS (" + CHUNK_SQL + "), ch AS (SELECT doc_id || ':' || chunk_no AS chunk_id, chunk_text FROM c)," + vectors_sql(
    "vec", "ch", "chunk_id", "chunk_text") + """
SELECT id AS chunk_id, list_transform(v, lambda x: round(x, 6) + 0.0) AS embedding FROM vec"""


@register("embed_chunks", EMBED_SQL)
def embed_chunks(spark, sf):
    """Tf-idf vectors of every chunk, rounded to 6 decimals."""
    ch = dc.chunk_fixed(ad.table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk_text")
    return dc.embed_chunks(ch, decimals=6).select("chunk_id", "embedding")


@register("dedupe_chunks", "WITH c AS (" + CHUNK_SQL + """),
h AS (SELECT *, sha256(chunk_text) AS content_hash FROM c)
SELECT source, content_hash,
       min(doc_id) AS doc_id_first, count(*) AS copies
FROM h GROUP BY source, content_hash""")
def dedupe_chunks(spark, sf):
    d = dc.dedupe_chunks(dc.chunk_fixed(ad.table(spark, sf, "documents")), key="source")
    return d.select("source", "content_hash", F.col("doc_id").alias("doc_id_first"), "copies")


@register("add_documents", "WITH RECURSIVE" + recursive_chunks_sql("ch", "documents", "doc_id") + """,
h AS (SELECT lang, sha256(chunk_text) AS content_hash FROM ch JOIN documents ON id = doc_id)
SELECT lang, content_hash, count(*) AS copies FROM h GROUP BY lang, content_hash""")
def add_documents(spark, sf):
    """Chunks of the en/fr documents, then the de/es documents added."""
    docs = ad.table(spark, sf, "documents").select("doc_id", "lang", "text")
    base = dc.chunk_recursive(docs.filter(F.col("lang").isin("en", "fr")))
    out = dc.add_documents(base, docs.filter(~F.col("lang").isin("en", "fr")), key="lang")
    return out.select("lang", "content_hash", "copies")


TOPK_SQL = """
SELECT query_id, chunk_id, CAST(rk AS INTEGER) AS rank, similarity FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
             round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC,
             c.vec_id) AS rk
  FROM embeddings q JOIN embeddings c ON {on} AND q.vec_id <> c.vec_id)
WHERE rk <= {k}"""


@register("topk_docs", TOPK_SQL.format(on="q.label = c.label", k=3))
def topk_docs(spark, sf):
    """3 nearest vectors of the same label (label plays the account)."""
    e = ad.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return dc.topk_similar(q, c, k=3, key="label", exclude_self=True, block_size=64)


@register("similar_past_anomalies", TOPK_SQL.format(on="TRUE", k=5))
def similar_past_anomalies(spark, sf):
    """5 nearest vectors with no key filter, in the cells that can hold them."""
    q, c = (x.drop("label") for x in _labelled(spark, sf))
    return dc.topk_pruned(q, c, k=5, exclude_self=True, cells=40)


@register("context_rollup", "WITH hits AS (" + TOPK_SQL.format(on="q.label = c.label", k=3) + """),
ch AS (SELECT vec_id AS chunk_id, 'vector ' || CAST(vec_id AS VARCHAR) AS chunk_text,
              'label_' || CAST(label AS VARCHAR) || '.vec' AS source_file FROM embeddings),
j AS (SELECT h.query_id AS anomaly_id, h.rank, ch.chunk_text, ch.source_file FROM hits h JOIN ch USING (chunk_id))
SELECT anomaly_id,
       coalesce(max(chunk_text) FILTER (WHERE rank = 1), 'No documentation found') AS account_documentation,
       list(chunk_text ORDER BY rank) FILTER (WHERE rank > 1) AS similar_cases,
       list(source_file ORDER BY rank) AS source_files
FROM j GROUP BY anomaly_id""")
def context_rollup(spark, sf):
    e = ad.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    hits = dc.topk_similar(q, c, k=3, key="label", exclude_self=True, block_size=64)
    chunks = e.select(F.col("vec_id").alias("chunk_id"),
                      F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("chunk_text"),
                      F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(".vec")).alias("source_file"))
    return dc.context_rollup(hits.withColumnRenamed("query_id", "anomaly_id"), chunks)


@register("retrieval_queries", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """
SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, gl_account_id, month,
       printf('%s %s changed %.2f%% in %s (%s)', gl_account_id, account_name,
              CAST(round(CAST(variance_percent AS DECIMAL(38,6)), 2) AS DOUBLE),
              current_month, direction) AS query_text
FROM flags""")
def retrieval_queries(spark, sf):
    return dc.retrieval_queries(nation_flags(spark, sf))


def nation_chunks(spark, sf):
    docs = dc.account_docs(ad.accounts_from_nations(spark, sf))
    ch = dc.chunk_recursive(docs, size=200, overlap=20)
    return ch.withColumn("chunk_id", F.concat_ws(":", F.col("source_file"), F.col("chunk_no").cast("string")))


_QUERY_TEXT = """printf('%s %s changed %.2f%% in %s (%s)', gl_account_id, account_name,
  CAST(round(CAST(variance_percent AS DECIMAL(38,6)), 2) AS DOUBLE), current_month, direction)"""
_NATION_CHUNKS = ACCOUNT_DOCS_SQL + "," + recursive_chunks_sql("rc", "docs", "source_file", 200, 20) + """,
ch AS (SELECT account_id, source_file, source_file || ':' || chunk_no AS chunk_id, chunk_text FROM rc JOIN docs ON id = source_file)"""
RETRIEVE_SQL = recursive(o.DETECT_NATION) + "," + o.FLAGS + "," + _NATION_CHUNKS + """,
qs AS (SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, gl_account_id, """ + _QUERY_TEXT + """ AS query_text FROM flags),""" \
    + vectors_sql("cv", "ch", "chunk_id", "chunk_text") + "," + vectors_sql("qv", "qs", "anomaly_id", "query_text", corpus="cv") + """,
near AS (SELECT qs.anomaly_id, ch.chunk_id, ch.chunk_text, ch.source_file, row_number() OVER (PARTITION BY qs.anomaly_id
           ORDER BY round(list_cosine_similarity(qv.v, cv.v), 6) DESC, ch.chunk_id) AS rank
  FROM qs JOIN qv ON qv.id = qs.anomaly_id JOIN ch ON ch.account_id = qs.gl_account_id JOIN cv ON cv.id = ch.chunk_id
  WHERE NOT isnan(list_cosine_similarity(qv.v, cv.v))),
ctx AS (SELECT anomaly_id, max(chunk_text) FILTER (WHERE rank = 1) AS doc, list(chunk_text ORDER BY rank) FILTER (WHERE rank IN (2, 3)) AS more,
          list(source_file ORDER BY rank) AS files FROM near WHERE rank <= 3 GROUP BY anomaly_id),
hist AS (SELECT gl_account_id, least(count(*), 3) AS n FROM flags GROUP BY gl_account_id)
SELECT qs.anomaly_id, qs.gl_account_id, coalesce(doc, 'No documentation found') AS account_documentation,
       coalesce(more, []) AS similar_cases, coalesce(files, []) AS source_files, coalesce(n, 0) AS past_anomaly_count
FROM qs LEFT JOIN ctx USING (anomaly_id) LEFT JOIN hist USING (gl_account_id)"""


@register("retrieve_context", RETRIEVE_SQL)
def retrieve_context(spark, sf):
    """Context of every flagged account-month of the dense ledger: top-3
    chunks of its generated documentation + capped history count."""
    flags = nation_flags(spark, sf)
    inv = hi.investigations_from_flags(flags)
    return dc.retrieve_context(flags, nation_chunks(spark, sf), history_counts=hi.history_count(inv)).select(
        "anomaly_id", "gl_account_id", "account_documentation", "similar_cases", "source_files", "past_anomaly_count")


@register("attach_context", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """
SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, severity, severity = 'high' AS has_context
FROM flags""")
def attach_context(spark, sf):
    """Flags joined to context from the high-severity-only retrieval; the
    medium / low ones are the skipped (anti-join) side, counted here."""
    flags = nation_flags(spark, sf)
    ctx = dc.retrieve_context(flags, nation_chunks(spark, sf), only_high=True)
    joined, skipped = dc.attach_context(flags, ctx)
    return (joined.select("anomaly_id", "severity", F.lit(True).alias("has_context"))
            .unionByName(skipped.select("anomaly_id", "severity", F.lit(False).alias("has_context"))))


@register("sink_account_docs", o.with_(o.SQL_ACCOUNTS_CUSTOMER, ACCOUNT_DOCS_SQL) + "SELECT account_id, text FROM docs")
def sink_account_docs(spark, sf):
    """Generated docs written as a JSON-lines table and read back."""
    from ..session import scratch_path
    from ..sources import files as fs
    path = scratch_path(spark, "account_docs")
    fs.sink_account_docs(dc.account_docs(ad.accounts_from_customers(spark, sf)), path)
    return spark.read.schema("account_id string, source_file string, text string").json(path).select(
        "account_id", "text")


@register("scan_docs", o.with_(o.SQL_ACCOUNTS_NATION, ACCOUNT_DOCS_SQL) + "SELECT account_id, text FROM docs")
def scan_docs(spark, sf):
    """Documentation files scanned from a folder; the account is the file
    stem up to the first ``_``.  Spark names the files it writes itself, so
    each file's own name is given by its folder, and the stem rule is applied
    to that name as the scan applies it to a real one."""
    from ..session import scratch_path
    from ..sources import files as fs
    path = scratch_path(spark, "docs_folder")
    docs = dc.account_docs(ad.accounts_from_nations(spark, sf))
    fs.sink_account_docs(docs, path, folder_per_account=True)
    back = fs.scan_docs(spark, path, account_from="folder")
    named = back.join(docs.select("account_id", F.col("source_file").alias("file_name")), "account_id")
    return named.select(fs.account_of_file(F.col("file_name")).alias("account_id"),
                        F.regexp_replace("text", r"\n$", "").alias("text"))


@register("similar_past_anomalies_text", recursive(o.DETECT_NATION) + "," + o.FLAGS + "," + _NATION_CHUNKS + """,
qs AS (SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, 'Historical anomaly: ' || """ + _QUERY_TEXT
          + """ AS query_text FROM flags),""" + vectors_sql("cv", "ch", "chunk_id", "chunk_text") + ","
          + vectors_sql("qv", "qs", "anomaly_id", "query_text", corpus="cv") + """
SELECT query_id, chunk_id, CAST(rk AS INTEGER) AS rank, similarity FROM (
  SELECT qv.id AS query_id, cv.id AS chunk_id, round(list_cosine_similarity(qv.v, cv.v), 6) AS similarity,
         row_number() OVER (PARTITION BY qv.id ORDER BY round(list_cosine_similarity(qv.v, cv.v), 6) DESC, cv.id) AS rk
  FROM qv JOIN cv ON TRUE WHERE NOT isnan(list_cosine_similarity(qv.v, cv.v))) WHERE rk <= 5""")
def similar_past_anomalies_text(spark, sf):
    """5 nearest documentation chunks to each flagged row's query sentence
    prefixed ``Historical anomaly: ``, across all accounts."""
    return dc.similar_past_anomalies(nation_flags(spark, sf), nation_chunks(spark, sf))


def _labelled(spark, sf):
    e = ad.table(spark, sf, "embeddings")
    return (e.select(F.col("vec_id").alias("query_id"), "embedding", "label"),
            e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"))


def _indexed(spark, sf):
    q, c = _labelled(spark, sf)
    path = scratch_path(spark, "lsh_index")
    dc.build_lsh_index(c, path, key="label")
    return dc.topk_docs_lsh(spark, q, path, k=3, key="label", exclude_self=True)


@register("topk_docs_lsh")
def topk_docs_lsh(spark, sf):
    """3 nearest vectors of the same label by the stored index."""
    return _indexed(spark, sf)


@register("topk_docs_lsh_recall", """
SELECT label, CAST(sum(least(n - 1, 3)) AS DOUBLE) AS wanted, TRUE AS recall_at_least_90, TRUE AS similarities_exact
FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n FROM embeddings) GROUP BY label""")
def topk_docs_lsh_recall(spark, sf):
    """Per label: how many neighbours the exact search finds, whether the
    index finds nine of ten of them, and whether all it finds are as near as
    it says."""
    q, c = _labelled(spark, sf)
    exact = dc.topk_similar(q, c, k=3, key="label", exclude_self=True)
    found = _indexed(spark, sf).select("query_id", "chunk_id", F.col("similarity").alias("found"))
    both = exact.join(found, ["query_id", "chunk_id"], "left").join(q.select("query_id", "label"), "query_id")
    return both.groupBy("label").agg(
        F.count(F.lit(1)).cast("double").alias("wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_at_least_90"),
        F.min(F.coalesce(F.col("found") == F.col("similarity"), F.lit(True))).alias("similarities_exact"))


def letter_counts():
    """A model for :func:`operators.docs.embed_with`: how often a text has each letter from a to p."""
    def embed(texts):
        return [[t.count(chr(97 + i)) for i in range(16)] for t in texts]
    return embed


_LETTERS = "list_transform(range(16), lambda i: CAST(length({0}) - length(replace({0}, chr(CAST(97 + i AS INT)), '')) AS DOUBLE))"


@register("embed_with", f"""
SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_LETTERS.format('text')} END AS embedding FROM documents""")
def embed_with(spark, sf):
    """Vectors of all documents from a model that each worker sets up itself."""
    d = ad.table(spark, sf, "documents").select("doc_id", "text")
    return dc.embed_with(d, "text", letter_counts, dim=16).select("doc_id", "embedding")


@register("retrieve_context_model", recursive(o.DETECT_NATION) + "," + o.FLAGS + "," + _NATION_CHUNKS + """,
qs AS (SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, gl_account_id, """ + _QUERY_TEXT + f""" AS query_text FROM flags),
near AS (SELECT qs.anomaly_id, ch.chunk_id, ch.source_file, ch.chunk_text, row_number() OVER (PARTITION BY qs.anomaly_id
           ORDER BY round(list_cosine_similarity({_LETTERS.format('query_text')}, {_LETTERS.format('chunk_text')}), 6) DESC, ch.chunk_id) AS rank
  FROM qs JOIN ch ON ch.account_id = qs.gl_account_id)
SELECT anomaly_id, max(chunk_text) FILTER (WHERE rank = 1) AS account_documentation,
       coalesce(list(chunk_text ORDER BY rank) FILTER (WHERE rank IN (2, 3)), []) AS similar_cases
FROM near WHERE rank <= 3 GROUP BY anomaly_id""")
def retrieve_context_model(spark, sf):
    """Retrieval context by vectors from a model given by the caller."""
    def embed(df, text_col):
        return dc.embed_with(df, text_col, letter_counts, dim=16)
    return dc.retrieve_context(nation_flags(spark, sf), nation_chunks(spark, sf), embed=embed).select(
        "anomaly_id", "account_documentation", "similar_cases")
