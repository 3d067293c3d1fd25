"""Registered queries: explanations, report sections, report, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as hi
from ..operators import report as rp
from . import adapters as ad
from . import oracle as o
from .catalog import ORACLE, register
from .q_core import nation_flags
from .q_history import INV_SQL

REPORT_MONTH = "2000-06"


def money(x):
    return f"printf('%,.2f', CAST(CAST({x} AS DECIMAL(38,2)) AS DOUBLE))"


def fmt2(x):
    return f"printf('%.2f', CAST(round(CAST({x} AS DECIMAL(38,6)), 2) AS DOUBLE))"


def sign(x):
    return f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END)"


EXPLAIN_SQL = f"""
ex AS (
  SELECT strftime(f.month, '%Y%m') || '-' || f.gl_account_id AS anomaly_id, f.gl_account_id, f.month, f.severity,
         coalesce(f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max, FALSE)
           OR coalesce(a.is_seasonal, FALSE) AS is_expected_variance,
         CAST(round(least(CAST(0.95 AS DECIMAL(12,5)),
               CAST(CAST(0.5 AS DECIMAL(12,5)) + CAST(abs(coalesce(f.z_score, 0.0)) AS DECIMAL(12,4)) / 10 AS DECIMAL(12,5))), 2)
              AS DOUBLE) AS confidence,
         concat_ws(chr(10),
           '1. The balance changed by ' || {sign('f.variance_percent')} || {fmt2('f.variance_percent')} || '% ('
             || {sign('f.variance_amount')} || {money('f.variance_amount')} || ').',
           '2. Typical range ' || coalesce(f.typical_range, 'N/A') || ': the balance is '
             || CASE WHEN f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max THEN 'inside it.'
                     WHEN (f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max) IS NULL THEN 'not comparable.'
                     ELSE 'outside it.' END,
           '3. Z-score ' || coalesce({fmt2('f.z_score')}, 'N/A') || ', past anomalies ' || CAST(coalesce(f.past_anomaly_count, 0) AS VARCHAR) || '.',
           CASE WHEN coalesce(f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max, FALSE)
                     OR coalesce(a.is_seasonal, FALSE) THEN '4. Conclusion: expected variance.'
                ELSE '4. Conclusion: true anomaly, needs investigation.' END) AS chain_of_thought,
         'Balance moved from ' || {money('f.previous_balance')} || ' to ' || {money('f.current_balance')} || ' ('
           || {sign('f.variance_percent')} || {fmt2('f.variance_percent')} || '%); '
           || CASE WHEN coalesce(f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max, FALSE)
                   THEN 'still inside the typical range'
                   WHEN coalesce(a.is_seasonal, FALSE) THEN 'consistent with a seasonal account'
                   ELSE 'outside the expected pattern' END AS root_cause,
         ['Current balance ' || {money('f.current_balance')},
          'Previous balance ' || {money('f.previous_balance')},
          'Change ' || {sign('f.variance_amount')} || {money('f.variance_amount')},
          'Typical range ' || coalesce(f.typical_range, 'N/A'),
          'Z-score ' || coalesce({fmt2('f.z_score')}, 'N/A')] AS supporting_evidence,
         CASE f.severity WHEN 'high' THEN 'Review the transactions behind this change now.'
                         WHEN 'medium' THEN 'Review within 48 hours.' ELSE 'Monitor next month.' END AS recommendation,
         f.severity = 'high' AND NOT (coalesce(f.current_balance >= a.typical_min AND f.current_balance <= a.typical_max, FALSE)
           OR coalesce(a.is_seasonal, FALSE)) AS requires_immediate_attention
  FROM flags f LEFT JOIN accounts a ON f.gl_account_id = a.account_id
)"""

SECTIONS_SQL = f"""
sec AS (
  SELECT x.anomaly_id, f.gl_account_id, f.month, f.severity, f.variance_percent,
         concat_ws(chr(10),
           '### ' || CASE f.severity WHEN 'high' THEN '[HIGH]' WHEN 'medium' THEN '[MEDIUM]' ELSE '[LOW]' END
             || ' ' || f.gl_account_id || ' - ' || coalesce(f.account_name, ''),
           '**Change:** ' || CASE WHEN f.direction = 'increase' THEN 'up' ELSE 'down' END || ' '
             || {sign('f.variance_percent')} || {fmt2('f.variance_percent')} || '%' || ' ('
             || {sign('f.variance_amount')} || {money('f.variance_amount')} || ')',
           '**Balance:** ' || {money('f.previous_balance')} || ' -> ' || {money('f.current_balance')},
           '**Assessment:** ' || CASE WHEN x.is_expected_variance THEN 'expected variance' ELSE 'anomalous' END
             || ', confidence ' || printf('%.0f%%', x.confidence * 100),
           '**Root cause:** ' || x.root_cause,
           '**Detailed reasoning:**' || chr(10) || x.chain_of_thought,
           '**Evidence:**',
           array_to_string(list_transform(x.supporting_evidence, lambda e: '- ' || replace(e, '$', '\\$')), chr(10)),
           '**Recommendation:** ' || x.recommendation,
           CASE WHEN x.requires_immediate_attention THEN '**Needs immediate attention**' END) AS section_text
  FROM flags f JOIN ex x ON strftime(f.month, '%Y%m') || '-' || f.gl_account_id = x.anomaly_id
)"""

BASE = o.DETECT_NATION.rstrip() + "," + o.FLAGS + "," + EXPLAIN_SQL + "\n"


def flags_and_explanations(spark, sf):
    flags = nation_flags(spark, sf)
    return flags, rp.explain_anomalies(flags, ad.accounts_from_nations(spark, sf))


@register("explain_anomalies", BASE + "SELECT * FROM ex")
def explain_anomalies(spark, sf):
    return flags_and_explanations(spark, sf)[1].select(*rp.EXPLANATION_COLS)


@register("report_sections", BASE.rstrip() + "," + SECTIONS_SQL + "\nSELECT * FROM sec")
def report_sections(spark, sf):
    _, ex = flags_and_explanations(spark, sf)
    return rp.report_sections(ex)


def report_sql(month_sql: str, label_sql: str) -> str:
    """The report's lines for one month; nothing when the month has no flags."""
    recs = "' || chr(10) || '".join("- " + r for r in rp.RECOMMENDATIONS)
    return BASE.rstrip() + "," + SECTIONS_SQL + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY abs(variance_percent) DESC, gl_account_id) AS rk
      FROM sec WHERE month = {month_sql}),
c AS (SELECT count(*) AS n, count_if(severity = 'high') AS h, count_if(severity = 'medium') AS md FROM s)
SELECT 0 AS section, 0 AS line_no,
       '# Variance report ' || {label_sql} || chr(10) || chr(10) || CAST(n AS VARCHAR) || ' anomalies: '
       || CAST(h AS VARCHAR) || ' high, ' || CAST(md AS VARCHAR) || ' medium' AS text FROM c WHERE n > 0
UNION ALL
SELECT CASE WHEN severity = 'high' THEN 1 ELSE 2 END, CAST(rk AS INTEGER), section_text FROM s
WHERE severity = 'high' OR (severity = 'medium' AND rk <= 3)
UNION ALL
SELECT 2, 1000000, '(showing top 3 of ' || CAST(md AS VARCHAR) || ' medium items)' FROM c WHERE md > 3
UNION ALL
SELECT 3, 0, '## Recommendations' || chr(10) || '{recs}' FROM c WHERE n > 0"""


REPORT_SQL = report_sql(f"DATE '{REPORT_MONTH}-01'", f"'{REPORT_MONTH}'")

# the whole-analysis chain reports the ledger's newest month
_NEWEST = "(SELECT CAST(date_trunc('month', max(transaction_date)) AS DATE) FROM ledger)"
ORACLE["run_analysis"] = report_sql(_NEWEST, f"strftime({_NEWEST}, '%Y-%m')")


@register("report", REPORT_SQL)
def report(spark, sf):
    _, ex = flags_and_explanations(spark, sf)
    return rp.report_lines(rp.report_sections(ex), REPORT_MONTH)


@register("report_summary", o.DETECT_NATION.rstrip() + "," + o.FLAGS + f"""
SELECT count(*) AS anomalies_detected, count_if(severity = 'high') AS high_severity_count,
       count_if(severity = 'medium') AS medium_severity_count, count_if(severity = 'low') AS low_severity_count,
       (SELECT count(*) FROM accounts) AS accounts_analyzed, '{REPORT_MONTH}' AS target_month
FROM flags WHERE month = DATE '{REPORT_MONTH}-01'""")
def report_summary(spark, sf):
    return rp.report_summary(nation_flags(spark, sf), ad.accounts_from_nations(spark, sf), REPORT_MONTH)


@register("explanation_requests", o.DETECT_NATION.rstrip() + "," + o.FLAGS + "," + INV_SQL + f""",
h AS (SELECT gl_account_id,
             string_agg(strftime(detected_month, '%Y-%m') || ': ' || {fmt2('variance_percent')} || '% (' || severity || ')',
                        chr(10) ORDER BY detected_month DESC, anomaly_id DESC) AS history_text
      FROM (SELECT *, row_number() OVER (PARTITION BY gl_account_id ORDER BY detected_month DESC, anomaly_id DESC) AS r
            FROM inv) WHERE r <= 5 GROUP BY gl_account_id)
SELECT strftime(f.month, '%Y%m') || '-' || f.gl_account_id AS anomaly_id, f.gl_account_id, f.month,
       concat_ws(chr(10),
         'Account: ' || f.gl_account_id || ' ' || coalesce(f.account_name, ''),
         'Month: ' || f.current_month || ' vs ' || f.previous_month,
         'Current balance: ' || {money('f.current_balance')},
         'Previous balance: ' || {money('f.previous_balance')},
         'Change: ' || {sign('f.variance_amount')} || {money('f.variance_amount')} || ' ('
           || {sign('f.variance_percent')} || {fmt2('f.variance_percent')} || '%' || ')',
         'Transactions: ' || CAST(f.transaction_count AS VARCHAR),
         '3-month average: ' || coalesce({fmt2('f.rolling_3mo_avg')}, 'N/A'),
         '6-month std dev: ' || coalesce({fmt2('f.rolling_6mo_std')}, 'N/A'),
         'Z-score: ' || coalesce({fmt2('f.z_score')}, 'N/A'),
         'Typical range: ' || coalesce(f.typical_range, 'N/A')) AS facts,
       coalesce(h.history_text, 'No past investigations') AS history_text
FROM flags f LEFT JOIN h ON f.gl_account_id = h.gl_account_id""")
def explanation_requests(spark, sf):
    flags = nation_flags(spark, sf)
    inv = hi.investigations_from_flags(flags)
    return rp.explanation_requests(flags, history=inv).select("anomaly_id", "gl_account_id", "month", "facts",
                                                              "history_text")


@register("sink_report", "WITH lines AS (" + REPORT_SQL + """),
flat AS (SELECT section, line_no, unnest(string_split(text, chr(10))) AS text,
                unnest(range(len(string_split(text, chr(10))))) AS k FROM lines)
SELECT row_number() OVER (ORDER BY section, line_no, k) AS line, text FROM flat""")
def sink_report(spark, sf):
    """The report written as ordered text parts and read back: every line
    with its place in the whole report.  The window runs over one row per
    part."""
    from pyspark.sql import Window

    from ..session import scratch_path
    from ..sources import files as fs
    _, ex = flags_and_explanations(spark, sf)
    path = scratch_path(spark, "report")
    fs.sink_report(rp.report_lines(rp.report_sections(ex), REPORT_MONTH), path)
    parts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("part"),
        F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("lines"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    return placed.select("before", F.posexplode("lines").alias("k", "text")).select(
        (F.col("before") + F.col("k") + 1).alias("line"), "text")


@register("parse_sections")
def parse_sections(spark, sf):
    """Explanations rendered as marked-up text and parsed back into
    sections (the SQL twin below replaces the look-ahead, which DuckDB's
    regex engine lacks, by a consumed alternative)."""
    from ..functions import text as tx
    _, ex = flags_and_explanations(spark, sf)
    marked = F.concat(F.lit("**Root Cause**: "), F.col("root_cause"),
                      F.lit("\n**Recommendation**: "), F.col("recommendation"),
                      F.lit("\n**Supporting Evidence**: "), F.array_join("supporting_evidence", ", "))
    return ex.select("anomaly_id", tx.parse_sections(marked).alias("sections")).select("anomaly_id", "sections.*")


_NUM = "regexp_matches(regexp_replace(trim(x), '^-\\s*', ''), '^[0-9.]+$') AND regexp_matches(trim(x), '[0-9]')"
_LAST = "string_split(acc, chr(30))[-1]"
_GROUP = "(\\\\\\$\\d+)(\\d{3})(\\D|$)"


def _group_sql(x: str, rounds: int = 6) -> str:
    for _ in range(rounds):
        x = f"regexp_replace({x}, '{_GROUP}', '\\1,\\2\\3', 'g')"
    return x


MERGE_SQL = BASE + f"""
SELECT anomaly_id, broken,
       list_transform(string_split(list_reduce(broken, lambda acc, x:
           CASE WHEN {_NUM} AND (ends_with({_LAST}, '\\$') OR starts_with(trim(x), '-'))
                THEN acc || regexp_replace(trim(x), '^-\\s*', '')
                ELSE acc || chr(30) || x END), chr(30)), lambda s: {_group_sql('s')}) AS merged
FROM (SELECT anomaly_id,
             flatten(list_transform(supporting_evidence, lambda e:
               CASE WHEN regexp_matches(e, '\\d,\\d{{3}}\\.\\d\\d$')
                    THEN [regexp_replace(e, '(\\d+),(\\d{{3}})\\.(\\d\\d)$', '\\\\$\\1'),
                          '-' || regexp_extract(e, '(\\d{{3}}\\.\\d\\d)$', 1)]
                    ELSE [e] END)) AS broken
      FROM ex)"""


@register("merge_split_evidence", MERGE_SQL)
def merge_split_evidence(spark, sf):
    """Evidence lists with every amount split at its thousands comma into
    ``... \\$812`` and ``-237.81`` (as a list split mid-amount arrives),
    merged back into ``\\$812,237.81``."""
    from ..functions import text as tx
    _, ex = flags_and_explanations(spark, sf)
    broken = F.flatten(F.transform("supporting_evidence", lambda e: F.when(
        e.rlike(r"\d,\d{3}\.\d\d$"),
        F.array(F.regexp_replace(e, r"(\d+),(\d{3})\.(\d\d)$", r"\\\$$1"),
                F.concat(F.lit("-"), F.regexp_extract(e, r"(\d{3}\.\d\d)$", 1))))
        .otherwise(F.array(e))))
    return ex.select("anomaly_id", broken.alias("broken"), tx.merge_split_evidence(broken).alias("merged"))


def _band_explainer(batches):
    """Example user explanation hook: runs per Arrow batch in pandas."""
    import pandas as pd
    for pdf in batches:
        band = pd.cut(pdf["variance_percent"].abs(), [0, 30, 100, 1000, float("inf")],
                      labels=["moderate", "large", "very large", "extreme"], right=True).astype(str)
        yield pd.DataFrame({
            "anomaly_id": pdf["anomaly_id"],
            "explanation": pdf["gl_account_id"] + " moved a " + band + " amount in " + pdf["current_month"],
            "band": band,
        })


@register("explain_with_hook", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """,
b AS (SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, gl_account_id, current_month,
             CASE WHEN abs(variance_percent) <= 30 THEN 'moderate' WHEN abs(variance_percent) <= 100 THEN 'large'
                  WHEN abs(variance_percent) <= 1000 THEN 'very large' ELSE 'extreme' END AS band
      FROM flags)
SELECT anomaly_id, gl_account_id || ' moved a ' || band || ' amount in ' || current_month AS explanation, band FROM b""")
def explain_with_hook(spark, sf):
    """Explanations from a user function over Arrow batches (the slot a
    remote explainer would take); the example function is simple enough
    to have a SQL twin."""
    flags, _ = flags_and_explanations(spark, sf)
    keyed = flags.select(F.concat(F.date_format("month", "yyyyMM"), F.lit("-"), F.col("gl_account_id")).alias("anomaly_id"),
                         "gl_account_id", "current_month", "variance_percent")
    return rp.explain_with(keyed, _band_explainer, "anomaly_id string, explanation string, band string")


# ---------------------------------------------------------------------------
# DuckDB twin of parse_sections: the look-ahead end of a section becomes a
# consumed alternative, and commas between digits are protected by a
# placeholder before the evidence split.
# ---------------------------------------------------------------------------

def _section_sql(c: str, title: str) -> str:
    pat = "(?s)\\*\\*" + title + "\\*\\*:\\s*(.+?)(?:\\n\\*\\*|$)"
    return f"(CASE WHEN regexp_matches({c}, '{pat}') THEN trim(regexp_extract({c}, '{pat}', 1)) END)"


def _parse_sql() -> str:
    from ..functions import text as tx
    from .q_text import _sql_fold
    m = "m"

    def joined(title):
        return _sql_fold(_section_sql(m, title), tx.SPLIT_AMOUNT_RULES)

    ev = joined("Supporting Evidence")
    parts = (f"list_transform(string_split(regexp_replace({ev}, '(\\d),(\\d)', '\\1' || chr(31) || '\\2', 'g'), ','),"
             " lambda s: trim(replace(s, chr(31), ',')))")
    escaped = f"list_transform({parts}, lambda s: regexp_replace(s, '\\\\?\\$', '\\\\$', 'g'))"
    merged = (f"list_transform(string_split(list_reduce(esc, lambda acc, x:"
              f" CASE WHEN {_NUM} AND (ends_with({_LAST}, '\\\\$') OR starts_with(trim(x), '-'))"
              f" THEN acc || regexp_replace(trim(x), '^-\\\\s*', '') ELSE acc || chr(30) || x END), chr(30)),"
              f" lambda s: {_group_sql('s')})")
    return BASE + f""",
marked AS (
  SELECT anomaly_id,
         '**Root Cause**: ' || root_cause || chr(10) || '**Recommendation**: ' || recommendation
         || chr(10) || '**Supporting Evidence**: ' || array_to_string(supporting_evidence, ', ') AS m
  FROM ex
),
parsed AS (
  SELECT anomaly_id,
         {joined("Root Cause")} AS root_cause,
         {joined("Chain of Thought")} AS chain_of_thought,
         {joined("Recommendation")} AS recommendation,
         CASE WHEN {ev} IS NULL OR lower(trim({ev})) = 'none' THEN CAST([] AS VARCHAR[]) ELSE {escaped} END AS esc
  FROM marked
)
SELECT anomaly_id, root_cause, chain_of_thought, recommendation,
       CASE WHEN len(esc) = 0 THEN CAST([] AS VARCHAR[]) ELSE {merged} END AS supporting_evidence
FROM parsed"""


ORACLE["parse_sections"] = _parse_sql()


@register("high_severity_list", BASE + """
SELECT gl_account_id, account_name, current_month, variance_percent, variance_amount,
       substr(recommendation, 1, 100) AS recommendation_short
FROM ex JOIN (SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, account_name, current_month,
                     variance_percent, variance_amount FROM flags) f USING (anomaly_id)
WHERE ex.severity = 'high'""")
def high_severity_list(spark, sf):
    """The console list of high rows, recommendation cut to 100 characters."""
    from ..operators import detect as det
    _, ex = flags_and_explanations(spark, sf)
    return det.high_severity_list(ex, recommendation_col="recommendation").select(
        "gl_account_id", "account_name", "current_month", "variance_percent", "variance_amount",
        "recommendation_short")
