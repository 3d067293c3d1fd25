"""Registered queries: investigation history, feedback, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as det
from ..operators import history as hi
from . import adapters as ad
from . import oracle as o
from . import store as st
from .catalog import register
from .q_core import nation_enriched, nation_flags

INV_SQL = """
inv AS (
  SELECT strftime(month, '%Y%m') || '-' || gl_account_id AS anomaly_id, gl_account_id,
         month AS detected_month, variance_percent, variance_amount, severity,
         'run-' || strftime(month, '%Y-%m') AS run_id,
         CAST(NULL AS VARCHAR) AS root_cause, CAST(NULL AS VARCHAR) AS llm_explanation,
         CAST(NULL AS DOUBLE) AS llm_confidence, CAST(NULL AS BOOLEAN) AS is_true_anomaly,
         CAST(NULL AS VARCHAR) AS investigation_notes, CAST(NULL AS VARCHAR) AS resolved_by,
         CAST(NULL AS TIMESTAMP) AS resolved_at
  FROM flags
),
fb AS (
  SELECT anomaly_id,
         (CAST(gl_account_id AS INTEGER) + month(detected_month)) % 5 <> 0 AS is_true_anomaly,
         CASE WHEN month(detected_month) % 2 = 0 THEN '' ELSE 'Seasonal swing confirmed' END AS correct_explanation,
         NOT ((CAST(gl_account_id AS INTEGER) + month(detected_month)) % 5 <> 0) AS adjust_threshold,
         'Reviewed ' || anomaly_id AS resolution_notes,
         'controller' AS resolved_by,
         CAST(detected_month AS TIMESTAMP) + INTERVAL 40 DAY AS feedback_ts
  FROM inv
)"""

BASE = o.DETECT_NATION.rstrip() + "," + o.FLAGS + "," + INV_SQL + "\n"


def investigations(spark, sf):
    return hi.investigations_from_flags(nation_flags(spark, sf))


def feedback_for(inv):
    """Reviewer verdicts derived from the investigations: one in five is a
    false positive and asks for a threshold change; even months leave the
    correct explanation empty (so the notes fall back)."""
    m = F.month("detected_month")
    is_true = (F.col("gl_account_id").cast("int") + m) % 5 != 0
    return inv.select(
        "anomaly_id",
        is_true.alias("is_true_anomaly"),
        F.when(m % 2 == 0, F.lit("")).otherwise(F.lit("Seasonal swing confirmed")).alias("correct_explanation"),
        (~is_true).alias("adjust_threshold"),
        F.concat(F.lit("Reviewed "), F.col("anomaly_id")).alias("resolution_notes"),
        F.lit("controller").alias("resolved_by"),
        (F.col("detected_month").cast("timestamp_ntz") + F.expr("INTERVAL 40 DAYS")).alias("feedback_ts"),
    )


@register("store_investigations", BASE + "SELECT * FROM inv")
def store_investigations(spark, sf):
    """Stored in three steps (the early months, everything, everything
    again, as reruns do) and read back: no record twice, none lost."""
    from ..session import scratch_path
    from . import store as st
    inv, path = investigations(spark, sf), scratch_path(spark, "investigations")
    st.store_investigations(spark, inv.where(F.col("detected_month") < F.lit("1998-01-01").cast("date")), path)
    for _ in range(2):
        st.store_investigations(spark, inv, path)
    return spark.read.parquet(path)


@register("recent_history", BASE + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY gl_account_id ORDER BY detected_month DESC, anomaly_id DESC) AS history_rank
  FROM inv) WHERE history_rank <= 5""")
def recent_history(spark, sf):
    return hi.recent_history(investigations(spark, sf))


@register("history_count", BASE + """
SELECT gl_account_id, least(count(*), 3) AS history_count FROM inv GROUP BY gl_account_id""")
def history_count(spark, sf):
    return hi.history_count(investigations(spark, sf))


@register("past_anomaly_count", BASE + o.detect_select(
    o.GLOBAL_FLAG,
    past="(SELECT count(*) FROM inv h WHERE h.gl_account_id = e.gl_account_id AND h.detected_month < e.month)"))
def past_anomaly_count(spark, sf):
    inv = investigations(spark, sf)
    return det.detect_anomalies(nation_enriched(spark, sf), ad.accounts_from_nations(spark, sf), history=inv)


@register("apply_feedback", BASE + """
SELECT i.anomaly_id, i.gl_account_id, i.detected_month, i.variance_percent, i.variance_amount, i.severity,
       i.run_id, i.root_cause, i.llm_explanation, i.llm_confidence,
       f.is_true_anomaly, coalesce(nullif(f.correct_explanation, ''), f.resolution_notes) AS investigation_notes,
       f.resolved_by, f.feedback_ts AS resolved_at
FROM inv i LEFT JOIN fb f ON i.anomaly_id = f.anomaly_id""")
def apply_feedback(spark, sf):
    inv = investigations(spark, sf)
    return hi.apply_feedback(inv, feedback_for(inv))


@register("adjust_thresholds", BASE + """,
fp AS (
  SELECT i.gl_account_id, abs(i.variance_percent) * 1.1 AS thr, f.feedback_ts, f.anomaly_id
  FROM fb f JOIN inv i ON f.anomaly_id = i.anomaly_id
  WHERE f.adjust_threshold AND NOT f.is_true_anomaly
),
latest AS (SELECT gl_account_id, arg_max(thr, (feedback_ts, anomaly_id)) AS thr FROM fp GROUP BY gl_account_id)
SELECT a.account_id, a.account_name, a.category, a.subcategory, a.typical_min, a.typical_max,
       coalesce(l.thr, a.variance_threshold_pct) AS variance_threshold_pct,
       a.is_seasonal, a.seasonal_pattern, a.description
FROM accounts a LEFT JOIN latest l ON a.account_id = l.gl_account_id""")
def adjust_thresholds(spark, sf):
    inv = investigations(spark, sf)
    return hi.adjust_thresholds(ad.accounts_from_nations(spark, sf), inv, feedback_for(inv))


_AFTER_FEEDBACK = BASE + """,
fp AS (
  SELECT i.gl_account_id, abs(i.variance_percent) * 1.1 AS thr, f.feedback_ts, f.anomaly_id
  FROM fb f JOIN inv i ON f.anomaly_id = i.anomaly_id
  WHERE f.adjust_threshold AND NOT f.is_true_anomaly
),
latest AS (SELECT gl_account_id, arg_max(thr, (feedback_ts, anomaly_id)) AS thr FROM fp GROUP BY gl_account_id),
acc2 AS (SELECT a.account_id, a.account_name, a.typical_min, a.typical_max,
                coalesce(l.thr, a.variance_threshold_pct) AS variance_threshold_pct
         FROM accounts a LEFT JOIN latest l ON a.account_id = l.gl_account_id)
SELECT e.gl_account_id, e.month, e.variance_percent,
       coalesce(a.variance_threshold_pct, 15.0) AS threshold_used
FROM enriched e JOIN acc2 a ON e.gl_account_id = a.account_id
WHERE e.variance_percent IS NOT NULL AND abs(e.variance_percent) >= coalesce(a.variance_threshold_pct, 15.0)"""


@register("account_threshold_after_feedback", _AFTER_FEEDBACK)
def account_threshold_after_feedback(spark, sf):
    """Detection with each account's own threshold after feedback moved it."""
    inv = investigations(spark, sf)
    acc = hi.adjust_thresholds(ad.accounts_from_nations(spark, sf), inv, feedback_for(inv))
    flags = det.detect_anomalies(nation_enriched(spark, sf), acc, threshold_source="account")
    return flags.join(acc.select(F.col("account_id").alias("gl_account_id"),
                                 F.coalesce("variance_threshold_pct", F.lit(15.0)).alias("threshold_used")),
                      "gl_account_id").select("gl_account_id", "month", "variance_percent", "threshold_used")


def _stored_feedback(spark, sf):
    """Investigations, master and feedback stored (the feedback twice), then
    the master loaded again."""
    from ..session import scratch_path
    base = scratch_path(spark, "feedback")
    inv, accounts = investigations(spark, sf), ad.accounts_from_nations(spark, sf)
    st.store_investigations(spark, inv, f"{base}/investigations")
    st.store_accounts(accounts, f"{base}/accounts", seq=1)
    fb = feedback_for(inv)
    for _ in range(2):
        st.store_feedback(spark, fb, base)
    st.store_accounts(accounts, f"{base}/accounts", seq=1 << 60)
    return base


@register("store_feedback", BASE + """
SELECT i.anomaly_id, i.gl_account_id, i.detected_month, i.variance_percent, i.variance_amount, i.severity,
       i.run_id, i.root_cause, i.llm_explanation, i.llm_confidence,
       f.is_true_anomaly, coalesce(nullif(f.correct_explanation, ''), f.resolution_notes) AS investigation_notes,
       f.resolved_by, f.feedback_ts AS resolved_at
FROM inv i LEFT JOIN fb f ON i.anomaly_id = f.anomaly_id""")
def store_feedback(spark, sf):
    """Verdicts stored, and read back with the investigations they judge."""
    return st.judged_investigations(spark, _stored_feedback(spark, sf))


@register("detect_after_reload", _AFTER_FEEDBACK)
def detect_after_reload(spark, sf):
    """Detection with the stored thresholds, which outlive the master's reload."""
    acc = st.adjusted_accounts(spark, _stored_feedback(spark, sf))
    flags = det.detect_anomalies(nation_enriched(spark, sf), acc, threshold_source="account")
    return flags.join(acc.select(F.col("account_id").alias("gl_account_id"),
                                 F.coalesce("variance_threshold_pct", F.lit(15.0)).alias("threshold_used")),
                      "gl_account_id").select("gl_account_id", "month", "variance_percent", "threshold_used")


@register("accounts_after_reload", o.with_(o.SQL_ACCOUNTS_NATION) + "SELECT * FROM accounts")
def accounts_after_reload(spark, sf):
    """The master where a reload sets thresholds back."""
    return st.adjusted_accounts(spark, _stored_feedback(spark, sf), survive_reload=False)
