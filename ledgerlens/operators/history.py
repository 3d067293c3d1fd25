"""Investigation history, reviewer feedback and threshold adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HISTORY_LIMIT, RETRIEVAL_HISTORY_LIMIT


def anomaly_key(account: Column, month: Column) -> Column:
    """Deterministic investigation id: ``YYYYMM-account``."""
    return F.concat(F.date_format(month, "yyyyMM"), F.lit("-"), account)


def investigations_from_flags(flags: DataFrame, run_id: Column | None = None,
                              explanations: DataFrame | None = None) -> DataFrame:
    """Flagged rows as investigation records (explanation columns joined
    when given, else NULL)."""
    inv = flags.select(
        anomaly_key(F.col("gl_account_id"), F.col("month")).alias("anomaly_id"),
        "gl_account_id", F.col("month").alias("detected_month"),
        "variance_percent", "variance_amount", "severity",
        (run_id if run_id is not None else F.concat(F.lit("run-"), F.date_format("month", "yyyy-MM"))).alias("run_id"),
    )
    if explanations is not None:
        inv = inv.join(explanations.select("anomaly_id", "root_cause", "llm_explanation", "llm_confidence"),
                       "anomaly_id", "left")
    else:
        inv = (inv.withColumn("root_cause", F.lit(None).cast("string"))
               .withColumn("llm_explanation", F.lit(None).cast("string"))
               .withColumn("llm_confidence", F.lit(None).cast("double")))
    return (inv.withColumn("is_true_anomaly", F.lit(None).cast("boolean"))
            .withColumn("investigation_notes", F.lit(None).cast("string"))
            .withColumn("resolved_by", F.lit(None).cast("string"))
            .withColumn("resolved_at", F.lit(None).cast("timestamp_ntz")))


def recent_history(history: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """Last ``n`` investigations per account, newest first, for all accounts
    at once (``history_rank`` 1 = newest).  Spark keeps only ``n`` rows per
    account while sorting (window group limit)."""
    w = Window.partitionBy("gl_account_id").orderBy(F.col("detected_month").desc(), F.col("anomaly_id").desc())
    return history.withColumn("history_rank", F.row_number().over(w)).filter(F.col("history_rank") <= n)


def history_count(history: DataFrame, cap: int = RETRIEVAL_HISTORY_LIMIT) -> DataFrame:
    """Past investigations per account as retrieval sees them: capped at ``cap``."""
    return (history.groupBy("gl_account_id")
            .agg(F.count(F.lit(1)).alias("_n"))
            .select("gl_account_id", F.least(F.col("_n"), F.lit(cap)).alias("history_count")))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One feedback per anomaly: the latest (ties by notes text).  An
    aggregate (``max_by``), so an anomaly reviewed very many times is
    merged map-side instead of sorted in one task."""
    rest = [c for c in feedback.columns if c != "anomaly_id"]
    latest = F.max_by(F.struct(*[F.col(c) for c in rest]),
                      F.struct(F.col("feedback_ts"), F.col("resolution_notes")))
    return (feedback.groupBy("anomaly_id").agg(latest.alias("_f"))
            .select("anomaly_id", *[F.col(f"_f.{c}").alias(c) for c in rest]))


def apply_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set verdict, notes (the correct explanation, or the resolution notes
    when it is empty), resolver and resolution time by anomaly id."""
    fb = latest_feedback(feedback).select(
        "anomaly_id",
        F.col("is_true_anomaly").alias("_verdict"),
        F.coalesce(F.nullif(F.col("correct_explanation"), F.lit("")), F.col("resolution_notes")).alias("_notes"),
        F.col("resolved_by").alias("_by"),
        F.col("feedback_ts").alias("_at"),
        F.lit(True).alias("_has"))
    j = history.join(fb, "anomaly_id", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    return (j.withColumn("is_true_anomaly", F.when(has, F.col("_verdict")).otherwise(F.col("is_true_anomaly")))
            .withColumn("investigation_notes", F.when(has, F.col("_notes")).otherwise(F.col("investigation_notes")))
            .withColumn("resolved_by", F.when(has, F.col("_by")).otherwise(F.col("resolved_by")))
            .withColumn("resolved_at", F.when(has, F.col("_at")).otherwise(F.col("resolved_at")))
            .drop("_verdict", "_notes", "_by", "_at", "_has"))


def moved_thresholds(history: DataFrame, feedback: DataFrame, factor: float = 1.1) -> DataFrame:
    """(account_id, threshold, moved_at, anomaly_id): each false positive with
    ``adjust_threshold`` moves its account's threshold to
    ``abs(variance_percent) * factor``, which may exceed 100 (no clamp)."""
    return (latest_feedback(feedback).filter(F.col("adjust_threshold") & ~F.col("is_true_anomaly"))
            .join(history.select("anomaly_id", "gl_account_id", "variance_percent"), "anomaly_id", "inner")
            .select(F.col("gl_account_id").alias("account_id"), (F.abs(F.col("variance_percent")) * F.lit(factor)).alias("threshold"),
                    F.col("feedback_ts").alias("moved_at"), "anomaly_id"))


def adjust_thresholds(accounts: DataFrame, history: DataFrame, feedback: DataFrame,
                      factor: float = 1.1) -> DataFrame:
    """Accounts with the thresholds that feedback moves; the latest such
    feedback per account wins."""
    new = moved_thresholds(history, feedback, factor).groupBy("account_id").agg(
        F.max_by("threshold", F.struct("moved_at", "anomaly_id")).alias("_new_thr"))
    return (accounts.join(new, "account_id", "left")
            .withColumn("variance_threshold_pct", F.coalesce("_new_thr", "variance_threshold_pct"))
            .drop("_new_thr"))
