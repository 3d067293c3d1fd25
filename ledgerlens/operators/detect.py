"""Anomaly detection over enriched balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import (DEFAULT_ACCOUNT_THRESHOLD, MATERIAL_AMOUNT, MATERIAL_PCT,
                       THRESHOLD_HIGH, THRESHOLD_MEDIUM)
from .balances import month_label


def severity(pct: Column, high: float = THRESHOLD_HIGH, medium: float = THRESHOLD_MEDIUM) -> Column:
    """Severity uses strict ``>`` cut-offs (the filter uses ``>=``)."""
    a = F.abs(pct)
    return (F.when(a > F.lit(high), F.lit("high"))
            .when(a > F.lit(medium), F.lit("medium"))
            .otherwise(F.lit("low")))


def direction(amount: Column) -> Column:
    """Zero change counts as a decrease."""
    return F.when(amount > 0, F.lit("increase")).otherwise(F.lit("decrease"))


def real_text(x: Column) -> Column:
    """Decimal as the text an untyped REAL column prints: trailing zeros
    dropped but one decimal kept (``50000.00`` -> ``50000.0``)."""
    s = F.regexp_replace(x.cast("string"), r"0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def typical_range(lo: Column, hi: Column) -> Column:
    """``min-max``; NULL when either end is NULL (concat semantics)."""
    return F.concat(real_text(lo), F.lit("-"), real_text(hi))


def filter_month(df: DataFrame, month: str, col: str = "month") -> DataFrame:
    """Keep one month, given as ``YYYY-MM``, on a date month column."""
    return df.filter(F.col(col) == F.to_date(F.lit(f"{month}-01")))


def filter_variance(df: DataFrame, threshold: float = THRESHOLD_MEDIUM) -> DataFrame:
    if not isinstance(threshold, (int, float)) or isinstance(threshold, bool) or threshold < 0:
        raise ValueError(f"Invalid threshold_pct: {threshold}")
    return df.filter(F.col("variance_percent").isNotNull()
                     & (F.abs(F.col("variance_percent")) >= F.lit(float(threshold))))


def flag_material(df: DataFrame, pct: float = MATERIAL_PCT, amount: float = MATERIAL_AMOUNT) -> DataFrame:
    """Material change: more than ``pct`` percent or more than ``amount``."""
    return df.filter((F.abs(F.col("variance_percent")) > F.lit(float(pct)))
                     | (F.abs(F.col("variance_amount")) > F.lit(amount)))


def past_anomaly_count(rows: DataFrame, history: DataFrame | None) -> DataFrame:
    """Add ``past_anomaly_count``: stored investigations of the same account
    with ``detected_month`` strictly before the row's month.

    A non-equi join would pair every probe with every older investigation of
    its account.  Instead history is first counted per (account, month), the
    probes are unioned in with zero weight and a running sum over each
    account's months gives the count; a hot account contributes at most one
    row per month.
    """
    if history is None:
        return rows.withColumn("past_anomaly_count", F.lit(0).cast("long"))
    h = (history.groupBy("gl_account_id", F.col("detected_month").alias("month"))
         .agg(F.count(F.lit(1)).alias("_n"))
         .withColumn("_probe", F.lit(False)))
    probes = (rows.select("gl_account_id", "month").distinct()
              .withColumn("_n", F.lit(0).cast("long"))
              .withColumn("_probe", F.lit(True)))
    u = h.unionByName(probes)
    w = (Window.partitionBy("gl_account_id").orderBy(F.unix_date("month"))
         .rangeBetween(Window.unboundedPreceding, -1))
    counts = (u.withColumn("past_anomaly_count", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"))
              .filter(F.col("_probe"))
              .select("gl_account_id", "month", "past_anomaly_count"))
    return (rows.join(counts, ["gl_account_id", "month"], "left")
            .withColumn("past_anomaly_count", F.coalesce("past_anomaly_count", F.lit(0)).cast("long")))


def join_accounts(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances joined to the account master; accounts without a master row drop."""
    return balances.join(accounts, balances.gl_account_id == accounts.account_id, "inner").drop("account_id")


def unmatched_accounts(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts with balances but no master row (they drop out of detection)."""
    acc = accounts.select(F.col("account_id").alias("gl_account_id"))
    return (balances.join(acc, "gl_account_id", "left_anti")
            .groupBy("gl_account_id")
            .agg(F.count(F.lit(1)).alias("months"),
                 F.sum("transaction_count").alias("transaction_count")))


def detect_anomalies(enriched: DataFrame, accounts: DataFrame,
                     target_month: str | None = None,
                     threshold: float = THRESHOLD_MEDIUM,
                     history: DataFrame | None = None,
                     threshold_source: str = "global",
                     high: float = THRESHOLD_HIGH, medium: float = THRESHOLD_MEDIUM) -> DataFrame:
    """Flag account-months whose absolute variance percent reaches the
    threshold, for one month or (``target_month=None``) for all months at once.

    ``threshold_source="account"`` uses each account's own
    ``variance_threshold_pct`` (default 15) instead of ``threshold``.
    """
    b = enriched
    if target_month is not None:
        b = filter_month(b, target_month)
    if threshold_source == "global":
        b = filter_variance(b, threshold)
    acc = accounts.select(
        F.col("account_id").alias("gl_account_id"), "account_name", "typical_min", "typical_max",
        "variance_threshold_pct")
    j = b.join(acc, "gl_account_id", "inner")
    if threshold_source == "account":
        own = F.coalesce(F.col("variance_threshold_pct"), F.lit(DEFAULT_ACCOUNT_THRESHOLD))
        j = j.filter(F.col("variance_percent").isNotNull() & (F.abs(F.col("variance_percent")) >= own))
    elif threshold_source != "global":
        raise ValueError(f"threshold_source must be 'global' or 'account': {threshold_source}")
    j = past_anomaly_count(j, history)
    return j.select(
        "gl_account_id", "account_name", "month",
        month_label("month").alias("current_month"),
        month_label(F.add_months("month", -1)).alias("previous_month"),
        F.col("net_balance").alias("current_balance"),
        F.col("prev_month_balance").alias("previous_balance"),
        "variance_percent", "variance_amount", "transaction_count",
        "rolling_3mo_avg", "rolling_6mo_std", "z_score", "is_statistical_outlier",
        typical_range(F.col("typical_min"), F.col("typical_max")).alias("typical_range"),
        severity(F.col("variance_percent"), high, medium).alias("severity"),
        direction(F.col("variance_amount")).alias("direction"),
        "past_anomaly_count",
    )


def rank_anomalies(flags: DataFrame) -> DataFrame:
    """Worst first within each month; ties broken by account id.

    A global sort (range-partitioned by Spark), not a window: a month may
    hold most of the rows, and a per-month window would put it in one task.
    """
    return flags.orderBy(F.col("month").desc(), F.abs(F.col("variance_percent")).desc(),
                         F.col("gl_account_id"))


def top_medium(flags: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` medium rows per month in rank order, plus how many exist.

    A top-n per group; Spark keeps at most ``n`` rows per group while it
    sorts (window group limit), so a big month does not grow the state.
    """
    med = flags.filter(F.col("severity") == "medium")
    w = Window.partitionBy("month").orderBy(F.abs(F.col("variance_percent")).desc(), F.col("gl_account_id"))
    ranked = med.withColumn("medium_rank", F.row_number().over(w)).filter(F.col("medium_rank") <= n)
    totals = med.groupBy("month").agg(F.count(F.lit(1)).alias("medium_total"))
    return ranked.join(totals, "month", "inner").withColumn(
        "more_not_shown", F.col("medium_total") > F.lit(n))


def severity_counts(flags: DataFrame, accounts: DataFrame, by_month: bool = True) -> DataFrame:
    """Counts of high / medium / low per month; ``accounts_analyzed`` counts
    rows of the account master, not accounts with balances."""
    n_acc = accounts.agg(F.count(F.lit(1))).scalar()   # scalar subquery
    keys = ["current_month"] if by_month else []
    agg = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomalies_detected"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
        F.count_if(F.col("severity") == "medium").alias("medium_severity_count"),
        F.count_if(F.col("severity") == "low").alias("low_severity_count"),
    )
    return agg.withColumn("accounts_analyzed", n_acc)


def approval_route(flags: DataFrame) -> DataFrame:
    """Who signs off (>30 % CFO, >15 % controller) and how fast to act."""
    a = F.abs(F.col("variance_percent"))
    return flags.withColumn(
        "approval", F.when(a > 30, F.lit("cfo_approval")).when(a > 15, F.lit("controller_review"))
        .otherwise(F.lit("none"))
    ).withColumn(
        "action", F.when(F.col("severity") == "high", F.lit("investigate immediately"))
        .when(F.col("severity") == "medium", F.lit("review within 48 hours"))
        .otherwise(F.lit("monitor"))
    )


def high_severity_list(flags: DataFrame, recommendation_col: str | None = None) -> DataFrame:
    high = flags.filter(F.col("severity") == "high")
    if recommendation_col:
        high = high.withColumn("recommendation_short", F.substring(F.col(recommendation_col), 1, 100))
    return high
