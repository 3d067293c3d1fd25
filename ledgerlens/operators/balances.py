"""Account x month balances, month-over-month variance and rolling statistics.

Plan shape at scale: the ledger is rolled up once (partial + final
aggregation on account x month, so a hot account is pre-aggregated on the
map side), and everything after works on the balance table, whose size is
accounts x months no matter how many transactions there are.  All per-account
windows share one partitioning, so Spark plans a single exchange for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MONEY_SUM, OUTLIER_Z, ROLLING_AVG_MONTHS, ROLLING_STD_MONTHS


def month_start(col: str | Column) -> Column:
    """First day of the month of a date (the balance bucket)."""
    return F.trunc(F.col(col) if isinstance(col, str) else col, "MM")


def month_label(col: str | Column) -> Column:
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM")


def monthly_balances(ledger: DataFrame, months: list[str] | None = None, checkpoint: bool = False) -> DataFrame:
    """SUM(amount), COUNT(*) per account and month.

    ``checkpoint=True`` materialises the result (see below).
    ``months`` restricts the roll-up to some months (given as ``YYYY-MM``);
    the filter is on the transaction date, so it reaches the scan, and on
    the ``month`` partition column when the ledger is a stored table.
    """
    df = ledger
    if months:
        if "month" in ledger.columns:
            # a stored ledger partitioned by month: prune partitions
            df = df.filter(F.col("month").isin([F.to_date(F.lit(f"{m}-01")) for m in months]))
        bounds = None
        for m in months:
            start = F.to_date(F.lit(f"{m}-01"))
            cond = (F.col("transaction_date") >= start) & (F.col("transaction_date") < F.add_months(start, 1))
            bounds = cond if bounds is None else (bounds | cond)
        df = df.filter(bounds)
    out = (
        df.groupBy("gl_account_id", month_start("transaction_date").alias("month"))
        .agg(F.sum("amount").cast(MONEY_SUM).alias("net_balance"),
             F.count(F.lit(1)).alias("transaction_count"))
    )
    if checkpoint:
        # Large ledgers: write the roll-up to the shared checkpoint folder
        # once; the month list and the windows then read the (small) balance
        # table instead of scanning the ledger a second time.
        from ..session import materialize
        out = materialize(out)
    return out


def observed_months(balances: DataFrame) -> DataFrame:
    """Distinct months and, for each, the month observed just before it.

    The window has no partition key on purpose: it runs on the distinct
    month list, which is bounded by the calendar (12 rows a year), never on
    the data itself.
    """
    months = balances.select("month").distinct()
    return months.withColumn(
        "prev_observed_month", F.lag("month").over(Window.orderBy("month")))


def enrich_balances(balances: DataFrame,
                    avg_months: int = ROLLING_AVG_MONTHS,
                    std_months: int = ROLLING_STD_MONTHS,
                    z_cutoff: float = OUTLIER_Z) -> DataFrame:
    """Month-over-month variance plus rolling statistics in one window pass.

    Previous balance = the account's balance in the previous month observed
    anywhere in the table.  An account's own previous row is used only when
    it *is* that month; otherwise the previous balance is NULL.  This is the
    same result as a self-join on (account, previous observed month) but needs
    one shuffle by account instead of two.

    Rolling frames exclude the current month and are NULL until full.
    """
    months = observed_months(balances)
    b = balances.join(months, "month", "inner")
    w = Window.partitionBy("gl_account_id").orderBy("month")
    lag_month = F.lag("month").over(w)
    lag_bal = F.lag("net_balance").over(w)
    bal = F.col("net_balance").cast("double")
    w_avg = w.rowsBetween(-avg_months, -1)
    w_std = w.rowsBetween(-std_months, -1)
    b = (
        b.withColumn("prev_month_balance",
                     F.when(lag_month == F.col("prev_observed_month"), lag_bal))
        .withColumn("_n_avg", F.count("net_balance").over(w_avg))
        .withColumn("_avg", F.avg(bal).over(w_avg))
        .withColumn("_n_std", F.count("net_balance").over(w_std))
        .withColumn("_mean6", F.avg(bal).over(w_std))
        .withColumn("_std6", F.stddev_samp(bal).over(w_std))
    )
    variance_amount = (F.col("net_balance") - F.col("prev_month_balance")).cast(MONEY_SUM)
    pct = F.try_divide(variance_amount.cast("double"),
                       F.abs(F.col("prev_month_balance")).cast("double")) * F.lit(100.0)
    full_std = F.col("_n_std") == std_months
    z = F.when(full_std & (F.col("_std6") > 0),
               (bal - F.col("_mean6")) / F.col("_std6"))
    outlier = (F.when(~full_std, F.lit(None).cast("boolean"))
               .when(F.col("_std6") == 0, bal != F.col("_mean6"))
               .otherwise(F.abs(z) > F.lit(z_cutoff)))
    return b.select(
        "gl_account_id", "month", "net_balance", "transaction_count",
        "prev_observed_month", "prev_month_balance",
        variance_amount.alias("variance_amount"),
        pct.alias("variance_percent"),
        # "+ 0.0" turns a rounded -0.0 into 0.0, so the sign of a value that
        # is zero up to float error does not depend on summation order
        (F.round(F.when(F.col("_n_avg") == avg_months, F.col("_avg")), 4) + F.lit(0.0)).alias("rolling_3mo_avg"),
        (F.round(F.when(full_std, F.col("_std6")), 4) + F.lit(0.0)).alias("rolling_6mo_std"),
        (F.round(z, 4) + F.lit(0.0)).alias("z_score"),
        outlier.alias("is_statistical_outlier"),
    )


def mom_variance(balances: DataFrame) -> DataFrame:
    return enrich_balances(balances).select(
        "gl_account_id", "month", "net_balance", "transaction_count",
        "prev_month_balance", "variance_amount", "variance_percent")


def category_variance(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances rolled up to (category, subcategory), category and total,
    then month-over-month variance on the rolled-up key.

    ``level`` is 0 for (category, subcategory), 1 for category, 3 for all.
    """
    acc = accounts.select(F.col("account_id").alias("gl_account_id"), "category", "subcategory")
    j = balances.join(acc, "gl_account_id", "inner")
    rolled = (
        j.groupingSets([["category", "subcategory", "month"], ["category", "month"], ["month"]],
                       "category", "subcategory", "month")
        .agg(F.sum("net_balance").cast(MONEY_SUM).alias("net_balance"),
             F.sum("transaction_count").cast("long").alias("transaction_count"),
             (F.grouping("category") * 2 + F.grouping("subcategory")).cast("int").alias("level"))
    )
    months = observed_months(balances)
    r = rolled.join(months, "month", "inner")
    w = Window.partitionBy("level", "category", "subcategory").orderBy("month")
    lag_month = F.lag("month").over(w)
    prev = F.when(lag_month == F.col("prev_observed_month"), F.lag("net_balance").over(w))
    r = r.withColumn("prev_balance", prev)
    amt = (F.col("net_balance") - F.col("prev_balance")).cast(MONEY_SUM)
    return r.select(
        "level", "category", "subcategory", "month", "net_balance", "transaction_count",
        "prev_balance", amt.alias("variance_amount"),
        (F.try_divide(amt.cast("double"), F.abs(F.col("prev_balance")).cast("double")) * F.lit(100.0))
        .alias("variance_percent"),
    )


def seasonal_break(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Seasonal accounts compared with the same month one year earlier."""
    seasonal = accounts.filter(F.col("is_seasonal")).select(F.col("account_id").alias("gl_account_id"))
    cur = balances.join(seasonal, "gl_account_id", "left_semi")
    prior = cur.select("gl_account_id", F.add_months("month", 12).alias("month"),
                       F.col("net_balance").alias("year_ago_balance"))
    j = cur.join(prior, ["gl_account_id", "month"], "left")
    amt = (F.col("net_balance") - F.col("year_ago_balance")).cast(MONEY_SUM)
    return j.select(
        "gl_account_id", "month", "net_balance", "year_ago_balance",
        amt.alias("yoy_amount"),
        (F.try_divide(amt.cast("double"), F.abs(F.col("year_ago_balance")).cast("double")) * F.lit(100.0))
        .alias("yoy_percent"),
    )


def target_month(ledger: DataFrame) -> DataFrame:
    """The newest month in the ledger, as ``YYYY-MM``."""
    return ledger.agg(F.date_format(F.max("transaction_date"), "yyyy-MM").alias("target_month"))


def ledger_partition_counts(ledger: DataFrame) -> DataFrame:
    return (ledger.groupBy(month_start("transaction_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("transaction_count")))
