"""Synthetic ledgers for scale tests, generated on the executors.

Rows come from ``sequence`` + ``explode`` per account (no join), noise from
``md5(seed|account|month)`` so any executor regenerates the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MONEY

# ---------------------------------------------------------------------------
# Seasonal factors of the sample ledger, as
# (account id, months it applies to, factor).
# ---------------------------------------------------------------------------
SEASONAL_FACTORS = [
    ("7100", [6, 7, 8, 12, 1, 2], 1.3),
    ("8000", [10, 11, 12], 1.5),
    ("3000", [12], 1.3),
    ("4000", [12], 1.4),
    ("4000", [1], 0.8),
]


def unit_noise(seed: int, *parts: Column) -> Column:
    """Deterministic value in [-1, 1) from the md5 of ``seed|part|...``
    (first 48 bits), so any executor, and any SQL engine with md5,
    derives the same value."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return (F.pmod(h, F.lit(2_000_000)).cast("double") / F.lit(1_000_000.0)) - F.lit(1.0)


def seasonal_factor(account: Column, month: Column) -> Column:
    m = F.month(month)
    f = F.lit(1.0)
    for acc, months, factor in SEASONAL_FACTORS:
        f = F.when((account == acc) & m.isin(months), f * F.lit(factor)).otherwise(f)
    return f


def generate_accounts(customers: DataFrame) -> DataFrame:
    """An account master with typical ranges around each customer's balance."""
    base = F.abs(F.col("c_acctbal")) + F.lit(100.0)
    return customers.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("revenue")).otherwise(F.lit("expense"))
        .alias("category"),
        F.col("c_mktsegment").alias("subcategory"),
        F.round(base * 0.8, 2).cast(MONEY).alias("typical_min"),
        F.round(base * 1.2, 2).cast(MONEY).alias("typical_max"),
        F.lit(15.0).alias("variance_threshold_pct"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_seasonal"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("December peak")).alias("seasonal_pattern"),
        F.concat(F.lit("Account of "), F.col("c_name")).alias("description"),
    )


def generate_ledger(accounts: DataFrame, start: Column, end: Column, seed: int = 42,
                    anomaly_rate: float = 0.05, day: int = 15) -> DataFrame:
    """One transaction per account and month from ``start`` to ``end``
    (first days of months): midpoint of the typical range (10,000 when
    unset) plus noise of up to 10 % of the range half-width, seasonal
    factors, and in the last month a share ``anomaly_rate`` of accounts
    moved by a factor of 0.3 to 3 and marked ``ANOMALY``."""
    lo = F.col("typical_min").cast("double")
    hi = F.col("typical_max").cast("double")
    base = F.coalesce((lo + hi) / 2, F.lit(10000.0))
    spread = F.coalesce((hi - lo) / 2, base * 0.1)
    acc, month = F.col("account_id"), F.col("month")
    # what depends on the account alone is made once per account, and the
    # accounts are spread over the tasks before each becomes many rows; the
    # number is given, since a small master would else be put together again
    parts = int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_account = accounts.select(
        "account_id", base.alias("_base"), spread.alias("_spread"),
        (unit_noise(seed + 1, acc) < F.lit(anomaly_rate * 2 - 1)).alias("_pick"),
        (F.lit(0.3) + (unit_noise(seed + 2, acc) + 1) * F.lit(1.35)).alias("_shock")).repartition(parts, "account_id")
    rows = per_account.withColumn("month", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))))
    noise = unit_noise(seed, acc, month)
    anomalous = (month == end) & F.col("_pick")
    amount = (F.col("_base") + noise * F.col("_spread") * 0.1) * seasonal_factor(acc, month)
    amount = F.when(anomalous, amount * F.col("_shock")).otherwise(amount)
    label = F.date_format(month, "MMMM yyyy")
    return rows.select(
        F.concat(F.lit("TXN-"), acc, F.lit("-"), F.date_format(month, "yyyyMM")).alias("transaction_id"),
        acc.alias("gl_account_id"),
        F.date_add(month, day - 1).alias("transaction_date"),
        F.round(amount, 2).cast(MONEY).alias("amount"),
        F.when(anomalous, F.concat(F.lit("ANOMALY: monthly "), acc, F.lit(" - "), label))
         .otherwise(F.concat(F.lit("Monthly "), acc, F.lit(" - "), label)).alias("description"),
        F.lit("Operations").alias("department"),
        F.concat(F.lit("Vendor_"), acc).alias("vendor"),
        F.concat(F.lit("pl_"), F.date_format(month, "yyyy-MM"), F.lit(".csv")).alias("source_file"),
    )


def generate_month(balances: DataFrame, seed: int = 7, anomaly_rate: float = 0.3, day: int = 15) -> DataFrame:
    """The month after each account's last balance: the last balance with
    up to 5 % noise; a share ``anomaly_rate`` of accounts moved by 0.3x to
    3x and marked ``ANOMALY``."""
    last = balances.groupBy("gl_account_id").agg(
        F.max_by("net_balance", "month").alias("_last"), F.max("month").alias("_m"))
    month = F.add_months(F.col("_m"), 1)
    acc = F.col("gl_account_id")
    pick = unit_noise(seed, acc) < F.lit(anomaly_rate * 2 - 1)
    shock = F.lit(0.3) + (unit_noise(seed + 1, acc) + 1) * F.lit(1.35)
    amount = F.col("_last").cast("double") * (F.lit(1.0) + unit_noise(seed + 2, acc) * 0.05)
    amount = F.when(pick, amount * shock).otherwise(amount)
    return last.select(
        F.concat(F.lit("TXN-"), acc, F.lit("-"), F.date_format(month, "yyyyMM")).alias("transaction_id"),
        acc.alias("gl_account_id"),
        F.date_add(month, day - 1).alias("transaction_date"),
        F.round(amount, 2).cast(MONEY).alias("amount"),
        F.when(pick, F.lit("ANOMALY: next month")).otherwise(F.lit("Next month")).alias("description"),
        F.lit("Operations").alias("department"),
        F.concat(F.lit("Vendor_"), acc).alias("vendor"),
        F.concat(F.lit("pl_"), F.date_format(month, "yyyy-MM"), F.lit(".csv")).alias("source_file"),
    )
