"""Synthetic ledger: one row per account and month, seasonal factors,
anomalies only in the last month, deterministic."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import accounts_rows
from ledgerlens.sources import generate as gen


def test_generate_ledger_shape_and_rules(spark):
    acc = accounts_rows(spark, ["8000", "4000", "1234"])
    start, end = F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 12, 1))
    a = gen.generate_ledger(acc, start, end, seed=5, anomaly_rate=1.0)
    b = gen.generate_ledger(acc, start, end, seed=5, anomaly_rate=1.0)
    rows = a.collect()
    assert len(rows) == 36 and len({r["transaction_id"] for r in rows}) == 36
    assert sorted(r["transaction_id"] for r in rows) == sorted(r["transaction_id"] for r in b.collect())
    assert {str(r["amount"]) for r in rows} == {str(r["amount"]) for r in b.collect()}
    marked = {(r["gl_account_id"], r["transaction_date"].month) for r in rows if r["description"].startswith("ANOMALY")}
    assert marked == {("8000", 12), ("4000", 12), ("1234", 12)}     # rate 1.0: every account, last month only
    nov = {r["gl_account_id"]: float(r["amount"]) for r in rows if r["transaction_date"].month == 11}
    # 8000 has a Q4 factor of 1.5 over a base of 10,000 (+-10 % of the spread)
    assert 1.5 * 10000 * 0.98 <= nov["8000"] <= 1.5 * 10000 * 1.02
    assert 10000 * 0.98 <= nov["1234"] <= 10000 * 1.02
