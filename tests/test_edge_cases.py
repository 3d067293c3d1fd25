"""Hand-made edge rows (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from conftest import accounts_rows, ledger_rows
from ledgerlens.operators import balances as bal
from ledgerlens.operators import detect as det
from ledgerlens.operators import validate as va


def _flags(spark, rows, accounts=("A", "B", "C", "D", "E"), **kw):
    e = bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows)))
    return det.detect_anomalies(e, accounts_rows(spark, accounts), **kw), e


def test_previous_observed_month_not_own_previous_row(spark):
    # A skips February; March compares with February (observed) -> A has no previous.
    rows = [("1", "A", "2025-01-10", 100), ("2", "B", "2025-01-10", 100),
            ("3", "B", "2025-02-10", 100), ("4", "A", "2025-03-10", 500), ("5", "B", "2025-03-10", 300)]
    flags, e = _flags(spark, rows)
    march = {r["gl_account_id"]: r for r in e.filter(F.col("month") == F.lit("2025-03-01").cast("date")).collect()}
    assert march["A"]["prev_month_balance"] is None and march["A"]["variance_percent"] is None
    assert march["B"]["variance_percent"] == 200.0
    assert [r["gl_account_id"] for r in flags.collect()] == ["B"]


def test_missing_month_label_vs_balance(spark):
    rows = [("1", "A", "2025-01-10", 100), ("2", "A", "2025-03-10", 200)]
    flags, _ = _flags(spark, rows)
    r = flags.collect()[0]
    assert r["previous_month"] == "2025-02"          # calendar label
    assert str(r["previous_balance"]) == "100.00"     # last observed month's balance


def test_zero_and_negative_prior(spark):
    rows = [("1", "A", "2025-01-10", 0.01), ("1b", "A", "2025-01-11", -0.01), ("2", "B", "2025-01-10", -100),
            ("3", "A", "2025-02-10", 50), ("4", "B", "2025-02-10", 50)]
    _, e = _flags(spark, rows)
    feb = {r["gl_account_id"]: r for r in e.filter(F.col("month") == F.lit("2025-02-01").cast("date")).collect()}
    assert feb["A"]["variance_percent"] is None
    assert feb["B"]["variance_percent"] == 150.0


def test_exact_cutoffs(spark):
    rows = [("1", "A", "2025-01-10", 100), ("2", "B", "2025-01-10", 100), ("3", "C", "2025-01-10", 100),
            ("4", "A", "2025-02-10", 115), ("5", "B", "2025-02-10", 130), ("6", "C", "2025-02-10", 114.99)]
    flags, _ = _flags(spark, rows)
    sev = {r["gl_account_id"]: r["severity"] for r in flags.collect()}
    assert sev == {"A": "low", "B": "medium"}


def test_account_without_master_row_drops(spark):
    rows = [("1", "A", "2025-01-10", 100), ("2", "Z", "2025-01-10", 100),
            ("3", "A", "2025-02-10", 300), ("4", "Z", "2025-02-10", 300)]
    flags, _ = _flags(spark, rows, accounts=("A",))
    assert [r["gl_account_id"] for r in flags.collect()] == ["A"]
    b = bal.monthly_balances(ledger_rows(spark, rows))
    um = det.unmatched_accounts(b, accounts_rows(spark, ["A"])).collect()
    assert [(r["gl_account_id"], r["months"]) for r in um] == [("Z", 2)]


def test_zero_variance_zero_threshold(spark):
    rows = [("1", "A", "2025-01-10", 100), ("2", "A", "2025-02-10", 100)]
    flags, _ = _flags(spark, rows, threshold=0)
    r = flags.collect()[0]
    assert (r["direction"], r["severity"]) == ("decrease", "low")


def test_bad_threshold_rejected(spark):
    rows = [("1", "A", "2025-01-10", 100)]
    e = bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows)))
    with pytest.raises(ValueError):
        det.detect_anomalies(e, accounts_rows(spark, ["A"]), threshold=-1)


def test_typical_range_text(spark):
    from decimal import Decimal

    from ledgerlens.schemas import ACCOUNTS
    acc = spark.createDataFrame([("A", "a", "expense", None, None, Decimal("10000000"), 15.0, False, None, None),
                                 ("B", "b", "expense", None, Decimal("50000"), Decimal("80000.5"), 15.0, False, None, None)],
                                ACCOUNTS)
    rows = [("1", "A", "2025-01-10", 100), ("2", "B", "2025-01-10", 100),
            ("3", "A", "2025-02-10", 300), ("4", "B", "2025-02-10", 300)]
    e = bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows)))
    rng = {r["gl_account_id"]: r["typical_range"] for r in det.detect_anomalies(e, acc).collect()}
    assert rng == {"A": None, "B": "50000.0-80000.5"}


def _raw(spark, rows):
    from ledgerlens.schemas import LEDGER_RAW
    return spark.createDataFrame(rows, LEDGER_RAW)


def test_quarantine_and_fail(spark):
    rows = [("1", "A", "2025-01-10", "10.5", "ok", "", None),
            ("2", None, "2025-01-10", "1", "null account", None, None),
            ("3", "A", "2025-01-10", None, "null amount", None, None),
            ("4", "A", "2025-01-10", "abc", "text amount", None, None),
            ("5", "A", "2025-1-5", "3", "bad date", None, None),
            ("6", "A", "2025-01-10", "0", "zero", None, None)]
    good, bad = va.project_ledger(_raw(spark, rows), mode="quarantine")
    g = good.collect()
    assert [r["transaction_id"] for r in g] == ["1"] and g[0]["department"] is None
    assert str(g[0]["amount"]) == "10.50"
    broken = {r["transaction_id"]: r["broken_rules"] for r in bad.collect()}
    assert broken == {"2": ["null_account"], "3": ["null_amount"], "4": ["non_numeric_amount"],
                      "5": ["bad_date"], "6": ["zero_amount"]}
    rep = va.quality_report(_raw(spark, rows)).collect()[0]
    assert (rep["rows"], rep["null_account"], rep["zero_amount"], rep["bad_date"]) == (6, 1, 1, 1)
    with pytest.raises(Exception, match="Data quality check failed"):
        va.project_ledger(_raw(spark, rows), mode="fail").collect()


def test_missing_column(spark):
    df = spark.createDataFrame([("1", "A")], ["transaction_id", "gl_account_id"])
    with pytest.raises(ValueError, match="Missing required columns"):
        va.project_ledger(df)


def test_accounts_defaults(spark):
    raw = spark.createDataFrame([("A", "a", "Expense", None, None, None, None, None, None, None),
                                 ("B", "b", "revenue", None, "0", "10", "20", "True", None, "")],
                                "account_id string, account_name string, category string, subcategory string, "
                                "typical_min string, typical_max string, variance_threshold_pct string, "
                                "is_seasonal string, seasonal_pattern string, description string")
    rows = {r["account_id"]: r for r in va.project_accounts(raw).collect()}
    assert rows["A"]["variance_threshold_pct"] == 15.0 and rows["A"]["is_seasonal"] is False
    assert rows["A"]["category"] == "expense" and rows["B"]["description"] is None
    assert rows["B"]["is_seasonal"] is True and str(rows["B"]["typical_min"]) == "0.00"


def test_validate_month_and_keys(spark):
    df = spark.createDataFrame([("2025-11",), ("2025-13",), ("2025-1",), ("abcd-01",)], ["m"])
    assert [r["v"] for r in df.select(va.validate_month(F.col("m")).alias("v")).collect()] == [True, False, False, False]
    pairs = spark.createDataFrame([("OPENAI_API_KEY", "sk-" + "a" * 48), ("OPENAI_API_KEY", "sk-short"),
                                   ("OTHER", ""), ("OTHER", "x")], ["name", "value"])
    out = [(r["valid"], r["error"]) for r in va.validate_keys(pairs).collect()]
    assert out == [(True, None), (False, "Invalid format"), (False, "Missing"), (True, None)]


def test_past_anomaly_count_strictly_earlier(spark):
    import datetime as dt
    rows = [("1", "A", "2025-01-10", 100), ("2", "A", "2025-02-10", 300), ("3", "A", "2025-03-10", 900)]
    e = bal.enrich_balances(bal.monthly_balances(ledger_rows(spark, rows)))
    hist = spark.createDataFrame([("A", dt.date(2025, 1, 1)), ("A", dt.date(2025, 2, 1)), ("A", dt.date(2025, 2, 1))],
                                 "gl_account_id string, detected_month date")
    f = det.detect_anomalies(e, accounts_rows(spark, ["A"]), history=hist)
    got = {r["current_month"]: r["past_anomaly_count"] for r in f.collect()}
    assert got == {"2025-02": 1, "2025-03": 3}
