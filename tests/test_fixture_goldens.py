"""Goldens computed from the sample ledger files (see FIXTURES.md)."""

from pyspark.sql import functions as F

from ledgerlens.operators import balances as bal
from ledgerlens.operators import detect as det

MONTH_GOLDENS = {  # month: (flagged, high, medium, low, month total)
    "2024-10": (0, 0, 0, 0, "326536.51"),
    "2024-11": (9, 7, 2, 0, "336767.94"),
    "2024-12": (15, 10, 5, 0, "374948.58"),
    "2025-01": (13, 9, 4, 0, "316727.84"),
    "2025-02": (15, 8, 7, 0, "340583.17"),
    "2025-03": (10, 7, 3, 0, "352424.44"),
    "2025-04": (11, 7, 4, 0, "334166.49"),
    "2025-05": (13, 8, 5, 0, "330874.88"),
    "2025-06": (12, 7, 5, 0, "332288.90"),
    "2025-07": (12, 9, 3, 0, "332793.57"),
    "2025-08": (14, 7, 7, 0, "340482.23"),
    "2025-09": (14, 8, 6, 0, "329738.49"),
    "2025-10": (21, 16, 5, 0, "455647.57"),
    "2025-11": (18, 17, 1, 0, "438200.01"),
}


def _enriched(ledger):
    return bal.enrich_balances(bal.monthly_balances(ledger))


def test_ledger_shape(fixture_ledger):
    assert fixture_ledger.count() == 378
    assert fixture_ledger.select("transaction_id").distinct().count() == 378
    assert fixture_ledger.select("gl_account_id").distinct().count() == 27


def test_monthly_counts_and_totals(fixture_ledger, fixture_accounts):
    flags = det.detect_anomalies(_enriched(fixture_ledger), fixture_accounts)
    got = {r["current_month"]: r for r in det.severity_counts(flags, fixture_accounts).collect()}
    totals = {r["m"]: str(r["t"]) for r in bal.monthly_balances(fixture_ledger)
              .groupBy(F.date_format("month", "yyyy-MM").alias("m")).agg(F.sum("net_balance").alias("t")).collect()}
    for m, (n, h, md, lo, total) in MONTH_GOLDENS.items():
        r = got.get(m)
        assert (r["anomalies_detected"] if r else 0) == n, m
        if r:
            assert (r["high_severity_count"], r["medium_severity_count"], r["low_severity_count"]) == (h, md, lo), m
            assert r["accounts_analyzed"] == 27
        assert totals[m] == total, m


def test_ranked_2025_11(fixture_ledger, fixture_accounts):
    flags = det.rank_anomalies(det.detect_anomalies(_enriched(fixture_ledger), fixture_accounts,
                                                    target_month="2025-11"))
    rows = flags.collect()
    order = [r["gl_account_id"] for r in rows]
    assert order[:5] == ["9700", "5530", "6300", "5100", "5200"]
    top = rows[0]
    assert str(top["current_balance"]) == "15000.00" and str(top["previous_balance"]) == "83.05"
    assert round(top["variance_percent"], 2) == 17961.41
    assert order[-1] == "5500" and rows[-1]["severity"] == "medium"
    assert set(order[-3:-1]) == {"3100", "5000"}
    assert {r["previous_month"] for r in rows} == {"2025-10"}


def test_ranked_2025_10(fixture_ledger, fixture_accounts):
    rows = det.rank_anomalies(det.detect_anomalies(_enriched(fixture_ledger), fixture_accounts,
                                                   target_month="2025-10")).collect()
    assert [r["gl_account_id"] for r in rows][:3] == ["9000", "6200", "7200"]
    assert round(rows[0]["variance_percent"], 2) == 1767.71


def test_zscores_2025_11(fixture_ledger):
    e = _enriched(fixture_ledger).filter(F.col("month") == F.lit("2025-11-01").cast("date"))
    z = {r["gl_account_id"]: r for r in e.collect()}
    assert z["4100"]["z_score"] == 6.5574
    assert z["9700"]["z_score"] == 21.4718
    assert z["8200"]["z_score"] == -1.3949
    assert z["5000"]["z_score"] == -0.4082
    assert z["9600"]["z_score"] is None
    assert z["4100"]["rolling_3mo_avg"] == 26639.86 or round(z["4100"]["rolling_3mo_avg"], 2) == 26639.86
    assert round(z["4100"]["rolling_6mo_std"], 2) == 4805.73
    assert round(z["9700"]["rolling_3mo_avg"], 2) == 467.06
    assert round(z["8200"]["rolling_6mo_std"], 2) == 2526.80
    outliers = sorted(k for k, r in z.items() if r["is_statistical_outlier"])
    assert outliers == ["4100", "5100", "5200", "5520", "5530", "6300", "8000", "9500", "9700"]


def test_zscore_outliers_2025_10(fixture_ledger):
    e = _enriched(fixture_ledger).filter(F.col("month") == F.lit("2025-10-01").cast("date"))
    outliers = sorted(r["gl_account_id"] for r in e.filter(F.col("is_statistical_outlier")).collect())
    assert outliers == ["3100", "4000", "5000", "5300", "5500", "6200", "7200", "8000", "9000", "9100", "9200"]


def test_null_z_rows(fixture_ledger):
    assert _enriched(fixture_ledger).filter(F.col("z_score").isNull()).count() == 177


def test_category_variance(fixture_ledger, fixture_accounts):
    cv = bal.category_variance(bal.monthly_balances(fixture_ledger), fixture_accounts)
    nov = {(r["level"], r["category"]): r for r in
           cv.filter(F.col("month") == F.lit("2025-11-01").cast("date")).collect() if r["level"] in (1, 3)}
    assert str(nov[(1, "expense")]["net_balance"]) == "302000.01"
    assert round(nov[(1, "expense")]["variance_percent"], 2) == -18.21
    assert round(nov[(1, "revenue")]["variance_percent"], 2) == 57.61
    assert str(nov[(3, None)]["net_balance"]) == "438200.01"
    assert round(nov[(3, None)]["variance_percent"], 2) == -3.83


def test_account_threshold_and_material(fixture_ledger, fixture_accounts):
    e = _enriched(fixture_ledger)
    own = det.detect_anomalies(e, fixture_accounts, threshold_source="account")
    counts = {r["current_month"]: r["count"] for r in own.groupBy("current_month").count().collect()}
    assert counts["2025-10"] == 20 and counts["2025-11"] == 18
    mat = det.flag_material(e)
    mcounts = {r["m"]: r["count"] for r in mat.groupBy(F.date_format("month", "yyyy-MM").alias("m")).count().collect()}
    assert mcounts["2025-10"] == 21 and mcounts["2025-11"] == 18
