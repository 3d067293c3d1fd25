"""Registered queries: balances, variance, windows, detection, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balances as bal
from ..operators import detect as det
from . import adapters as ad
from . import oracle as o
from .catalog import register


def nation_enriched(spark, sf):
    return bal.enrich_balances(bal.monthly_balances(ad.ledger_by_nation(spark, sf), checkpoint=True))


def nation_flags(spark, sf, **kw):
    return det.detect_anomalies(nation_enriched(spark, sf), ad.accounts_from_nations(spark, sf), **kw)


@register("scan_accounts", o.with_(o.SQL_ACCOUNTS_NATION) + "SELECT * FROM accounts")
def scan_accounts(spark, sf):
    return ad.accounts_from_nations(spark, sf)


@register("monthly_balances", o.with_(o.SQL_LEDGER_SUPPLIER, o.BALANCES) + "SELECT * FROM balances")
def monthly_balances(spark, sf):
    return bal.monthly_balances(ad.ledger_by_supplier(spark, sf))


@register("monthly_balances_for", o.with_(o.SQL_LEDGER_NATION, o.BALANCES) +
          "SELECT * FROM balances WHERE month IN (DATE '1998-06-01', DATE '1999-12-01')")
def monthly_balances_for(spark, sf):
    return bal.monthly_balances(ad.ledger_by_nation(spark, sf), months=["1998-06", "1999-12"])


@register("observed_months", o.with_(o.SQL_LEDGER_CUSTOMER, o.BALANCES, o.MONTHS) + "SELECT * FROM months")
def observed_months(spark, sf):
    return bal.observed_months(bal.monthly_balances(ad.ledger_by_customer(spark, sf)))


@register("previous_observed_month", o.with_(o.SQL_LEDGER_CUSTOMER, o.BALANCES, o.MONTHS) + """
SELECT b.gl_account_id, b.month, m.prev_observed_month,
       strftime(b.month - INTERVAL 1 MONTH, '%Y-%m') AS previous_month_label
FROM balances b JOIN months m ON b.month = m.month""")
def previous_observed_month(spark, sf):
    b = bal.monthly_balances(ad.ledger_by_customer(spark, sf), checkpoint=True)
    return b.join(bal.observed_months(b), "month").select(
        "gl_account_id", "month", "prev_observed_month",
        bal.month_label(F.add_months("month", -1)).alias("previous_month_label"))


_MOM_COLS = ("gl_account_id, month, net_balance, transaction_count, prev_month_balance, "
             "variance_amount, variance_percent")


@register("mom_variance", o.DETECT_CUSTOMER + f"SELECT {_MOM_COLS} FROM enriched")
def mom_variance(spark, sf):
    """The sparse-account ledger: the trap case for a per-account lag."""
    return bal.mom_variance(bal.monthly_balances(ad.ledger_by_customer(spark, sf), checkpoint=True))


@register("mom_variance_dense", o.DETECT_NATION + f"SELECT {_MOM_COLS} FROM enriched")
def mom_variance_dense(spark, sf):
    return bal.mom_variance(bal.monthly_balances(ad.ledger_by_nation(spark, sf), checkpoint=True))


@register("rolling_avg", o.DETECT_NATION + "SELECT gl_account_id, month, rolling_3mo_avg FROM enriched")
def rolling_avg(spark, sf):
    return nation_enriched(spark, sf).select("gl_account_id", "month", "rolling_3mo_avg")


@register("rolling_std", o.DETECT_SUPPLIER + "SELECT gl_account_id, month, rolling_6mo_std FROM enriched")
def rolling_std(spark, sf):
    return (bal.enrich_balances(bal.monthly_balances(ad.ledger_by_supplier(spark, sf), checkpoint=True))
            .select("gl_account_id", "month", "rolling_6mo_std"))


@register("zscore_outliers", o.DETECT_NATION + """
SELECT gl_account_id, month, net_balance, z_score, is_statistical_outlier
FROM enriched WHERE is_statistical_outlier""")
def zscore_outliers(spark, sf):
    return (nation_enriched(spark, sf).filter(F.col("is_statistical_outlier"))
            .select("gl_account_id", "month", "net_balance", "z_score", "is_statistical_outlier"))


@register("detect_anomalies", o.DETECT_NATION + o.detect_select(o.GLOBAL_FLAG))
def detect_anomalies(spark, sf):
    return nation_flags(spark, sf)


@register("detect_anomalies_sparse", o.DETECT_CUSTOMER + o.detect_select(o.GLOBAL_FLAG))
def detect_anomalies_sparse(spark, sf):
    led = ad.ledger_by_customer(spark, sf)
    return det.detect_anomalies(bal.enrich_balances(bal.monthly_balances(led, checkpoint=True)),
                                ad.accounts_from_customers(spark, sf))


@register("detect_anomalies_lineitem", o.DETECT_SUPPLIER + o.detect_select(o.GLOBAL_FLAG))
def detect_anomalies_lineitem(spark, sf):
    led = ad.ledger_by_supplier(spark, sf)
    return det.detect_anomalies(bal.enrich_balances(bal.monthly_balances(led, checkpoint=True)),
                                ad.accounts_from_suppliers(spark, sf))


@register("detect_month", o.DETECT_NATION + o.detect_select(
    o.GLOBAL_FLAG + " AND e.month = DATE '2000-06-01'"))
def detect_month(spark, sf):
    return nation_flags(spark, sf, target_month="2000-06")


@register("filter_month", o.DETECT_NATION + "SELECT * FROM balances WHERE month = DATE '1997-03-01'")
def filter_month(spark, sf):
    return det.filter_month(bal.monthly_balances(ad.ledger_by_nation(spark, sf)), "1997-03")


@register("filter_variance", o.DETECT_NATION + f"""
SELECT {_MOM_COLS} FROM enriched
WHERE variance_percent IS NOT NULL AND abs(variance_percent) >= 40.0""")
def filter_variance(spark, sf):
    return det.filter_variance(bal.mom_variance(bal.monthly_balances(ad.ledger_by_nation(spark, sf), checkpoint=True)), 40.0)


@register("flag_material", o.DETECT_CUSTOMER + f"""
SELECT {_MOM_COLS} FROM enriched
WHERE abs(variance_percent) > 15.0 OR abs(variance_amount) > 10000""")
def flag_material(spark, sf):
    return det.flag_material(bal.mom_variance(bal.monthly_balances(ad.ledger_by_customer(spark, sf), checkpoint=True)))


@register("account_threshold_detect", o.DETECT_NATION + o.detect_select(
    "e.variance_percent IS NOT NULL AND abs(e.variance_percent) >= coalesce(a.variance_threshold_pct, 15.0)"))
def account_threshold_detect(spark, sf):
    return nation_flags(spark, sf, threshold_source="account")


@register("join_accounts", o.DETECT_NATION + """
SELECT b.*, a.account_name, a.category, a.subcategory, a.typical_min, a.typical_max,
       a.variance_threshold_pct, a.is_seasonal, a.seasonal_pattern, a.description
FROM balances b JOIN accounts a ON b.gl_account_id = a.account_id""")
def join_accounts(spark, sf):
    return det.join_accounts(bal.monthly_balances(ad.ledger_by_nation(spark, sf)),
                             ad.accounts_from_nations(spark, sf))


@register("unmatched_accounts", o.with_(o.SQL_LEDGER_SUPPLIER, o.BALANCES) + """,
acc AS (SELECT CAST(s_suppkey AS VARCHAR) AS account_id FROM supplier WHERE s_nationkey <> 0)
SELECT gl_account_id, count(*) AS months, sum(transaction_count)::BIGINT AS transaction_count
FROM balances WHERE gl_account_id NOT IN (SELECT account_id FROM acc) GROUP BY gl_account_id""")
def unmatched_accounts(spark, sf):
    """Supplier ledger against a master that lacks the suppliers of nation 0."""
    accounts = ad.accounts_from_suppliers(spark, sf).join(
        ad.table(spark, sf, "supplier").filter(F.col("s_nationkey") != 0)
        .select(F.col("s_suppkey").cast("string").alias("account_id")), "account_id", "left_semi")
    return det.unmatched_accounts(bal.monthly_balances(ad.ledger_by_supplier(spark, sf)), accounts)


@register("target_month", o.with_(o.SQL_LEDGER_NATION) +
          "SELECT strftime(max(transaction_date), '%Y-%m') AS target_month FROM ledger")
def target_month(spark, sf):
    return bal.target_month(ad.ledger_by_nation(spark, sf))


@register("ledger_partition_counts", o.with_(o.SQL_LEDGER_SUPPLIER) + """
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, count(*) AS transaction_count
FROM ledger GROUP BY 1""")
def ledger_partition_counts(spark, sf):
    return bal.ledger_partition_counts(ad.ledger_by_supplier(spark, sf))


@register("category_variance", o.with_(*o.NATION, o.BALANCES, o.MONTHS) + """,
j AS (SELECT b.*, a.category, a.subcategory FROM balances b JOIN accounts a ON b.gl_account_id = a.account_id),
r AS (
  SELECT CAST(grouping(category, subcategory) AS INTEGER) AS level, category, subcategory, month,
         CAST(sum(net_balance) AS DECIMAL(38,2)) AS net_balance,
         CAST(sum(transaction_count) AS BIGINT) AS transaction_count
  FROM j GROUP BY GROUPING SETS ((category, subcategory, month), (category, month), (month))
)
SELECT r.level, r.category, r.subcategory, r.month, r.net_balance, r.transaction_count,
       p.net_balance AS prev_balance,
       CAST(r.net_balance - p.net_balance AS DECIMAL(38,2)) AS variance_amount,
       CAST(r.net_balance - p.net_balance AS DOUBLE) / NULLIF(CAST(abs(p.net_balance) AS DOUBLE), 0) * 100.0
         AS variance_percent
FROM r JOIN months m ON r.month = m.month
LEFT JOIN r p ON p.level = r.level AND p.category IS NOT DISTINCT FROM r.category
             AND p.subcategory IS NOT DISTINCT FROM r.subcategory AND p.month = m.prev_observed_month""")
def category_variance(spark, sf):
    return bal.category_variance(bal.monthly_balances(ad.ledger_by_nation(spark, sf), checkpoint=True),
                                 ad.accounts_from_nations(spark, sf))


@register("seasonal_break", o.with_(*o.NATION, o.BALANCES) + """,
cur AS (SELECT b.* FROM balances b JOIN accounts a ON b.gl_account_id = a.account_id WHERE a.is_seasonal)
SELECT c.gl_account_id, c.month, c.net_balance, p.net_balance AS year_ago_balance,
       CAST(c.net_balance - p.net_balance AS DECIMAL(38,2)) AS yoy_amount,
       CAST(c.net_balance - p.net_balance AS DOUBLE) / NULLIF(CAST(abs(p.net_balance) AS DOUBLE), 0) * 100.0 AS yoy_percent
FROM cur c LEFT JOIN cur p ON p.gl_account_id = c.gl_account_id AND p.month = c.month - INTERVAL 12 MONTH""")
def seasonal_break(spark, sf):
    return bal.seasonal_break(bal.monthly_balances(ad.ledger_by_nation(spark, sf), checkpoint=True),
                              ad.accounts_from_nations(spark, sf))


@register("severity_counts", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """
SELECT current_month, count(*) AS anomalies_detected,
       count_if(severity = 'high') AS high_severity_count,
       count_if(severity = 'medium') AS medium_severity_count,
       count_if(severity = 'low') AS low_severity_count,
       (SELECT count(*) FROM accounts) AS accounts_analyzed
FROM flags GROUP BY current_month""")
def severity_counts(spark, sf):
    return det.severity_counts(nation_flags(spark, sf), ad.accounts_from_nations(spark, sf))


@register("rank_anomalies", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """
SELECT gl_account_id, month, variance_percent,
       row_number() OVER (PARTITION BY month ORDER BY abs(variance_percent) DESC, gl_account_id) AS anomaly_rank
FROM flags""")
def rank_anomalies(spark, sf):
    """Rank within month, worst first.  Numbered from the global range
    sort (``operators.ranking``), so a month holding most flags is not
    sorted in one task."""
    from ..operators.ranking import row_number_in_groups
    flags = nation_flags(spark, sf).select("gl_account_id", "month", "variance_percent")
    return row_number_in_groups(flags, ["month"], [F.abs(F.col("variance_percent")).desc(), F.col("gl_account_id")],
                                name="anomaly_rank")


@register("top_medium", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """,
med AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY abs(variance_percent) DESC, gl_account_id) AS medium_rank,
               count(*) OVER (PARTITION BY month) AS medium_total
        FROM flags WHERE severity = 'medium')
SELECT month, gl_account_id, variance_percent, medium_rank, medium_total, medium_total > 3 AS more_not_shown
FROM med WHERE medium_rank <= 3""")
def top_medium(spark, sf):
    return det.top_medium(nation_flags(spark, sf)).select(
        "month", "gl_account_id", "variance_percent", "medium_rank", "medium_total", "more_not_shown")


@register("approval_route", o.DETECT_NATION.rstrip() + "," + o.FLAGS + """
SELECT gl_account_id, month, severity,
       CASE WHEN abs(variance_percent) > 30 THEN 'cfo_approval'
            WHEN abs(variance_percent) > 15 THEN 'controller_review' ELSE 'none' END AS approval,
       CASE severity WHEN 'high' THEN 'investigate immediately'
                     WHEN 'medium' THEN 'review within 48 hours' ELSE 'monitor' END AS action
FROM flags""")
def approval_route(spark, sf):
    return det.approval_route(nation_flags(spark, sf)).select(
        "gl_account_id", "month", "severity", "approval", "action")





_SQL_LEDGER_HOT = o.SQL_LEDGER_SUPPLIER.replace(
    "CAST(l_suppkey AS VARCHAR) AS gl_account_id",
    "CASE WHEN l_suppkey % 3 = 0 THEN '1' ELSE CAST(l_suppkey AS VARCHAR) END AS gl_account_id")


@register("detect_anomalies_hot_account",
          o.with_(_SQL_LEDGER_HOT, o.SQL_ACCOUNTS_SUPPLIER, o.BALANCES, o.MONTHS, o.ENRICHED)
          + o.detect_select(o.GLOBAL_FLAG))
def detect_anomalies_hot_account(spark, sf):
    """The line-item ledger with every third supplier's lines booked to
    account 1, so one account holds a third of all rows: the roll-up
    pre-aggregates it map-side and the per-account window then sees one row
    per month for it."""
    led = ad.ledger_by_supplier(spark, sf).withColumn(
        "gl_account_id",
        F.when(F.col("gl_account_id").cast("long") % 3 == 0, F.lit("1")).otherwise(F.col("gl_account_id")))
    return det.detect_anomalies(bal.enrich_balances(bal.monthly_balances(led, checkpoint=True)),
                                ad.accounts_from_suppliers(spark, sf))
