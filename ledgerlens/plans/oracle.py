"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the raw driver tables; the ledger adapters are
repeated as CTEs (see ``adapters``).  Written independently of the Spark
plans where that is natural (self-joins and correlated subqueries here,
windows there), so the check is not the same plan twice.
"""

from __future__ import annotations

from .adapters import (SQL_DIRTY_ACCOUNTS, SQL_DIRTY_LEDGER, SQL_QUOTED_LEDGER, SQL_ACCOUNTS_CUSTOMER, SQL_ACCOUNTS_NATION, SQL_ACCOUNTS_SUPPLIER,
                       SQL_CALL_LOG, SQL_LEDGER_CUSTOMER, SQL_LEDGER_NATION,
                       SQL_LEDGER_SUPPLIER)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def real_text(x: str) -> str:
    s = f"regexp_replace(CAST({x} AS VARCHAR), '0+$', '')"
    return f"(CASE WHEN ends_with({s}, '.') THEN {s} || '0' ELSE {s} END)"


BALANCES = """
balances AS (
  SELECT gl_account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
         CAST(SUM(amount) AS DECIMAL(38,2)) AS net_balance, COUNT(*) AS transaction_count
  FROM ledger GROUP BY ALL
)"""

MONTHS = """
months AS (
  SELECT month, lag(month) OVER (ORDER BY month) AS prev_observed_month
  FROM (SELECT DISTINCT month FROM balances)
)"""

# Previous balance by a self-join on the previous observed month (the Spark
# plan uses a per-account window instead).
ENRICHED = """
stats AS (
  SELECT gl_account_id, month,
         count(net_balance) OVER w3 AS n3,
         avg(CAST(net_balance AS DOUBLE)) OVER w3 AS avg3,
         count(net_balance) OVER w6 AS n6,
         avg(CAST(net_balance AS DOUBLE)) OVER w6 AS mean6,
         stddev_samp(CAST(net_balance AS DOUBLE)) OVER w6 AS std6
  FROM balances
  WINDOW w3 AS (PARTITION BY gl_account_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         w6 AS (PARTITION BY gl_account_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
),
enriched AS (
  SELECT b.gl_account_id, b.month, b.net_balance, b.transaction_count, m.prev_observed_month,
         p.net_balance AS prev_month_balance,
         CAST(b.net_balance - p.net_balance AS DECIMAL(38,2)) AS variance_amount,
         CAST(b.net_balance - p.net_balance AS DOUBLE)
           / NULLIF(CAST(abs(p.net_balance) AS DOUBLE), 0) * 100.0 AS variance_percent,
         round(CASE WHEN s.n3 = 3 THEN s.avg3 END, 4) + 0.0 AS rolling_3mo_avg,
         round(CASE WHEN s.n6 = 6 THEN s.std6 END, 4) + 0.0 AS rolling_6mo_std,
         round(CASE WHEN s.n6 = 6 AND s.std6 > 0
                    THEN (CAST(b.net_balance AS DOUBLE) - s.mean6) / s.std6 END, 4) + 0.0 AS z_score,
         CASE WHEN s.n6 <> 6 THEN NULL
              WHEN s.std6 = 0 THEN CAST(b.net_balance AS DOUBLE) <> s.mean6
              ELSE abs((CAST(b.net_balance AS DOUBLE) - s.mean6) / s.std6) > 2.0 END AS is_statistical_outlier
  FROM balances b
  JOIN months m ON m.month = b.month
  JOIN stats s ON s.gl_account_id = b.gl_account_id AND s.month = b.month
  LEFT JOIN balances p ON p.gl_account_id = b.gl_account_id AND p.month = m.prev_observed_month
)"""


def severity_sql(p: str = "variance_percent") -> str:
    return (f"CASE WHEN abs({p}) > 30.0 THEN 'high' WHEN abs({p}) > 15.0 THEN 'medium' "
            f"ELSE 'low' END")


def detect_select(where: str, past: str = "CAST(0 AS BIGINT)") -> str:
    return f"""
SELECT e.gl_account_id, a.account_name, e.month,
       strftime(e.month, '%Y-%m') AS current_month,
       strftime(e.month - INTERVAL 1 MONTH, '%Y-%m') AS previous_month,
       e.net_balance AS current_balance, e.prev_month_balance AS previous_balance,
       e.variance_percent, e.variance_amount, e.transaction_count,
       e.rolling_3mo_avg, e.rolling_6mo_std, e.z_score, e.is_statistical_outlier,
       {real_text('a.typical_min')} || '-' || {real_text('a.typical_max')} AS typical_range,
       {severity_sql('e.variance_percent')} AS severity,
       CASE WHEN e.variance_amount > 0 THEN 'increase' ELSE 'decrease' END AS direction,
       {past} AS past_anomaly_count
FROM enriched e JOIN accounts a ON e.gl_account_id = a.account_id
WHERE {where}"""


GLOBAL_FLAG = "e.variance_percent IS NOT NULL AND abs(e.variance_percent) >= 15.0"

NATION = (SQL_LEDGER_NATION, SQL_ACCOUNTS_NATION)
CUSTOMER = (SQL_LEDGER_CUSTOMER, SQL_ACCOUNTS_CUSTOMER)
SUPPLIER = (SQL_LEDGER_SUPPLIER, SQL_ACCOUNTS_SUPPLIER)
DETECT_NATION = with_(*NATION, BALANCES, MONTHS, ENRICHED)
DETECT_CUSTOMER = with_(*CUSTOMER, BALANCES, MONTHS, ENRICHED)
DETECT_SUPPLIER = with_(*SUPPLIER, BALANCES, MONTHS, ENRICHED)

# Flags of the dense ledger, as a CTE for downstream operators.
FLAGS = f"""
flags AS ({detect_select(GLOBAL_FLAG)}
)"""

CALL_LOG = SQL_CALL_LOG
