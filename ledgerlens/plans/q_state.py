"""Registered queries: stored tables and their updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import adapters as ad
from . import oracle as o
from . import store as st
from .catalog import register
from .q_core import nation_flags
from .q_costs import PRICED, priced

CUTOFF = "2000-01-01"


def _ledger(spark, sf):
    return ad.ledger_by_nation(spark, sf)


@register("new_transactions", o.with_(o.SQL_LEDGER_NATION) + f"SELECT * FROM ledger WHERE transaction_date >= DATE '{CUTOFF}'")
def new_transactions(spark, sf):
    """Stored: rows before the cut-off.  Batch: rows from six months
    earlier on, each twice: only the unseen ids are new, once."""
    led = _ledger(spark, sf)
    existing = led.filter(F.col("transaction_date") < F.lit(CUTOFF).cast("date"))
    batch = led.filter(F.col("transaction_date") >= F.lit("1999-07-01").cast("date"))
    batch = batch.unionByName(batch)
    return st.new_transactions(batch, existing, order=["source_file", "transaction_id"])


@register("append_ledger", o.with_(o.SQL_LEDGER_NATION) + "SELECT * FROM ledger")
def append_ledger(spark, sf):
    """Two appends into a stored ledger table; the second overlaps the
    first and only adds the unseen ids."""
    path = scratch_path(spark, "ledger")
    led = _ledger(spark, sf)
    st.append_ledger(spark, led.filter(F.col("transaction_date") < F.lit(CUTOFF).cast("date")), path)
    st.append_ledger(spark, led.filter(F.col("transaction_date") >= F.lit("1999-07-01").cast("date")), path)
    return spark.read.parquet(path).drop("month")


@register("upsert_accounts", o.with_(o.SQL_ACCOUNTS_NATION) + """,
n AS (SELECT CAST(n_nationkey AS VARCHAR) AS account_id FROM nation WHERE n_regionkey = 2)
SELECT a.account_id,
       CASE WHEN n.account_id IS NOT NULL THEN lower(a.account_name) ELSE a.account_name END AS account_name,
       a.category, a.subcategory, a.typical_min, a.typical_max, a.variance_threshold_pct, a.is_seasonal,
       a.seasonal_pattern,
       CASE WHEN n.account_id IS NOT NULL THEN 'revised twice' ELSE a.description END AS description
FROM accounts a LEFT JOIN n ON a.account_id = n.account_id""")
def upsert_accounts(spark, sf):
    """Master rows of one region replaced by a batch holding two versions
    of each; the later version wins."""
    master = ad.accounts_from_nations(spark, sf)
    region2 = master.join(ad.table(spark, sf, "nation").filter(F.col("n_regionkey") == 2)
                          .select(F.col("n_nationkey").cast("string").alias("account_id")), "account_id", "left_semi")
    v1 = region2.withColumn("account_name", F.lower("account_name")).withColumn(
        "description", F.lit("revised once")).withColumn("_seq", F.lit(1))
    v2 = v1.withColumn("description", F.lit("revised twice")).withColumn("_seq", F.lit(2))
    path = scratch_path(spark, "accounts")
    st.store_accounts(master, path, seq=0)
    for seq, version in ((2, v2), (1, v1), (2, v2)):          # out of order, and one twice
        st.store_accounts(version.drop("_seq"), path, seq=seq)
    return st.current_accounts(spark, path)


_REFRESH_LEDGER = o.SQL_LEDGER_NATION.rstrip() + """,
lall AS (SELECT * FROM ledger),
late_month AS (SELECT CAST(date_trunc('month', max(transaction_date)) AS DATE) AS lm FROM ledger),
l1 AS (SELECT * FROM lall WHERE transaction_date < (SELECT lm FROM late_month) AND vendor <> '5-LOW'),
agg AS (
  SELECT gl_account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
         CAST(SUM(amount) AS DECIMAL(38,2)) AS net_balance, COUNT(*) AS transaction_count
  FROM l1 GROUP BY ALL
  UNION ALL
  SELECT gl_account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
         CAST(SUM(amount) AS DECIMAL(38,2)) AS net_balance, COUNT(*) AS transaction_count
  FROM lall WHERE transaction_date >= (SELECT lm FROM late_month) GROUP BY ALL
),
balances AS (SELECT * FROM agg)"""


def _refresh_scenario(spark, sf):
    lall = _ledger(spark, sf)
    last = lall.agg(F.date_format(F.max("transaction_date"), "yyyy-MM")).first()[0]      # one scalar
    l1 = lall.filter((F.col("transaction_date") < F.lit(f"{last}-01").cast("date")) & (F.col("vendor") != "5-LOW"))
    path = scratch_path(spark, "balances")
    st.refresh_balances(spark, l1, path)
    enriched = st.refresh_balances(spark, lall, path, target_month=last)
    return lall, path, enriched


@register("refresh_balances", o.with_(_REFRESH_LEDGER, o.MONTHS, o.ENRICHED) + """
SELECT gl_account_id, month, net_balance, transaction_count, prev_month_balance, variance_amount, variance_percent
FROM enriched""")
def refresh_balances(spark, sf):
    """First run on the ledger without its low-priority rows (all months),
    second run after those rows arrive late plus the next month: only the
    target month is rolled up again; variance is recomputed everywhere."""
    _, _, enriched = _refresh_scenario(spark, sf)
    return enriched.select("gl_account_id", "month", "net_balance", "transaction_count",
                           "prev_month_balance", "variance_amount", "variance_percent")


@register("late_rows", o.with_(_REFRESH_LEDGER) + """,
actual AS (SELECT gl_account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                  CAST(SUM(amount) AS DECIMAL(38,2)) AS ledger_balance, COUNT(*) AS ledger_count
           FROM lall GROUP BY ALL)
SELECT coalesce(a.gl_account_id, b.gl_account_id) AS gl_account_id, coalesce(a.month, b.month) AS month,
       a.ledger_balance, a.ledger_count, b.net_balance AS stored_balance, b.transaction_count AS stored_count
FROM actual a FULL OUTER JOIN balances b ON a.gl_account_id = b.gl_account_id AND a.month = b.month
WHERE a.ledger_balance IS DISTINCT FROM b.net_balance OR a.ledger_count IS DISTINCT FROM b.transaction_count""")
def late_rows(spark, sf):
    lall, path, _ = _refresh_scenario(spark, sf)
    return st.late_rows(lall, spark.read.parquet(path))


@register("balances_from_deltas", o.with_(o.SQL_LEDGER_NATION) + """
SELECT gl_account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, CAST(sum(amount) AS DECIMAL(38,2)) AS net_balance,
       count(*) AS transaction_count
FROM ledger WHERE CAST(transaction_id AS BIGINT) % 7 <> 0 GROUP BY ALL""")
def balances_from_deltas(spark, sf):
    """Balances added up from the changes of four batches, one of them
    stored twice, with every seventh transaction taken back and a fold between."""
    led, path, changes = _ledger(spark, sf), scratch_path(spark, "ledger_batches"), scratch_path(spark, "balance_changes")
    key = F.col("transaction_id").cast("long")
    for batch in (0, 1, 1, 2, 3):
        st.append_batch(spark, led.where(key % 4 == batch), path, batch)
        st.store_deltas(spark, path, changes, batch)
        if batch == 2:
            st.fold_deltas(spark, changes, upto=1)
    st.reverse_deltas(spark, led.where(key % 7 == 0), changes, batch=4)
    return st.balances_from_deltas(spark, changes)


RUNS_SQL = o.DETECT_NATION.rstrip() + "," + o.FLAGS + "," + o.CALL_LOG + "," + PRICED + """,
runs AS (
  SELECT 'monthly' AS analysis_period, current_month AS target_month,
         (SELECT count(*) FROM accounts) AS total_accounts_analyzed,
         count(*) AS anomalies_detected, count_if(severity = 'high') AS high_severity_count,
         count_if(severity = 'medium') AS medium_severity_count, count(*) + 2 AS total_llm_calls,
         (SELECT CAST(CAST(sum(cost_exact) AS DECIMAL(38,11)) AS DOUBLE) FROM priced2) AS total_cost_usd,
         CAST(last_day(CAST(current_month || '-01' AS DATE)) AS TIMESTAMP) AS created_at
  FROM flags GROUP BY current_month
)"""


def _runs(spark, sf):
    """Run rows with the cost of the call log."""
    from ..operators import costs as co
    cost = priced(spark, sf).agg(F.sum("cost_exact").cast(co.COST).cast("double")).scalar()
    return st.run_rows(nation_flags(spark, sf), ad.accounts_from_nations(spark, sf), cost_usd=cost)


@register("store_run", RUNS_SQL + "SELECT * FROM runs")
def store_run(spark, sf):
    """Run rows appended to a runs table and read back."""
    path = scratch_path(spark, "runs")
    st.store_run(_runs(spark, sf), path)
    return spark.read.parquet(path)


@register("latest_run", RUNS_SQL + "SELECT * FROM runs ORDER BY created_at DESC, target_month DESC LIMIT 1")
def latest_run(spark, sf):
    return st.latest_run(_runs(spark, sf))


@register("table_counts", RUNS_SQL + """
SELECT 'pl_transactions' AS table_name, count(*) AS rows FROM ledger
UNION ALL SELECT 'gl_accounts', count(*) FROM accounts
UNION ALL SELECT 'gl_monthly_balances', count(*) FROM balances
UNION ALL SELECT 'detected_anomalies', count(*) FROM flags
UNION ALL SELECT 'analysis_runs', count(*) FROM runs""")
def table_counts(spark, sf):
    from ..operators import balances as bal
    led = _ledger(spark, sf)
    return st.table_counts({
        "pl_transactions": led,
        "gl_accounts": ad.accounts_from_nations(spark, sf),
        "gl_monthly_balances": bal.monthly_balances(led),
        "detected_anomalies": nation_flags(spark, sf),
        "analysis_runs": _runs(spark, sf),
    })


@register("sort_ledger", o.with_(o.SQL_LEDGER_SUPPLIER) + "SELECT * FROM ledger ORDER BY transaction_date, transaction_id")
def sort_ledger(spark, sf):
    return st.sort_ledger(ad.ledger_by_supplier(spark, sf))


# ---------------------------------------------------------------------------
# Generators
# ---------------------------------------------------------------------------

@register("generate_accounts", """
SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS account_name,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'revenue' ELSE 'expense' END AS category,
       c_mktsegment AS subcategory,
       CAST(round((abs(c_acctbal) + 100.0) * 0.8, 2) AS DECIMAL(18,2)) AS typical_min,
       CAST(round((abs(c_acctbal) + 100.0) * 1.2, 2) AS DECIMAL(18,2)) AS typical_max,
       15.0::DOUBLE AS variance_threshold_pct, c_mktsegment = 'HOUSEHOLD' AS is_seasonal,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'December peak' END AS seasonal_pattern,
       'Account of ' || c_name AS description
FROM customer""")
def generate_accounts(spark, sf):
    from ..sources import generate as gen
    return gen.generate_accounts(ad.table(spark, sf, "customer"))


@register("generate_ledger")
def generate_ledger(spark, sf):
    """A synthetic monthly ledger for every customer over the months the
    orders span (rows-only check: the noise is Spark's hash)."""
    from ..sources import generate as gen
    o_ = ad.table(spark, sf, "orders")
    start = o_.agg(F.trunc(F.min("o_orderdate"), "MM")).scalar()
    end = o_.agg(F.trunc(F.max("o_orderdate"), "MM")).scalar()
    return gen.generate_ledger(gen.generate_accounts(ad.table(spark, sf, "customer")), start, end)


@register("generate_month")
def generate_month(spark, sf):
    """Next month's rows for every supplier account of the line-item ledger."""
    from ..operators import balances as bal
    from ..sources import generate as gen
    return gen.generate_month(bal.monthly_balances(ad.ledger_by_supplier(spark, sf)))


@register("run_analysis")
def run_analysis(spark, sf):
    """The full chain on the dense ledger's newest month: ingest to
    stored report; returns the report lines."""
    from .analysis import run_analysis as run
    raw = ad.raw_ledger_by_nation(spark, sf)
    acc = ad.accounts_from_nations(spark, sf)
    raw_acc = acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])
    return run(spark, raw, raw_acc, scratch_path(spark, "analysis"), calls=ad.call_log_from_events(spark, sf)).report


# ---------------------------------------------------------------------------
# DuckDB twins of the generators (same md5-derived noise)
# ---------------------------------------------------------------------------

def _noise_sql(seed: int, *parts: str) -> str:
    text = "concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return (f"(CAST((('0x' || substr(md5({text}), 1, 12))::BIGINT % 2000000) AS DOUBLE)"
            f" / CAST(1000000.0 AS DOUBLE) - CAST(1.0 AS DOUBLE))")


def _seasonal_sql(acc: str, month: str) -> str:
    from ..sources.generate import SEASONAL_FACTORS
    f = "1.0"
    for a, months, factor in SEASONAL_FACTORS:
        ms = ", ".join(str(m) for m in months)
        f = f"(CASE WHEN {acc} = '{a}' AND month({month}) IN ({ms}) THEN {f} * {factor} ELSE {f} END)"
    return f


_GEN_ACCOUNTS = """
accounts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS account_id,
         CAST(round((abs(c_acctbal) + 100.0) * 0.8, 2) AS DECIMAL(18,2)) AS typical_min,
         CAST(round((abs(c_acctbal) + 100.0) * 1.2, 2) AS DECIMAL(18,2)) AS typical_max
  FROM customer
),
span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS s,
                CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS e FROM orders),
base AS (
  SELECT account_id,
         coalesce((CAST(typical_min AS DOUBLE) + CAST(typical_max AS DOUBLE)) / 2, 10000.0) AS b,
         coalesce((CAST(typical_max AS DOUBLE) - CAST(typical_min AS DOUBLE)) / 2,
                  coalesce((CAST(typical_min AS DOUBLE) + CAST(typical_max AS DOUBLE)) / 2, 10000.0) * 0.1) AS sp
  FROM accounts
),
rows_ AS (
  SELECT account_id, b, sp, CAST(unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS DATE) AS month, e
  FROM base, span
)"""

_amount = (f"(b + {_noise_sql(42, 'account_id', 'month')} * sp * 0.1) * {_seasonal_sql('account_id', 'month')}")
_anom = f"(month = e AND {_noise_sql(43, 'account_id')} < (0.05 * 2 - 1))"
_shock = f"(0.3 + ({_noise_sql(44, 'account_id')} + 1) * 1.35)"

GENERATE_LEDGER_SQL = "WITH " + _GEN_ACCOUNTS.strip() + f"""
SELECT 'TXN-' || account_id || '-' || strftime(month, '%Y%m') AS transaction_id,
       account_id AS gl_account_id,
       CAST(month + INTERVAL 14 DAY AS DATE) AS transaction_date,
       CAST(round(CASE WHEN {_anom} THEN {_amount} * {_shock} ELSE {_amount} END, 2) AS DECIMAL(18,2)) AS amount,
       CASE WHEN {_anom} THEN 'ANOMALY: monthly ' || account_id || ' - ' || strftime(month, '%B %Y')
            ELSE 'Monthly ' || account_id || ' - ' || strftime(month, '%B %Y') END AS description,
       'Operations' AS department,
       'Vendor_' || account_id AS vendor,
       'pl_' || strftime(month, '%Y-%m') || '.csv' AS source_file
FROM rows_"""

_m_pick = f"({_noise_sql(7, 'gl_account_id')} < (0.3 * 2 - 1))"
_m_shock = f"(0.3 + ({_noise_sql(8, 'gl_account_id')} + 1) * 1.35)"
_m_amount = f"(CAST(last AS DOUBLE) * (1.0 + {_noise_sql(9, 'gl_account_id')} * 0.05))"

GENERATE_MONTH_SQL = o.with_(o.SQL_LEDGER_SUPPLIER, o.BALANCES) + f""",
last_ AS (SELECT gl_account_id, arg_max(net_balance, month) AS last,
                 CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS nm
          FROM balances GROUP BY gl_account_id)
SELECT 'TXN-' || gl_account_id || '-' || strftime(nm, '%Y%m') AS transaction_id,
       gl_account_id,
       CAST(nm + INTERVAL 14 DAY AS DATE) AS transaction_date,
       CAST(round(CASE WHEN {_m_pick} THEN {_m_amount} * {_m_shock} ELSE {_m_amount} END, 2) AS DECIMAL(18,2)) AS amount,
       CASE WHEN {_m_pick} THEN 'ANOMALY: next month' ELSE 'Next month' END AS description,
       'Operations' AS department,
       'Vendor_' || gl_account_id AS vendor,
       'pl_' || strftime(nm, '%Y-%m') || '.csv' AS source_file
FROM last_"""

from .catalog import ORACLE as _ORACLE  # noqa: E402

_ORACLE["generate_ledger"] = GENERATE_LEDGER_SQL
_ORACLE["generate_month"] = GENERATE_MONTH_SQL
