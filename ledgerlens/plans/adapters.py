"""Driver tables seen as ledger inputs.

The test tables are a TPC-H-like star schema, not ledgers.  These adapters
give them the ledger shape (transactions, account master, call log) with
plain projections and joins, so every operator runs on data that grows with
the scale factor.  ``sql_ctes`` repeats each adapter as a DuckDB CTE for the
oracle queries; both forms must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# Ledgers
# --------------------------------------------------------------------------

def ledger_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few dense accounts: one account per customer nation (25)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("c_nationkey").cast("string").alias("gl_account_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.col("c_mktsegment").alias("department"),
        F.col("o_orderpriority").alias("vendor"),
        F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".csv")).alias("source_file"),
    )


def ledger_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many sparse accounts: one account per customer.  Most customers skip
    months, so this is the case where a per-account ``lag`` is wrong."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("gl_account_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.col("o_orderstatus").alias("department"),
        F.col("o_orderpriority").alias("vendor"),
        F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".csv")).alias("source_file"),
    )


def ledger_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest ledger: one line item is one transaction, account = supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_suppkey").cast("string").alias("gl_account_id"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.concat(F.lit("Line "), F.col("l_orderkey").cast("string")).alias("description"),
        F.col("l_returnflag").alias("department"),
        F.col("l_linestatus").alias("vendor"),
        F.concat(F.lit("lineitem_"), F.date_format("l_shipdate", "yyyy-MM"), F.lit(".csv")).alias("source_file"),
    )


def raw_ledger_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense ledger as the text columns of a ledger file (for validation)."""
    led = ledger_by_nation(spark, sf_dir)
    return led.select(
        "transaction_id", "gl_account_id",
        F.col("transaction_date").cast("string").alias("date"),
        F.col("amount").cast("string").alias("amount"),
        "description", "department", "vendor", "source_file")


def quoted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense ledger with text that needs quoting in a CSV file: quotes,
    commas and backslashes, also at the end of a value."""
    led = ledger_by_nation(spark, sf_dir)
    return led.withColumns({
        "description": F.concat(F.lit('he said "'), F.col("description"), F.lit('", ok\\')),
        "vendor": F.concat(F.lit('"'), F.col("vendor"), F.lit('\\", ')) })


SQL_QUOTED_LEDGER = """
quoted AS (SELECT * REPLACE ('he said "' || description || '", ok\\' AS description, trim('"' || vendor || '\\", ') AS vendor) FROM ledger)"""


#: amounts as files get them wrong, and right in unusual ways, by order key modulo 40
ODD_AMOUNTS = {0: "12d", 1: "3.5f", 2: "NaN", 3: "Infinity", 4: "1e17", 5: "0", 6: "-0.00", 7: "0.004", 8: "abc", 9: "",
               10: " 12.50 ", 11: "+7", 12: "1.5E3", 13: ".5", 14: "7.", 15: "1,000", 16: "0x1F"}
#: dates, by order key modulo 23
ODD_DATES = {0: "1998-02-30", 1: "02/03/1998", 2: "1998-1-5", 3: ""}


def dirty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense ledger as file text, with faults derived from each row's
    order key, and text that needs quoting in a file."""
    raw = raw_ledger_by_nation(spark, sf_dir)
    k = F.col("transaction_id").cast("long")
    amount, date = F.col("amount"), F.col("date")
    for i, v in ODD_AMOUNTS.items():
        amount = F.when(k % 40 == i, F.lit(v)).otherwise(amount)
    for i, v in ODD_DATES.items():
        date = F.when(k % 23 == i, F.lit(v)).otherwise(date)
    return raw.select(
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("transaction_id")).alias("transaction_id"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(F.col("gl_account_id")).alias("gl_account_id"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(date).alias("date"),
        F.when(k % 41 == 0, F.lit(None)).otherwise(amount).alias("amount"),
        "description", "department", "vendor", "source_file", k.alias("row_key"))


def _cases(column: str, key: str, n: int, values: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {n} = {i} THEN '{v}'" for i, v in values.items()) + f" ELSE {column} END"


SQL_DIRTY_LEDGER = f"""
dirty AS (SELECT CASE WHEN row_key % 97 = 0 THEN NULL ELSE transaction_id END AS transaction_id,
  CASE WHEN row_key % 31 = 0 THEN NULL ELSE gl_account_id END AS gl_account_id,
  CASE WHEN row_key % 37 = 0 THEN NULL ELSE {_cases("CAST(transaction_date AS VARCHAR)", "row_key", 23, ODD_DATES)} END AS date,
  CASE WHEN row_key % 41 = 0 THEN NULL ELSE {_cases("CAST(amount AS VARCHAR)", "row_key", 40, ODD_AMOUNTS)} END AS amount,
  description, department, vendor, source_file, row_key
  FROM (SELECT *, CAST(transaction_id AS BIGINT) AS row_key FROM ledger)),
judged AS (SELECT *, CASE WHEN regexp_full_match(trim(amount), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                           AND abs(CAST(trim(amount) AS DOUBLE)) < 1e16
                     THEN CAST(CAST(trim(amount) AS DOUBLE) AS DECIMAL(20,4)) END AS number,
  regexp_full_match(coalesce(date, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(date, '%Y-%m-%d') IS NOT NULL AS good_date
  FROM dirty),
broken AS (SELECT *, gl_account_id IS NULL AS null_account, amount IS NULL AS null_amount,
  amount IS NOT NULL AND number IS NULL AS non_numeric_amount, NOT good_date AS bad_date,
  coalesce(round(number, 2) = 0, FALSE) AS zero_amount, transaction_id IS NULL AS null_transaction_id FROM judged)"""


# --------------------------------------------------------------------------
# Account masters
# --------------------------------------------------------------------------

def dirty_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer accounts as file text, with faults derived from the key."""
    acc = accounts_from_customers(spark, sf_dir)
    raw = acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])
    k = F.col("account_id").cast("long")
    return raw.withColumns({
        "row_key": k, "account_id": F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("account_id")),
        "category": F.when(k % 7 == 0, F.lit("misc")).when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.upper("category"))
                     .otherwise(F.col("category")),
        "variance_threshold_pct": F.when(k % 10 == 0, F.lit("140")).when(k % 10 == 1, F.lit("-1")).when(k % 10 == 2, F.lit("x"))
                     .when(k % 10 == 3, F.lit(None)).when(k % 10 == 4, F.lit("100")).otherwise(F.col("variance_threshold_pct"))})


SQL_DIRTY_ACCOUNTS = """
dirty_acc AS (SELECT CAST(account_id AS BIGINT) AS row_key,
  CASE WHEN CAST(account_id AS BIGINT) % 29 = 0 THEN NULL ELSE account_id END AS account_id,
  CASE WHEN CAST(account_id AS BIGINT) % 7 = 0 THEN 'misc' WHEN CAST(account_id AS BIGINT) % 11 = 0 THEN NULL
       WHEN CAST(account_id AS BIGINT) % 13 = 0 THEN upper(category) ELSE category END AS category,
  CASE CAST(account_id AS BIGINT) % 10 WHEN 0 THEN '140' WHEN 1 THEN '-1' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '100'
       ELSE CAST(variance_threshold_pct AS VARCHAR) END AS variance_threshold_pct
  FROM accounts),
broken_acc AS (SELECT row_key, account_id IS NULL AS null_account_id,
  NOT coalesce(lower(category) IN ('expense', 'revenue', 'asset', 'liability'), FALSE) AS bad_category,
  variance_threshold_pct IS NOT NULL AND NOT coalesce(try_cast(variance_threshold_pct AS DOUBLE) BETWEEN 0 AND 100, FALSE)
    AS threshold_out_of_range FROM dirty_acc)"""


def accounts_from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey, "inner")
    return j.select(
        F.col("n_nationkey").cast("string").alias("account_id"),
        F.col("n_name").alias("account_name"),
        F.when(F.col("n_regionkey").isin(1, 3), F.lit("revenue")).otherwise(F.lit("expense")).alias("category"),
        F.col("r_name").alias("subcategory"),
        F.when(F.col("n_nationkey") == 0, F.lit(None))
         .otherwise(F.col("n_nationkey") * 10000).cast(MONEY).alias("typical_min"),
        (F.col("n_nationkey") * 10000 + 500000).cast(MONEY).alias("typical_max"),
        (F.col("n_nationkey") + 10).cast("double").alias("variance_threshold_pct"),
        (F.col("n_regionkey") == 2).alias("is_seasonal"),
        F.when(F.col("n_regionkey") == 2, F.lit("Q4 peak")).alias("seasonal_pattern"),
        F.concat(F.col("n_name"), F.lit(" ledger account")).alias("description"),
    )


def accounts_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("revenue"))
         .otherwise(F.lit("expense")).alias("category"),
        F.col("c_mktsegment").alias("subcategory"),
        F.lit(None).cast(MONEY).alias("typical_min"),
        F.lit(None).cast(MONEY).alias("typical_max"),
        F.lit(15.0).alias("variance_threshold_pct"),
        F.lit(False).alias("is_seasonal"),
        F.lit(None).cast("string").alias("seasonal_pattern"),
        F.lit(None).cast("string").alias("description"),
    )


def accounts_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("account_id"),
        F.col("s_name").alias("account_name"),
        F.lit("expense").alias("category"),
        F.col("s_nationkey").cast("string").alias("subcategory"),
        F.lit(None).cast(MONEY).alias("typical_min"),
        F.lit(None).cast(MONEY).alias("typical_max"),
        F.lit(15.0).alias("variance_threshold_pct"),
        F.lit(False).alias("is_seasonal"),
        F.lit(None).cast("string").alias("seasonal_pattern"),
        F.lit(None).cast("string").alias("description"),
    )


# --------------------------------------------------------------------------
# Call log (events stand in for model calls)
# --------------------------------------------------------------------------

# Models the call log cycles through; the last one has no price and falls
# back to the default model's price.
CALL_LOG_MODELS = ["gpt-4", "gpt-4-turbo", "gpt-4o", "gpt-4o-mini", "gpt-5",
                   "text-embedding-3-small", "text-embedding-3-large",
                   "text-embedding-ada-002", "unlisted-model"]


def call_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in CALL_LOG_MODELS])
    model = F.element_at(models, (F.col("user_id") % len(CALL_LOG_MODELS) + 1).cast("int"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("ts"),
        model.alias("model"),
        F.col("event_type").alias("agent"),
        F.col("user_id").alias("caller_id"),
        (F.col("value") * 100).cast("long").alias("input_tokens"),
        F.when(model.startswith("text-embedding"), F.lit(0))
         .otherwise(F.col("event_id") % 700).cast("long").alias("output_tokens"),
        (F.col("value") / 100).alias("call_duration"),
        F.substring(F.col("props"), 1, 100).alias("query_preview"),
    )


# --------------------------------------------------------------------------
# DuckDB twins of the adapters, for the oracle queries.
# --------------------------------------------------------------------------

SQL_LEDGER_NATION = """
ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
         CAST(c_nationkey AS VARCHAR) AS gl_account_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         'Order ' || CAST(o_orderkey AS VARCHAR) AS description,
         c_mktsegment AS department,
         o_orderpriority AS vendor,
         'orders_' || strftime(o_orderdate, '%Y-%m') || '.csv' AS source_file
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

SQL_LEDGER_CUSTOMER = """
ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
         CAST(o_custkey AS VARCHAR) AS gl_account_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         'Order ' || CAST(o_orderkey AS VARCHAR) AS description,
         o_orderstatus AS department,
         o_orderpriority AS vendor,
         'orders_' || strftime(o_orderdate, '%Y-%m') || '.csv' AS source_file
  FROM orders
)"""

SQL_LEDGER_SUPPLIER = """
ledger AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         CAST(l_suppkey AS VARCHAR) AS gl_account_id,
         CAST(l_shipdate AS DATE) AS transaction_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         'Line ' || CAST(l_orderkey AS VARCHAR) AS description,
         l_returnflag AS department,
         l_linestatus AS vendor,
         'lineitem_' || strftime(l_shipdate, '%Y-%m') || '.csv' AS source_file
  FROM lineitem
)"""

SQL_ACCOUNTS_NATION = """
accounts AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS account_id,
         n_name AS account_name,
         CASE WHEN n_regionkey IN (1, 3) THEN 'revenue' ELSE 'expense' END AS category,
         r_name AS subcategory,
         CAST(CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey * 10000 END AS DECIMAL(18,2)) AS typical_min,
         CAST(n_nationkey * 10000 + 500000 AS DECIMAL(18,2)) AS typical_max,
         CAST(n_nationkey + 10 AS DOUBLE) AS variance_threshold_pct,
         n_regionkey = 2 AS is_seasonal,
         CASE WHEN n_regionkey = 2 THEN 'Q4 peak' END AS seasonal_pattern,
         n_name || ' ledger account' AS description
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SQL_ACCOUNTS_CUSTOMER = """
accounts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS account_id,
         c_name AS account_name,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'revenue' ELSE 'expense' END AS category,
         c_mktsegment AS subcategory,
         CAST(NULL AS DECIMAL(18,2)) AS typical_min,
         CAST(NULL AS DECIMAL(18,2)) AS typical_max,
         15.0::DOUBLE AS variance_threshold_pct,
         FALSE AS is_seasonal,
         CAST(NULL AS VARCHAR) AS seasonal_pattern,
         CAST(NULL AS VARCHAR) AS description
  FROM customer
)"""

SQL_ACCOUNTS_SUPPLIER = """
accounts AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS account_id,
         s_name AS account_name,
         'expense' AS category,
         CAST(s_nationkey AS VARCHAR) AS subcategory,
         CAST(NULL AS DECIMAL(18,2)) AS typical_min,
         CAST(NULL AS DECIMAL(18,2)) AS typical_max,
         15.0::DOUBLE AS variance_threshold_pct,
         FALSE AS is_seasonal,
         CAST(NULL AS VARCHAR) AS seasonal_pattern,
         CAST(NULL AS VARCHAR) AS description
  FROM supplier
)"""

_models_sql = ", ".join(f"'{m}'" for m in CALL_LOG_MODELS)

SQL_CALL_LOG = f"""
call_log AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id,
         ts,
         ([{_models_sql}])[CAST(user_id % {len(CALL_LOG_MODELS)} AS INTEGER) + 1] AS model,
         event_type AS agent,
         user_id AS caller_id,
         CAST(trunc(value * 100) AS BIGINT) AS input_tokens,
         CASE WHEN starts_with(([{_models_sql}])[CAST(user_id % {len(CALL_LOG_MODELS)} AS INTEGER) + 1], 'text-embedding')
              THEN 0 ELSE event_id % 700 END::BIGINT AS output_tokens,
         value / 100 AS call_duration,
         substr(props, 1, 100) AS query_preview
  FROM events
)"""
