"""Schemas and fixed rule values of the ledger model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Sums of money keep two decimals and get the widest precision, so a sum
# over any number of rows can not overflow before 10**36.
MONEY_SUM = T.DecimalType(38, 2)

# Raw ledger file: every column read as text, typed after validation.
LEDGER_RAW = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("gl_account_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("vendor", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("gl_account_id", T.StringType(), False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("description", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("source_file", T.StringType()),
])

ACCOUNTS_RAW = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("typical_min", T.StringType()),
    T.StructField("typical_max", T.StringType()),
    T.StructField("variance_threshold_pct", T.StringType()),
    T.StructField("is_seasonal", T.StringType()),
    T.StructField("seasonal_pattern", T.StringType()),
    T.StructField("description", T.StringType()),
])

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("account_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("typical_min", MONEY),
    T.StructField("typical_max", MONEY),
    T.StructField("variance_threshold_pct", T.DoubleType()),
    T.StructField("is_seasonal", T.BooleanType()),
    T.StructField("seasonal_pattern", T.StringType()),
    T.StructField("description", T.StringType()),
])

CALL_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("model", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("call_duration", T.DoubleType()),
    T.StructField("query_preview", T.StringType()),
])

INVESTIGATIONS = T.StructType([
    T.StructField("anomaly_id", T.StringType(), False),
    T.StructField("gl_account_id", T.StringType(), False),
    T.StructField("detected_month", T.DateType(), False),
    T.StructField("variance_percent", T.DoubleType()),
    T.StructField("variance_amount", MONEY_SUM),
    T.StructField("severity", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("llm_explanation", T.StringType()),
    T.StructField("llm_confidence", T.DoubleType()),
    T.StructField("is_true_anomaly", T.BooleanType()),
    T.StructField("investigation_notes", T.StringType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("resolved_at", T.TimestampNTZType()),
    T.StructField("run_id", T.StringType()),
])

FEEDBACK = T.StructType([
    T.StructField("anomaly_id", T.StringType(), False),
    T.StructField("is_true_anomaly", T.BooleanType(), False),
    T.StructField("correct_explanation", T.StringType()),
    T.StructField("adjust_threshold", T.BooleanType()),
    T.StructField("resolution_notes", T.StringType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("feedback_ts", T.TimestampNTZType()),
])

STORED_RESULTS = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("size_bytes", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
LEDGER_REQUIRED_COLUMNS = ["transaction_id", "gl_account_id", "date", "amount", "description"]
ACCOUNTS_REQUIRED_COLUMNS = ["account_id", "account_name", "category"]
ACCOUNT_CATEGORIES = ["expense", "revenue", "asset", "liability"]
SEVERITIES = ["high", "medium", "low"]
DIRECTIONS = ["increase", "decrease"]
THRESHOLD_HIGH = 30.0
THRESHOLD_MEDIUM = 15.0
DEFAULT_ACCOUNT_THRESHOLD = 15.0
MATERIAL_PCT = 15.0
MATERIAL_AMOUNT = 10000
ROLLING_AVG_MONTHS = 3
ROLLING_STD_MONTHS = 6
OUTLIER_Z = 2.0
HISTORY_LIMIT = 5
RETRIEVAL_HISTORY_LIMIT = 3
RETRIEVAL_K = 3
SIMILAR_CASES_K = 5
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
REUSE_TTL_SECONDS = 3600
RATE_PER_MINUTE = 60
RATE_PER_HOUR = 1000
MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"
IDENTIFIER_PATTERN = r"^[a-zA-Z0-9_]+$"
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SECRET_KEY_PATTERN = r"^sk-[a-zA-Z0-9]{48,}$"
NO_DOCUMENTATION = "No documentation found"
HISTORY_QUERY_PREFIX = "Historical anomaly: "

#: raw column with a file's line that does not have the fields of its header
BAD_LINE = "bad_line"


def missing_columns(names, kind: str) -> list[str]:
    """The required columns of a ledger or account file that are not among ``names``."""
    required = {"ledger": LEDGER_REQUIRED_COLUMNS, "accounts": ACCOUNTS_REQUIRED_COLUMNS}[kind]
    return [c for c in required if c not in names]
