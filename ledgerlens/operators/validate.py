"""Validation and typed projection of ledger and account files.

Checks are column expressions evaluated in the same pass as the projection.
``mode="fail"`` aborts the job at the first bad row with ``raise_error``
(no extra pass over the data); ``mode="quarantine"`` returns the good rows and
the bad rows with the list of rules each one broke.  :func:`classify` gives
both in one frame, to be written once and read back apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (ACCOUNT_CATEGORIES, BAD_LINE, DEFAULT_ACCOUNT_THRESHOLD, DIRECTIONS, IDENTIFIER_PATTERN,
                       MONEY, MONTH_PATTERN, NUMBER_PATTERN, SECRET_KEY_PATTERN, SEVERITIES, missing_columns)


def check_required_columns(df: DataFrame, kind: str) -> None:
    """Raise when required columns are missing (schema only, no job)."""
    missing = missing_columns(df.columns, kind)
    if missing:
        raise ValueError(f"Missing required columns in {kind} data: {missing}")


def _strict_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def strict_number(c: Column, kind: str = "decimal(20,4)") -> Column:
    """The one conversion of number text, used by checks and projection: a
    plain decimal number (sign, digits, point, exponent) that fits ``kind``;
    NULL for anything else, such as ``12d``, ``NaN``, ``Infinity`` or ``1e17``."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast(kind))


def _line_rule(df: DataFrame) -> dict[str, Column]:
    """Rows read from a file: a line must have the fields of its header."""
    return {"malformed_line": F.col(BAD_LINE).isNotNull()} if BAD_LINE in df.columns else {}


def ledger_rules(df: DataFrame) -> dict[str, Column]:
    """Rule name -> condition that is true when the row breaks the rule."""
    amount_num = strict_number(F.col("amount"))
    return _line_rule(df) | {
        "null_account": F.col("gl_account_id").isNull(),
        "null_amount": F.col("amount").isNull(),
        "non_numeric_amount": F.col("amount").isNotNull() & amount_num.isNull(),
        "bad_date": F.col("date").isNull() | _strict_date(F.col("date")).isNull(),
        "zero_amount": F.round(amount_num, 2) == 0,
        "null_transaction_id": F.col("transaction_id").isNull(),
    }


def account_rules(df: DataFrame) -> dict[str, Column]:
    rules = _line_rule(df) | {
        "null_account_id": F.col("account_id").isNull(),
        "bad_category": ~F.coalesce(F.lower(F.col("category")).isin(ACCOUNT_CATEGORIES), F.lit(False)),
    }
    if "variance_threshold_pct" in df.columns:
        thr = strict_number(F.col("variance_threshold_pct"), "double")
        rules["threshold_out_of_range"] = F.col("variance_threshold_pct").isNotNull() & ~F.coalesce(thr.between(0, 100), F.lit(False))
    return rules


def quality_report(df: DataFrame, kind: str = "ledger") -> DataFrame:
    """One row: total rows and the number of rows breaking each rule (one pass)."""
    rules = ledger_rules(df) if kind == "ledger" else account_rules(df)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])


def _broken(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]),
                    lambda x: x.isNotNull())


def _optional(df: DataFrame, c: str, kind: str = "string") -> Column:
    """An optional column: NULL where it is absent or empty."""
    return F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)


def _ledger_columns(df: DataFrame) -> list[Column]:
    src = F.col("source_file") if "source_file" in df.columns else F.lit(None).cast("string")
    return [F.col("transaction_id"), F.col("gl_account_id"), _strict_date(F.col("date")).alias("transaction_date"),
            F.round(strict_number(F.col("amount")), 2).cast(MONEY).alias("amount"), F.col("description"),
            _optional(df, "department").alias("department"), _optional(df, "vendor").alias("vendor"), src.alias("source_file")]


def _account_columns(df: DataFrame) -> list[Column]:
    seasonal = F.lower(_optional(df, "is_seasonal")).isin("true", "1", "yes")
    return [F.col("account_id"), F.col("account_name"), F.lower(F.trim(F.col("category"))).alias("category"),
            _optional(df, "subcategory").alias("subcategory"),
            _optional(df, "typical_min", "decimal(18,2)").alias("typical_min"),
            _optional(df, "typical_max", "decimal(18,2)").alias("typical_max"),
            F.coalesce(_optional(df, "variance_threshold_pct", "double"), F.lit(DEFAULT_ACCOUNT_THRESHOLD)).alias("variance_threshold_pct"),
            F.coalesce(seasonal, F.lit(False)).alias("is_seasonal"),
            _optional(df, "seasonal_pattern").alias("seasonal_pattern"),
            _optional(df, "description").alias("description")]


#: by kind of file: rules, typed columns, the column that names a row
_KINDS = {"ledger": (ledger_rules, _ledger_columns, "transaction_id"), "accounts": (account_rules, _account_columns, "account_id")}


def classify(raw: DataFrame, kind: str = "ledger") -> DataFrame:
    """Every row with ``broken_rules`` (empty for a good one), its typed
    columns as ``good`` (null for a bad one) and its text columns as ``raw``:
    one pass, from which good and bad rows are told apart later."""
    check_required_columns(raw, kind)
    rules, columns, _ = _KINDS[kind]
    flagged = raw.withColumn("broken_rules", _broken(rules(raw)))
    ok = F.size("broken_rules") == 0
    return flagged.select("broken_rules", F.when(ok, F.struct(*columns(raw))).alias("good"),
                          F.when(~ok, F.struct(*[F.col(c) for c in raw.columns])).alias("raw"))


def _apply(raw: DataFrame, kind: str, mode: str):
    check_required_columns(raw, kind)
    rules, columns, id_col = _KINDS[kind]
    if mode == "fail":
        broken = _broken(rules(raw))
        guard = F.when(F.size(broken) > 0, F.raise_error(F.concat(
            F.lit("Data quality check failed for row "), F.coalesce(F.col(id_col), F.lit("<null>")),
            F.lit(": "), F.array_join(broken, ", "))))
        return raw.withColumn("_guard", guard).filter(F.col("_guard").isNull()).drop("_guard").select(*columns(raw))
    if mode == "quarantine":
        both = classify(raw, kind)
        return both.where(F.size("broken_rules") == 0).select("good.*"), both.where(F.size("broken_rules") > 0).select("raw.*", "broken_rules")
    raise ValueError(f"mode must be 'fail' or 'quarantine': {mode}")


def project_ledger(raw: DataFrame, mode: str = "fail"):
    """Rename ``date`` to ``transaction_date``, type every column, round the
    amount to cents.  Empty optional text stays NULL."""
    return _apply(raw, "ledger", mode)


def project_accounts(raw: DataFrame, mode: str = "fail"):
    """Type the account master.  Threshold defaults to 15 and ``is_seasonal``
    to false when the column is absent or empty."""
    return _apply(raw, "accounts", mode)


def check_balance_domain(balances: DataFrame) -> DataFrame:
    """Rows whose month label is not YYYY-MM or whose count is negative."""
    label = F.date_format("month", "yyyy-MM")
    return balances.filter(~label.rlike(MONTH_PATTERN) | (F.col("transaction_count") < 0))


def check_flag_domain(flags: DataFrame, confidence_col: str | None = None) -> DataFrame:
    """Normalise direction / severity (lower + trim) and flag rows outside
    their domains; confidence, when given, must lie in [0, 1]."""
    d = F.lower(F.trim(F.col("direction")))
    s = F.lower(F.trim(F.col("severity")))
    ok = d.isin(DIRECTIONS) & s.isin(SEVERITIES)
    if confidence_col:
        ok = ok & F.col(confidence_col).between(0, 1)
    return flags.withColumn("direction", d).withColumn("severity", s).withColumn(
        "domain_ok", F.coalesce(ok, F.lit(False)))


def validate_month(c: Column) -> Column:
    """``YYYY-MM`` with a real month."""
    return c.rlike(MONTH_PATTERN) & F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd").isNotNull()


def validate_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER_PATTERN), F.lit(False))


def validate_keys(pairs: DataFrame, key_name: str = "OPENAI_API_KEY") -> DataFrame:
    """(name, value) -> valid, error.  The named secret must match the key
    pattern; other keys only need to be present."""
    missing = F.col("value").isNull() | (F.col("value") == "")
    fmt_ok = F.col("value").rlike(SECRET_KEY_PATTERN)
    valid = F.when(missing, F.lit(False)).when(F.col("name") == key_name, fmt_ok).otherwise(F.lit(True))
    error = (F.when(missing, F.lit("Missing"))
             .when((F.col("name") == key_name) & ~fmt_ok, F.lit("Invalid format")))
    return pairs.withColumn("valid", valid).withColumn("error", error)
