"""Explanations, report sections and the markdown report as DataFrames.

Explanations here are deterministic rules over the facts (range, season,
z-score, history); a user function can replace or extend them through
``explain_with`` (``mapInPandas``, Arrow batches).  Report text is built
with string expressions; only the finished report, which is small by
definition, is written through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .history import anomaly_key


def money(c: Column) -> Column:
    """``12,345.67`` (two decimals, thousands commas)."""
    return F.when(c.isNotNull(), F.format_string("%,.2f", c.cast("decimal(38,2)").cast("double")))


def signed_money(c: Column) -> Column:
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), money(c))


def fmt2(c: Column) -> Column:
    """Two decimals, rounded half-up on the decimal value (engine-independent)."""
    return F.when(c.isNotNull(), F.format_string("%.2f", F.round(c.cast("decimal(38,6)"), 2).cast("double")))


def signed_pct(c: Column) -> Column:
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), fmt2(c), F.lit("%"))


EXPLANATION_COLS = ["anomaly_id", "gl_account_id", "month", "severity", "is_expected_variance", "confidence",
                    "chain_of_thought", "root_cause", "supporting_evidence", "recommendation",
                    "requires_immediate_attention"]


def explain_anomalies(flags: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rule-based explanation per flagged row: expected or not, confidence,
    reasoning steps, root cause, evidence list, recommendation, urgency.  The flag columns
    are kept, so sections and reports read this one frame (no second
    evaluation of the flags to join back)."""
    acc = accounts.select(F.col("account_id").alias("gl_account_id"), "typical_min", "typical_max",
                          "is_seasonal", "seasonal_pattern")
    j = flags.join(acc, "gl_account_id", "left")
    in_range = (F.col("current_balance") >= F.col("typical_min")) & (F.col("current_balance") <= F.col("typical_max"))
    expected = F.coalesce(in_range, F.lit(False)) | F.coalesce(F.col("is_seasonal"), F.lit(False))
    zdec = F.abs(F.coalesce(F.col("z_score"), F.lit(0.0))).cast("decimal(12,4)")
    conf = F.least(F.lit(0.95).cast("decimal(12,5)"),
                   (F.lit(0.5).cast("decimal(12,5)") + zdec / F.lit(10)).cast("decimal(12,5)"))
    confidence = F.round(conf, 2).cast("double")
    root = F.concat(
        F.lit("Balance moved from "), money(F.col("previous_balance")), F.lit(" to "), money(F.col("current_balance")),
        F.lit(" ("), signed_pct(F.col("variance_percent")), F.lit("); "),
        F.when(F.coalesce(in_range, F.lit(False)), F.lit("still inside the typical range"))
        .when(F.coalesce(F.col("is_seasonal"), F.lit(False)), F.lit("consistent with a seasonal account"))
        .otherwise(F.lit("outside the expected pattern")))
    evidence = F.array(
        F.concat(F.lit("Current balance "), money(F.col("current_balance"))),
        F.concat(F.lit("Previous balance "), money(F.col("previous_balance"))),
        F.concat(F.lit("Change "), signed_money(F.col("variance_amount"))),
        F.concat(F.lit("Typical range "), F.coalesce(F.col("typical_range"), F.lit("N/A"))),
        F.concat(F.lit("Z-score "), F.coalesce(fmt2(F.col("z_score")), F.lit("N/A"))),
    )
    steps = F.concat_ws(
        "\n",
        F.concat(F.lit("1. The balance changed by "), signed_pct(F.col("variance_percent")), F.lit(" ("),
                 signed_money(F.col("variance_amount")), F.lit(").")),
        F.concat(F.lit("2. Typical range "), F.coalesce(F.col("typical_range"), F.lit("N/A")), F.lit(": the balance is "),
                 F.when(in_range, F.lit("inside it.")).when(in_range.isNull(), F.lit("not comparable."))
                 .otherwise(F.lit("outside it."))),
        F.concat(F.lit("3. Z-score "), F.coalesce(fmt2(F.col("z_score")), F.lit("N/A")), F.lit(", past anomalies "),
                 F.coalesce(F.col("past_anomaly_count"), F.lit(0)).cast("string"), F.lit(".")),
        F.when(expected, F.lit("4. Conclusion: expected variance."))
        .otherwise(F.lit("4. Conclusion: true anomaly, needs investigation.")))
    rec = (F.when(F.col("severity") == "high", F.lit("Review the transactions behind this change now."))
           .when(F.col("severity") == "medium", F.lit("Review within 48 hours."))
           .otherwise(F.lit("Monitor next month.")))
    return j.select(
        anomaly_key(F.col("gl_account_id"), F.col("month")).alias("anomaly_id"),
        *[c for c in flags.columns],
        expected.alias("is_expected_variance"),
        confidence.alias("confidence"),
        steps.alias("chain_of_thought"),
        root.alias("root_cause"),
        evidence.alias("supporting_evidence"),
        rec.alias("recommendation"),
        ((F.col("severity") == "high") & ~expected).alias("requires_immediate_attention"),
    )


def explain_with(flags: DataFrame, fn, schema) -> DataFrame:
    """Run a user explanation function over Arrow batches of flagged rows
    (``fn(iterator of pandas.DataFrame) -> iterator of pandas.DataFrame``)."""
    return flags.mapInPandas(fn, schema)


def explanation_requests(flags: DataFrame, history: DataFrame | None = None, context: DataFrame | None = None,
                         n_history: int = 5) -> DataFrame:
    """The full fact text per flagged row (what an explainer is given):
    numbers, rolling statistics or ``N/A``, documentation and history."""
    def na(c):
        return F.coalesce(fmt2(c), F.lit("N/A"))
    keyed = flags.withColumn("anomaly_id", anomaly_key(F.col("gl_account_id"), F.col("month")))
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("Account: "), F.col("gl_account_id"), F.lit(" "), F.coalesce(F.col("account_name"), F.lit(""))),
        F.concat(F.lit("Month: "), F.col("current_month"), F.lit(" vs "), F.col("previous_month")),
        F.concat(F.lit("Current balance: "), money(F.col("current_balance"))),
        F.concat(F.lit("Previous balance: "), money(F.col("previous_balance"))),
        F.concat(F.lit("Change: "), signed_money(F.col("variance_amount")), F.lit(" ("),
                 signed_pct(F.col("variance_percent")), F.lit(")")),
        F.concat(F.lit("Transactions: "), F.col("transaction_count").cast("string")),
        F.concat(F.lit("3-month average: "), na(F.col("rolling_3mo_avg"))),
        F.concat(F.lit("6-month std dev: "), na(F.col("rolling_6mo_std"))),
        F.concat(F.lit("Z-score: "), na(F.col("z_score"))),
        F.concat(F.lit("Typical range: "), F.coalesce(F.col("typical_range"), F.lit("N/A"))),
    )
    out = keyed.withColumn("facts", facts)
    if history is not None:
        # At most n_history rows per account are collected (top-n first).
        w = Window.partitionBy("gl_account_id").orderBy(F.col("detected_month").desc(), F.col("anomaly_id").desc())
        h = (history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_history)
             .groupBy("gl_account_id")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("_r"), F.concat(
                 F.date_format("detected_month", "yyyy-MM"), F.lit(": "), fmt2(F.col("variance_percent")),
                 F.lit("% ("), F.col("severity"), F.lit(")")).alias("line")))).alias("_h")))
        out = (out.join(h, "gl_account_id", "left")
               .withColumn("history_text", F.coalesce(F.array_join(F.transform("_h", lambda x: x["line"]), "\n"),
                                                      F.lit("No past investigations")))
               .drop("_h"))
    if context is not None:
        out = out.join(context.select("anomaly_id", "account_documentation"), "anomaly_id", "left")
    return out


SEVERITY_MARK = {"high": "[HIGH]", "medium": "[MEDIUM]", "low": "[LOW]"}


#: stands where an explanation gives no evidence
NO_EVIDENCE = "Analysis based on variance data and GL documentation"


def _evidence() -> Column:
    """Evidence items with their amounts repaired: ``$`` escaped for markdown,
    amounts broken over lines or list items put together again, thousands
    grouped; a stand-in if there is none."""
    items = F.filter(F.col("supporting_evidence"), lambda e: e.isNotNull())
    repaired = tx.merge_split_evidence(F.transform(items, lambda e: tx.escape_currency(tx.join_split_amounts(e))))
    return F.when(F.size(items) > 0, repaired).otherwise(F.array(F.lit(NO_EVIDENCE)))


def report_sections(explained: DataFrame) -> DataFrame:
    """One markdown section per anomaly (as a single text column), from the
    output of ``explain_anomalies``."""
    j = explained
    mark = F.when(F.col("severity") == "high", F.lit(SEVERITY_MARK["high"])).when(
        F.col("severity") == "medium", F.lit(SEVERITY_MARK["medium"])).otherwise(F.lit(SEVERITY_MARK["low"]))
    arrow = F.when(F.col("direction") == "increase", F.lit("up")).otherwise(F.lit("down"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), mark, F.lit(" "), F.col("gl_account_id"), F.lit(" - "), F.coalesce(F.col("account_name"), F.lit(""))),
        F.concat(F.lit("**Change:** "), arrow, F.lit(" "), signed_pct(F.col("variance_percent")), F.lit(" ("),
                 signed_money(F.col("variance_amount")), F.lit(")")),
        F.concat(F.lit("**Balance:** "), money(F.col("previous_balance")), F.lit(" -> "), money(F.col("current_balance"))),
        F.concat(F.lit("**Assessment:** "), F.when(F.col("is_expected_variance"), F.lit("expected variance"))
                 .otherwise(F.lit("anomalous")), F.lit(", confidence "), F.format_string("%.0f%%", F.col("confidence") * 100)),
        F.concat(F.lit("**Root cause:** "), F.col("root_cause")),
        F.concat(F.lit("**Detailed reasoning:**\n"), F.col("chain_of_thought")),
        F.lit("**Evidence:**"),
        F.array_join(F.transform(_evidence(), lambda e: F.concat(F.lit("- "), e)), "\n"),
        F.concat(F.lit("**Recommendation:** "), F.col("recommendation")),
        F.when(F.col("requires_immediate_attention"), F.lit("**Needs immediate attention**")),
    )
    return j.select("anomaly_id", "gl_account_id", "month", "severity", "variance_percent", text.alias("section_text"))


RECOMMENDATIONS = [
    "Investigate high-severity items first.",
    "Review medium-severity items within 48 hours.",
    "Keep monitoring low-severity items.",
]


def report_lines(sections: DataFrame, month: str | Column, n_medium: int = 3) -> DataFrame:
    """Report of one month as (section, line_no, text): header and counts,
    every high section in rank order, the first ``n_medium`` medium ones
    (with a note when more exist), then the static recommendations.

    The month's counts are one aggregate row joined back (broadcast: one row
    per month); ranks per severity are numbered from a global sort
    (``operators.ranking``); each row emits its own line plus, on one
    designated row, the header, note and closing lines (``explode``).
    """
    from .ranking import row_number_in_groups
    m = F.to_date(F.lit(f"{month}-01")) if isinstance(month, str) else month
    s = sections.filter(F.col("month") == m)
    order = [F.abs(F.col("variance_percent")).desc(), F.col("gl_account_id")]
    # month counts: one aggregate row (joined back, so no whole-month window)
    counts = s.groupBy("month").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity") == "high").alias("_h"),
        F.count_if(F.col("severity") == "medium").alias("_md"), F.min("severity").alias("_first_sev"))
    # ranks per severity from the global sort (a big severity group is not one task)
    s = row_number_in_groups(s, ["severity"], order, name="_rk").join(F.broadcast(counts), "month")
    s = s.withColumn("_pos", F.when((F.col("severity") == F.col("_first_sev")) & (F.col("_rk") == 1), F.lit(1)))
    first = F.col("_pos") == 1
    shown = (F.col("severity") == "high") | ((F.col("severity") == "medium") & (F.col("_rk") <= n_medium))
    label = F.date_format(m, "yyyy-MM")

    def line(section, line_no, text):
        return F.struct(F.lit(section).alias("section"), line_no.cast("int").alias("line_no"), text.alias("text"))

    header = F.concat(F.lit("# Variance report "), label, F.lit("\n\n"), F.col("_n").cast("string"), F.lit(" anomalies: "),
                      F.col("_h").cast("string"), F.lit(" high, "), F.col("_md").cast("string"), F.lit(" medium"))
    note = F.concat(F.lit(f"(showing top {n_medium} of "), F.col("_md").cast("string"), F.lit(" medium items)"))
    recs = F.lit("## Recommendations\n" + "\n".join(f"- {r}" for r in RECOMMENDATIONS))
    lines = F.array(
        F.when(first, line(0, F.lit(0), header)),
        F.when(shown, F.struct(F.when(F.col("severity") == "high", F.lit(1)).otherwise(F.lit(2)).alias("section"),
                               F.col("_rk").cast("int").alias("line_no"), F.col("section_text").alias("text"))),
        F.when(first & (F.col("_md") > n_medium), line(2, F.lit(10 ** 6), note)),
        F.when(first, line(3, F.lit(0), recs)),
    )
    return (s.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
            .select("l.section", "l.line_no", "l.text"))


def report_summary(flags: DataFrame, accounts: DataFrame, month: str) -> DataFrame:
    """One row: counts of the month's report."""
    m = F.to_date(F.lit(f"{month}-01"))
    f = flags.filter(F.col("month") == m)
    n_acc = accounts.agg(F.count(F.lit(1))).scalar()
    return f.agg(
        F.count(F.lit(1)).alias("anomalies_detected"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
        F.count_if(F.col("severity") == "medium").alias("medium_severity_count"),
        F.count_if(F.col("severity") == "low").alias("low_severity_count"),
    ).withColumn("accounts_analyzed", n_acc).withColumn("target_month", F.lit(month))

