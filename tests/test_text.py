"""Regex tables for masking and text repair."""

from pyspark.sql import functions as F

from ledgerlens.functions import text as tx


def _apply(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r["o"] for r in df.select(fn(F.col("s")).alias("o")).collect()]


def test_mask_sensitive(spark):
    key = "sk-" + "A1b2" * 12
    got = _apply(spark, tx.mask_sensitive, [
        f"key {key} end", "Authorization: Bearer abc.DEF-123_x", "card 4111 1111 1111 1111 ok",
        "card 4111-1111-1111-1111", "ssn 123-45-6789.", "nothing here", "12345678901234567"])
    assert got == ["key sk-*** end", "Authorization: Bearer ***", "card ****-****-****-**** ok",
                   "card ****-****-****-****", "ssn ***-**-****.", "nothing here", "12345678901234567"]


def test_mask_hits(spark):
    df = spark.createDataFrame([("123-45-6789 and 987-65-4321, card 4111111111111111",)], "s string")
    h = df.select(*[v.alias(k) for k, v in tx.mask_hits(F.col("s")).items()]).collect()[0]
    assert (h["ssn"], h["card"], h["api_key"], h["bearer"]) == (2, 1, 0, 0)


def test_normalize_spacing(spark):
    got = _apply(spark, tx.normalize_spacing, [
        "The balance of $8,500.00is wellabovethe typicalrange",
        "Revenue in Q4 was 3rd highest",
        "camelCaseText  with   spaces ",
        "rose 15 % to $ 100",
        "isalsowellabovethe limit"])
    assert got == ["The balance of $8,500.00 is well above the typical range",
                   "Revenue in Q 4 was 3 rd highest",
                   "camel Case Text with spaces",
                   "rose 15% to $100",
                   "is also well above the limit"]


def test_escape_currency(spark):
    assert _apply(spark, tx.escape_currency, ["$5", "\\$5", "a $1 and $2"]) == ["\\$5", "\\$5", "a \\$1 and \\$2"]


def test_join_split_amounts(spark):
    got = _apply(spark, tx.join_split_amounts, ["cost 35\n000.00 total", "cost 35\n 000\n 00", "no 12\nabc"])
    assert got == ["cost 35,000.00 total", "cost 35,000.00", "no 12\nabc"]


def test_merge_split_evidence(spark):
    df = spark.createDataFrame([(["Paid \\$15", "-000.00", "Other item"],), (["Rent \\$", "1234567.50"],),
                                (["a", "b"],)], "e array<string>")
    got = [r["m"] for r in df.select(tx.merge_split_evidence(F.col("e")).alias("m")).collect()]
    assert got == [["Paid \\$15,000.00", "Other item"], ["Rent \\$1,234,567.50"], ["a", "b"]]


def test_parse_sections(spark):
    text = ("**Root Cause**: Big deal signed\n**Chain of Thought**: It rose\nsharply\n"
            "**Recommendation**: Check it\n**Supporting Evidence**: Up $1,000.00 vs plan, new client, none")
    df = spark.createDataFrame([(text,), ("plain text",)], "s string")
    rows = df.select(tx.parse_sections(F.col("s")).alias("p")).collect()
    p = rows[0]["p"]
    assert p["root_cause"] == "Big deal signed"
    assert p["chain_of_thought"] == "It rose\nsharply"
    assert p["recommendation"] == "Check it"
    assert p["supporting_evidence"] == ["Up \\$1,000.00 vs plan", "new client", "none"]
    assert rows[1]["p"]["root_cause"] is None and rows[1]["p"]["supporting_evidence"] == []


def test_slug_preview_tokens(spark):
    df = spark.createDataFrame([("Travel & Entertainment", "x" * 250)], "n string, t string")
    r = df.select(tx.slug(F.col("n")).alias("s"), tx.slug(F.col("n"), and_sign=False).alias("s2"),
                  tx.preview(F.col("t")).alias("p"), tx.token_estimate(F.col("t")).alias("k")).collect()[0]
    assert r["s"] == "travel_and_entertainment" and r["s2"] == "travel_&_entertainment"
    assert len(r["p"]) == 100 and r["k"] == 62


def test_report_sections_repair_their_evidence(spark):
    from ledgerlens.operators import report as rp
    schema = ("anomaly_id string, gl_account_id string, account_name string, month date, severity string, direction string, variance_percent double, "
              "variance_amount double, previous_balance double, current_balance double, is_expected_variance boolean, confidence double, "
              "root_cause string, chain_of_thought string, supporting_evidence array<string>, recommendation string, requires_immediate_attention boolean")

    def section(evidence):
        row = ("a", "1", "Rent", None, "high", "increase", 40.0, 10.0, 1.0, 2.0, False, 0.5, "r", "c", evidence, "x", False)
        text = rp.report_sections(spark.createDataFrame([row], schema)).first().section_text
        return text.split("**Evidence:**\n")[1].split("\n**Recommendation")[0].split("\n")
    assert section(["paid $", "15000.00", "was $500"]) == ["- paid \\$15,000.00", "- was \\$500"]
    assert section(["balance $1234567.50", None]) == ["- balance \\$1,234,567.50"]
    assert section([]) == section(None) == ["- Analysis based on variance data and GL documentation"]
