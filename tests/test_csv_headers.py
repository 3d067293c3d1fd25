"""CSV files by their own headers, broken lines, and quarantine that keeps all rows."""

import datetime as dt

import pytest

from ledgerlens.operators import validate as va
from ledgerlens.plans import store as st
from ledgerlens.plans.analysis import run_analysis
from ledgerlens.sources import files as fs

HEAD = "transaction_id,gl_account_id,date,amount,description,department,vendor"


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def test_columns_are_found_by_name(spark, tmp_path):
    d = tmp_path / "land [1]"
    put(d, "pl_1.csv", HEAD, "007,4000,2024-01-01,10.5,rent,ops,acme")
    put(d, "pl_2.csv", '﻿"date", transaction_id,amount,cost_center,gl_account_id,description', "2024-01-02,8,-3,c9,4001,\"a, \"\"b\"\"\"")
    put(d, "pl_3.csv", "", "description,amount,date,gl_account_id,transaction_id,vendor", "x,1,2024-01-03,4002,9,v")
    put(d, "pl_4.csv", "")
    raw = fs.scan_ledger_months(spark, str(d).replace("[", "\\[").replace("]", "\\]"))
    rows = {r.transaction_id: r for r in va.project_ledger(raw).collect()}
    assert set(rows) == {"007", "8", "9"}
    assert (rows["007"].gl_account_id, str(rows["007"].amount), rows["007"].vendor) == ("4000", "10.50", "acme")
    assert (rows["8"].description, rows["8"].department, rows["8"].vendor, rows["8"].transaction_date) == ('a, "b"', None, None, dt.date(2024, 1, 2))
    assert (rows["9"].vendor, rows["9"].department, rows["9"].source_file) == ("v", None, "pl_3.csv")


def test_lines_that_do_not_fit_are_never_swallowed(spark, tmp_path):
    d = put(tmp_path / "bad", "pl_1.csv", HEAD, "1,4000,2024-01-01,10,rent,ops,acme", "2,4000,2024-01-02,10,rent, big,ops,acme",
            "3,4000,2024-01-03,10,rent", "4,4000,2024-01-04,0,rent,ops,acme")
    raw = fs.scan_ledger_months(spark, d)
    with pytest.raises(Exception, match="malformed_line"):
        va.project_ledger(raw.where("transaction_id <> '4'")).collect()
    # pruning columns does not hide them
    assert len(raw.select("vendor", "bad_line").where("bad_line IS NOT NULL").collect()) == 2
    good, bad = va.project_ledger(raw, mode="quarantine")
    assert [r.transaction_id for r in good.collect()] == ["1"]
    assert {r.transaction_id: (r.bad_line, r.broken_rules) for r in bad.collect()} == {
        "2": ("2,4000,2024-01-02,10,rent, big,ops,acme", ["malformed_line"]), "3": ("3,4000,2024-01-03,10,rent", ["malformed_line"]),
        "4": (None, ["zero_amount"])}
    report = va.quality_report(raw).first()
    assert (report["rows"], report.malformed_line, report.zero_amount) == (4, 2, 1)


def test_missing_and_repeated_columns_raise(spark, tmp_path):
    d = put(tmp_path / "lack", "pl_1.csv", HEAD, "1,4000,2024-01-01,10,rent,ops,acme")
    put(tmp_path / "lack", "pl_2.csv", "transaction_id,gl_account_id,date,total,description", "1,4000,2024-01-01,10,rent")
    with pytest.raises(ValueError, match=r"Missing required columns in ledger data: \['amount'\].*pl_2.csv"):
        fs.scan_ledger_months(spark, d)
    report = {r.source_file: (r.missing, r.surplus) for r in fs.header_report(spark, d).collect()}
    assert report == {"pl_1.csv": ([], []), "pl_2.csv": (["amount"], ["total"])}
    twice = put(tmp_path / "twice", "pl_1.csv", HEAD + ",amount", "1,4000,2024-01-01,10,rent,ops,acme,11")
    with pytest.raises(ValueError, match="Repeated columns"):
        fs.scan_ledger_months(spark, twice)


def test_a_given_header_is_compared_with_every_file(spark, tmp_path):
    d = put(tmp_path / "one", "pl_1.csv", HEAD, "1,4000,2024-01-01,10,rent,ops,acme")
    names = HEAD.split(",")
    assert fs.scan_ledger_months(spark, d, header=names).count() == 1
    put(tmp_path / "one", "pl_2.csv", "date,transaction_id,gl_account_id,amount,description,department,vendor", "2024-01-01,2,4000,10,rent,ops,acme")
    with pytest.raises(Exception, match="CSV header does not conform"):
        fs.scan_ledger_months(spark, d, header=names).collect()
    with pytest.raises(ValueError, match="Missing required columns"):
        fs.scan_ledger_months(spark, d, header=names[1:])


def test_account_file_with_only_its_required_columns(spark, tmp_path):
    d = put(tmp_path / "acc", "a.csv", "account_name,category,account_id", "Rent,Expense,4000", "Sales,income,4001")
    raw = fs.scan_accounts(spark, d)
    good, bad = va.project_accounts(raw, mode="quarantine")
    r = good.first()
    assert (r.account_id, r.account_name, r.category, r.variance_threshold_pct, r.is_seasonal) == ("4000", "Rent", "expense", 15.0, False)
    assert [(x.account_id, x.broken_rules) for x in bad.collect()] == [("4001", ["bad_category"])]
    # frames without the optional columns work as well
    narrow = raw.select("account_id", "account_name", "category").where("account_id = '4000'")
    assert va.project_accounts(narrow).first().variance_threshold_pct == 15.0
    assert va.quality_report(narrow, "accounts").first().bad_category == 0


def test_quarantine_keeps_and_counts_every_row(spark, tmp_path):
    lines = [f"t{k},4000,2024-0{1 + k % 3}-05,{100 + 500 * (k % 3)},rent,ops,acme" for k in range(9)]
    d = put(tmp_path / "land", "pl_1.csv", HEAD, *lines, "b1,4000,2024-01-01,abc,rent,ops,acme", ",4000,2024-13-01,5,rent,ops,acme", "b3,4000")
    acc = put(tmp_path / "acc", "a.csv", "account_id,account_name,category", "4000,Rent,expense", "4001,Odd,other")
    base = str(tmp_path / "base")
    made = run_analysis(spark, fs.scan_ledger_months(spark, d), fs.scan_accounts(spark, acc), base, mode="quarantine", run_id="r1")
    assert made.rejected["ledger"] | {} == {"rows": 12, "bad_rows": 3, "malformed_line": 1, "null_account": 0, "null_amount": 1,
                                            "non_numeric_amount": 1, "bad_date": 2, "zero_amount": 0, "null_transaction_id": 1}
    assert made.rejected["accounts"]["bad_rows"] == 1
    assert spark.read.parquet(f"{base}/ledger").count() == 9
    bad = st.stored_rows(spark, f"{base}/ingest/ledger", "bad")
    assert sorted(r.amount or "" for r in bad.collect()) == ["", "5", "abc"]
    # the same run again replaces its rows; another one adds
    raw = fs.scan_ledger_months(spark, d)
    st.store_classified(raw, f"{base}/ingest/ledger", "r1")
    assert st.stored_rows(spark, f"{base}/ingest/ledger", "bad").count() == 3
    st.store_classified(raw, f"{base}/ingest/ledger", "r2")
    assert st.stored_rows(spark, f"{base}/ingest/ledger", "bad").count() == 6
    assert st.stored_rows(spark, f"{base}/ingest/ledger", "good", "r2").count() == 9
    assert {r.name: r.n for r in spark.read.parquet(f"{base}/ingest/ledger/counts").where("ingest_id = 'r2'").collect()} == made.rejected["ledger"]


def test_one_scan_of_the_source(spark, tmp_path):
    d = put(tmp_path / "src", "pl_1.csv", HEAD, "1,4000,2024-01-01,10,rent,ops,acme")
    plan = va.classify(fs.scan_ledger_months(spark, d))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan csv") == 1
