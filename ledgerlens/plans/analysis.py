"""The whole monthly analysis as one chain of DataFrame functions.

ingest (validate + type) -> upsert accounts -> append ledger (first write
wins) -> refresh balances -> detect -> retrieve context -> explain -> report
-> store investigations, report and the run row.  Every stage is a DataFrame
plan; the writes are the stored tables under ``base`` (a shared folder on a
cluster).  The flags are stored once and read by all later stages.  A failed
stage raises; nothing later runs on half-written input.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costs as co
from ..operators import detect as det
from ..operators import docs as dc
from ..operators import history as hi
from ..operators import report as rp
from ..operators import validate as va
from ..sources import files as fs
from . import store as st


@dataclass
class AnalysisResult:
    run_id: str
    target_month: str
    flags: DataFrame
    context: DataFrame
    explanations: DataFrame
    report: DataFrame
    run: DataFrame
    #: by kind of file: rows read, bad rows and rows that break each rule (quarantine mode)
    rejected: dict[str, dict[str, int]] = field(default_factory=dict)


def run_analysis(spark: SparkSession, raw_ledger: DataFrame, raw_accounts: DataFrame, base: str,
                 target_month: str | None = None, threshold: float = 15.0,
                 docs: DataFrame | None = None, mode: str = "fail", id_scope: str = "global",
                 calls: DataFrame | None = None, run_id: str | None = None,
                 created_at: dt.datetime | None = None) -> AnalysisResult:
    """``calls`` is the run's model-call log; its priced total goes into the
    run row.  Each run has an id of its own, also a second one of the same
    month; a retry of the same run passes the same ``run_id``.

    ``mode="quarantine"`` keeps all rows of the batch under ``base``/ingest,
    the bad ones with the rules they break (``store.stored_rows``), and
    counts them in ``rejected``; ``mode="fail"`` ends at the first bad row."""
    created_at = created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rejected = {}
    if mode == "quarantine":
        # every row is stored once, good and bad apart; the run goes on with the good ones
        ingest_id = run_id or f"ingest-{uuid.uuid4().hex[:12]}"
        good = {}
        for kind, raw in (("ledger", raw_ledger), ("accounts", raw_accounts)):
            rejected[kind] = st.store_classified(raw, f"{base}/ingest/{kind}", ingest_id, kind)
            good[kind] = st.stored_rows(spark, f"{base}/ingest/{kind}", "good", ingest_id)
        ledger, batch = good["ledger"], good["accounts"]
    else:
        ledger, batch = va.project_ledger(raw_ledger, mode=mode), va.project_accounts(raw_accounts, mode=mode)
    st.store_accounts(batch, f"{base}/accounts", seq=int(created_at.timestamp() * 1_000_000))
    accounts = st.current_accounts(spark, f"{base}/accounts")
    ledger_path, bal_path, inv_path = f"{base}/ledger", f"{base}/balances", f"{base}/investigations"
    st.append_ledger(spark, ledger, ledger_path, id_scope=id_scope)
    stored = spark.read.parquet(ledger_path)      # keeps the month partition column (pruning)
    if target_month is None:
        # one scalar: the newest month of the batch
        target_month = ledger.agg(F.date_format(F.max("transaction_date"), "yyyy-MM")).first()[0]
    run_id = run_id or f"run-{target_month}-{uuid.uuid4().hex[:8]}"
    enriched = st.refresh_balances(spark, stored, bal_path,
                                   target_month=target_month if st.table_exists(spark, bal_path) else None)
    history = spark.read.parquet(inv_path) if st.table_exists(spark, inv_path) else None
    flags_path = f"{base}/flags/{run_id}"
    det.detect_anomalies(enriched, accounts, target_month=target_month, threshold=threshold,
                         history=history).write.mode("overwrite").parquet(flags_path)
    flags = spark.read.parquet(flags_path)
    chunks = dc.chunk_recursive(docs if docs is not None else dc.account_docs(accounts))
    chunks = chunks.withColumn("chunk_id", F.concat_ws(":", "source_file", F.col("chunk_no").cast("string")))
    hist_counts = hi.history_count(history) if history is not None else None
    context = dc.retrieve_context(flags, chunks, history_counts=hist_counts)
    explanations = rp.explain_anomalies(flags, accounts).join(
        context.select("anomaly_id", "account_documentation", "source_files"), "anomaly_id", "left")
    report = rp.report_lines(rp.report_sections(explanations), target_month)
    fs.sink_report(report, f"{base}/reports/{run_id}")
    inv = hi.investigations_from_flags(flags, run_id=F.lit(run_id), explanations=explanations.select(
        "anomaly_id", "root_cause", F.concat_ws(
            "; ", F.array_join("supporting_evidence", "; "),
            F.concat(F.lit("documentation: "), F.array_join(F.array_distinct("source_files"), ", "))).alias("llm_explanation"),
        F.col("confidence").alias("llm_confidence")))
    st.store_investigations(spark, inv, inv_path)
    cost = None
    if calls is not None:
        cost = co.price_calls(calls, co.price_list(spark)).agg(F.sum("cost_exact").cast(co.COST).cast("double")).scalar()
    run = st.run_rows(flags, accounts, created_at=created_at.isoformat(sep=" "), cost_usd=cost)
    st.store_run(run, f"{base}/runs")
    return AnalysisResult(run_id, target_month, flags, context, explanations, report, run, rejected)
