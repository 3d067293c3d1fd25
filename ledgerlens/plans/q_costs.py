"""Registered queries: call costs, cost roll-ups, call rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs as co
from . import adapters as ad
from . import oracle as o
from .catalog import register

_prices = ",\n".join(f"('{m}', CAST({i} AS DECIMAL(20,11)) / 1000000, CAST({p} AS DECIMAL(20,11)) / 1000000)"
                     for m, i, p in co.PRICES_PER_MILLION)

PRICED = f"""
prices AS (SELECT model, CAST(ip AS DECIMAL(20,11)) AS input_price, CAST(op AS DECIMAL(20,11)) AS output_price
           FROM (VALUES {_prices}) t(model, ip, op)),
priced AS (
  SELECT c.run_id, c.ts, c.model, c.agent, c.caller_id, c.input_tokens, c.output_tokens, c.call_duration,
         substr(coalesce(c.query_preview, ''), 1, 100) AS query_preview,
         CAST(c.input_tokens AS DECIMAL(16,0)) * coalesce(p.input_price, d.input_price) AS in_exact,
         CAST(c.output_tokens AS DECIMAL(16,0)) * coalesce(p.output_price, d.output_price) AS out_exact
  FROM call_log c LEFT JOIN prices p ON c.model = p.model
  CROSS JOIN (SELECT * FROM prices WHERE model = 'gpt-4') d
),
priced2 AS (SELECT * EXCLUDE (in_exact, out_exact),
                   CAST(CAST(in_exact AS DECIMAL(38,11)) AS DOUBLE) AS input_cost,
                   CAST(CAST(out_exact AS DECIMAL(38,11)) AS DOUBLE) AS output_cost,
                   CAST(in_exact + out_exact AS DECIMAL(38,11)) AS cost_exact,
                   CAST(CAST(in_exact + out_exact AS DECIMAL(38,11)) AS DOUBLE) AS total_cost FROM priced)"""

BASE = o.with_(o.CALL_LOG, PRICED)


def priced(spark, sf):
    return co.price_calls(ad.call_log_from_events(spark, sf), co.price_list(spark))


@register("price_calls", BASE + "SELECT * EXCLUDE (cost_exact) FROM priced2")
def price_calls(spark, sf):
    return priced(spark, sf).drop("cost_exact")


@register("cost_summary", BASE + """
SELECT run_id, count(*) AS total_calls, sum(input_tokens)::BIGINT AS total_input_tokens,
       sum(output_tokens)::BIGINT AS total_output_tokens, CAST(CAST(sum(cost_exact) AS DECIMAL(38,11)) AS DOUBLE) AS total_cost,
       min(ts) AS start_time, max(ts) AS end_time,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_duration
FROM priced2 GROUP BY run_id""")
def cost_summary(spark, sf):
    return co.cost_summary(priced(spark, sf))


@register("cost_by_agent", BASE + """,
per AS (SELECT run_id, agent, CAST(sum(cost_exact) AS DECIMAL(38,11)) AS ex, count(*) AS calls
        FROM priced2 GROUP BY run_id, agent)
SELECT run_id, agent, CAST(ex AS DOUBLE) AS agent_cost, calls,
       CASE WHEN sum(ex) OVER (PARTITION BY run_id) = 0 THEN 0.0
            ELSE CAST(ex AS DOUBLE) / CAST(sum(ex) OVER (PARTITION BY run_id) AS DOUBLE) END AS share
FROM per""")
def cost_by_agent(spark, sf):
    return co.cost_by_agent(priced(spark, sf))


@register("cost_per_anomaly", BASE + """,
s AS (SELECT run_id, CAST(CAST(sum(cost_exact) AS DECIMAL(38,11)) AS DOUBLE) AS total_cost FROM priced2 GROUP BY run_id),
a AS (SELECT run_id, count(*) AS anomalies FROM priced2 WHERE agent = 'error' GROUP BY run_id)
SELECT s.run_id, s.total_cost, coalesce(a.anomalies, 0) AS anomalies,
       CASE WHEN coalesce(a.anomalies, 0) = 0 THEN 0.0
            ELSE s.total_cost / coalesce(a.anomalies, 0) END AS cost_per_anomaly
FROM s LEFT JOIN a ON s.run_id = a.run_id""")
def cost_per_anomaly(spark, sf):
    """Error events stand for the anomalies explained in a run."""
    p = priced(spark, sf)
    counts = p.filter(F.col("agent") == "error").groupBy("run_id").agg(F.count(F.lit(1)).alias("anomalies"))
    return co.cost_per_anomaly(co.cost_summary(p), counts)


@register("call_rate_stats", o.with_(o.CALL_LOG) + """
SELECT run_id, ts, caller_id, agent,
       count(*) OVER (PARTITION BY caller_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls_last_minute,
       count(*) OVER (PARTITION BY caller_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS calls_last_hour
FROM call_log""")
def call_rate_stats(spark, sf):
    c = ad.call_log_from_events(spark, sf).select("run_id", "ts", "caller_id", "agent")
    return co.call_rate_stats(c).select("run_id", "ts", "caller_id", "agent",
                                        "calls_last_minute", "calls_last_hour")


@register("call_rate_stats_by_agent", o.with_(o.CALL_LOG) + """
SELECT ts, agent, caller_id,
       count(*) OVER (PARTITION BY agent ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls_last_minute,
       count(*) OVER (PARTITION BY agent ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS calls_last_hour
FROM call_log""")
def call_rate_stats_by_agent(spark, sf):
    """Keyed by agent: five keys, each holding about a fifth of all calls (the hot-key case)."""
    c = ad.call_log_from_events(spark, sf).select("ts", "agent", "caller_id")
    return co.call_rate_stats(c, key="agent").select("ts", "agent", "caller_id",
                                                     "calls_last_minute", "calls_last_hour")


def limiter_sql(per_minute: int, per_hour: int) -> str:
    """The limiter replay as a recursive CTE: per agent, call n+1 is decided
    from the admitted call times of the last hour carried as a list."""
    keep = "list_filter(r.state, lambda a: a >= c.us - 3600000000)"
    ok = (f"(len(list_filter(r.state, lambda a: a >= c.us - 60000000)) < {per_minute}"
          f" AND len({keep}) < {per_hour})")
    return o.with_(o.CALL_LOG) + f""",
c AS (SELECT agent, ts, epoch_us(ts) AS us,
             row_number() OVER (PARTITION BY agent ORDER BY epoch_us(ts), ts) AS rn FROM call_log),
r AS (
  SELECT agent, rn, ts, TRUE AS admitted, [us] AS state FROM c WHERE rn = 1
  UNION ALL
  SELECT c.agent, c.rn, c.ts, {ok},
         CASE WHEN {ok} THEN list_append({keep}, c.us) ELSE {keep} END
  FROM r JOIN c ON c.agent = r.agent AND c.rn = r.rn + 1
)
SELECT ts, agent, admitted FROM r"""


@register("admit_calls", "WITH RECURSIVE" + limiter_sql(2, 4)[len("WITH"):])
def admit_calls(spark, sf):
    """Rate-limiter replay per agent with tight limits (2 a minute, 4 an
    hour) so that rejections happen on the test data.  The SQL twin is a
    recursive CTE carrying the admitted times of the last hour."""
    c = ad.call_log_from_events(spark, sf).select("ts", "agent")
    return co.admit_calls(c, key="agent", per_minute=2, per_hour=4)


@register("sink_cost_json", BASE + """
SELECT run_id, count(*) AS total_calls, printf('%.8f', CAST(round(CAST(CAST(CAST(sum(cost_exact) AS DECIMAL(38,11)) AS DOUBLE) AS DECIMAL(38,11)), 8) AS DOUBLE)) AS total_cost
FROM priced2 GROUP BY run_id""")
def sink_cost_json(spark, sf):
    """Cost summary written as JSON lines (money as 8-decimal text) and read back."""
    from ..session import scratch_path
    from ..sources import files as fs
    s = co.cost_summary(priced(spark, sf)).select("run_id", "total_calls", "total_cost")
    path = scratch_path(spark, "cost_json")
    fs.sink_cost_json(s, path)
    return spark.read.schema("run_id string, total_calls long, total_cost string").json(f"{path}/summary")


@register("cost_report", BASE + """,
per AS (SELECT run_id, agent, CAST(sum(cost_exact) AS DECIMAL(38,11)) AS c FROM priced2 GROUP BY run_id, agent),
br AS (SELECT run_id, to_json(list({'agent': agent, 'cost': printf('%.8f', CAST(round(c, 8) AS DOUBLE))} ORDER BY agent))
              AS cost_breakdown FROM per GROUP BY run_id)
SELECT s.run_id, count(*) AS total_calls, sum(input_tokens)::BIGINT AS total_input_tokens,
       sum(output_tokens)::BIGINT AS total_output_tokens,
       printf('%.8f', CAST(round(CAST(CAST(CAST(sum(cost_exact) AS DECIMAL(38,11)) AS DOUBLE) AS DECIMAL(38,11)), 8) AS DOUBLE)) AS total_cost,
       min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_duration,
       any_value(br.cost_breakdown) AS cost_breakdown
FROM priced2 s JOIN br ON s.run_id = br.run_id GROUP BY s.run_id""")
def cost_report(spark, sf):
    """Run summary with the per-agent breakdown, as the JSON report holds it."""
    return co.cost_report(priced(spark, sf))
