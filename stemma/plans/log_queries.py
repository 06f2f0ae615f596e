"""Queries of the log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import logs as L
from stemma.plans.registry import query
from stemma.sources.bindings import bind

COST_SQL = "CASE call_type WHEN 'voyage_embed' THEN 0.000002 WHEN 'anthropic_parse' THEN 0.0005 WHEN 'gemini_parse' THEN 0.00015 ELSE 0.0 END"
RATE_LIMITS = {"search": 0, "reader": 0, "default": 1, "health": 1}


@query("logs", "SELECT call_type, count(*) AS calls, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM logs GROUP BY call_type")
def call_stats(spark, d):
    return L.call_stats(bind(spark, d, "logs"), exact=True)


@query("logs", "SELECT provider, model, count(*) AS calls, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM (SELECT *, split_part(call_type, '_', 1) AS provider, split_part(call_type, '_', 1) || '-' || (event_id % 2) AS model FROM logs) GROUP BY provider, model")
def call_stats_by_model(spark, d):
    """From the lines of a log, as they are written."""
    calls = bind(spark, d, "logs").selectExpr("'api_call' AS event", "ts", "split_part(call_type, '_', 1) AS provider", "concat(split_part(call_type, '_', 1), '-', event_id % 2) AS model", "call_type", "latency_ms", "ok")
    return L.call_stats(L.read_call_log(calls.select(F.to_json(F.struct("*")).alias("value"))), ("provider", "model"), exact=True)


@query("logs", "SELECT endpoint, count(*) AS calls, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM logs GROUP BY endpoint")
def search_stats(spark, d):
    return L.call_stats(bind(spark, d, "logs"), ("endpoint",), exact=True)


PATHS = "CASE event_id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'reference' WHEN 2 THEN 'author_only' ELSE 'lexical' END"


@query("logs", f"""SELECT path, count(*) AS searches, round(avg(results), 6) AS avg_results, round(avg(total), 6) AS avg_total_ms, round(avg(embed), 6) AS avg_embed_ms, round(avg(parse), 6) AS avg_parse_ms, round(quantile_cont(total, 0.5), 6) AS p50_ms, round(quantile_cont(total, 0.95), 6) AS p95_ms
FROM (SELECT {PATHS} AS path, event_id % 30 AS results, latency_ms AS total, CASE WHEN event_id % 4 IN (0, 3) THEN latency_ms / 4 END AS embed, CASE WHEN event_id % 4 <> 1 THEN latency_ms / 8 END AS parse FROM logs) GROUP BY path""")
def search_paths(spark, d):
    timed = bind(spark, d, "logs").select(F.lit("search").alias("event"), F.expr(PATHS).alias("path"), F.expr("int(event_id % 30)").alias("results"), F.col("latency_ms").alias("total_ms"), F.expr("case when event_id % 4 in (0, 3) then latency_ms / 4 end").alias("embed_ms"), F.expr("case when event_id % 4 <> 1 then latency_ms / 8 end").alias("parse_ms"))
    return L.search_stats(L.read_search_log(timed.select(F.to_json(F.struct("*")).alias("value"))), exact=True)


@query("logs", f"SELECT month, call_type, spent, calls, round(sum(spent) OVER (PARTITION BY month), 8) AS month_spent, round(sum(spent) OVER (PARTITION BY month), 8) >= 1.0 AS exhausted FROM (SELECT date_trunc('month', ts)::TIMESTAMP AS month, call_type, round(sum({COST_SQL}::DOUBLE), 8) AS spent, count(*) AS calls FROM logs GROUP BY ALL)")
def monthly_spend(spark, d):
    return L.monthly_spend(bind(spark, d, "logs"), limit=1.0)


@query("logs", f"SELECT event_id, round(coalesce(sum({COST_SQL}::DOUBLE) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 8) < 0.5 AS allowed FROM logs")
def budget_gate(spark, d):
    return L.budget_gate(bind(spark, d, "logs"), L.COSTS, 0.5).select("event_id", "allowed")


@query("logs", "SELECT client, endpoint, minute, n, n - allowed AS over FROM (SELECT client, endpoint, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM logs GROUP BY ALL) JOIN (VALUES ('search', 0), ('reader', 0), ('default', 1), ('health', 1)) l(endpoint, allowed) USING (endpoint) WHERE n > allowed")
def over_limit(spark, d):
    return L.over_limit(bind(spark, d, "logs"), RATE_LIMITS)


@query("logs", "SELECT ts::TIMESTAMP AS ts, call_type, latency_ms, ok FROM logs WHERE endpoint <> 'default'")
def call_log(spark, d):
    line = F.to_json(F.struct(F.when(F.col("endpoint") == "default", "search").otherwise("api_call").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "call_type", "latency_ms", "ok"))
    return L.read_call_log(bind(spark, d, "logs").select(line.alias("value"))).select("ts", "call_type", "latency_ms", "ok")


@query("logs", "SELECT ts::TIMESTAMP AS ts, 'hybrid' AS path, latency_ms AS total_ms FROM logs WHERE endpoint = 'search'")
def search_log(spark, d):
    line = F.to_json(F.struct(F.when(F.col("endpoint") == "search", "search").otherwise("api_call").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("hybrid").alias("path"), F.col("latency_ms").alias("total_ms")))
    return L.read_search_log(bind(spark, d, "logs").select(line.alias("value"))).select("ts", "path", "total_ms")
