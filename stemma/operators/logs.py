"""Call and request logs: statistics, spend, limits; the same sums over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import Scratch

#: Dollars per call and requests per minute (fixed values).
COSTS = {"voyage_embed": 0.000002, "anthropic_parse": 0.0005, "gemini_parse": 0.00015, "groq_parse": 0.0}
LIMITS = {"search": 10, "reader": 30, "default": 60, "health": 300}
CALL_SCHEMA = "event string, ts timestamp, provider string, model string, call_type string, latency_ms double, ok boolean, error string"
SEARCH_SCHEMA = "event string, ts timestamp, path string, total_ms double, embed_ms double, parse_ms double, results int"


def read_log(df: DataFrame, kind: str, schema: str) -> DataFrame:
    """The lines (value) of one kind of event as typed rows; lines of other kinds or broken ones drop. Works on streams."""
    return df.select(F.from_json("value", schema).alias("r")).where(F.col("r.event") == kind).select("r.*")


def read_call_log(df: DataFrame) -> DataFrame:
    return read_log(df, "api_call", CALL_SCHEMA)


def read_search_log(df: DataFrame) -> DataFrame:
    return read_log(df, "search", SEARCH_SCHEMA)


def call_stats(log: DataFrame, keys: tuple[str, ...] = ("call_type",), exact: bool = False) -> DataFrame:
    """Calls, error rate and latency percentiles, from a sketch of bounded size unless ``exact``."""
    percentile = F.percentile if exact else F.percentile_approx
    return log.groupBy(*keys).agg(F.count("*").alias("calls"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 6).alias("error_rate"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), *(F.round(percentile("latency_ms", F.lit(p / 100)), 6).alias(f"p{p}_ms") for p in (50, 95)))


def search_stats(log: DataFrame, exact: bool = False) -> DataFrame:
    """Searches by path: how many, mean results, latency percentiles and the mean of each phase; a phase that a path skips is null.

    Percentiles are from a sketch of bounded size unless ``exact``.
    """
    percentile = F.percentile if exact else F.percentile_approx
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("results", "total_ms", "embed_ms", "parse_ms")]
    return log.groupBy("path").agg(F.count("*").alias("searches"), *means, *(F.round(percentile("total_ms", F.lit(p / 100)), 6).alias(f"p{p}_ms") for p in (50, 95)))


def cost_of(log: DataFrame, costs: dict[str, float]) -> DataFrame:
    table = log.sparkSession.createDataFrame(list(costs.items()), "call_type string, cost double")
    return log.join(F.broadcast(table), "call_type", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def monthly_spend(log: DataFrame, costs: dict[str, float] = COSTS, limit: float = 10.0) -> DataFrame:
    """Spend per month and call type, with the month's total and whether it has used its limit up."""
    month = F.date_trunc("MONTH", "ts")
    sums = cost_of(log, costs).groupBy(month.alias("month"), "call_type").agg(F.round(F.sum("cost"), 8).alias("spent"), F.count("*").alias("calls"))
    total = F.round(F.sum("spent").over(Window.partitionBy("month")), 8)
    return sums.withColumn("month_spent", total).withColumn("exhausted", F.col("month_spent") >= limit)


def budget_gate(log: DataFrame, costs: dict[str, float], limit: float) -> DataFrame:
    """Adds allowed: whether the spend of the month before a call was under the limit.

    Calls are dealt into ranges of time that hold about as many calls each, and running sums are taken over the ranges and then
    inside each, so that no task holds a busy day.
    """
    spark = log.sparkSession
    priced = cost_of(log, costs).withColumn("month", F.date_trunc("MONTH", "ts"))
    ranges = priced.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ts", "event_id")
    dealt = Scratch(spark).cut(ranges.withColumn("part", F.spark_partition_id()))  # written, as ranges are sampled anew each time
    parts = dealt.groupBy("month", "part").agg(F.sum("cost").alias("spent"))
    before = parts.withColumn("before", F.coalesce(F.sum("spent").over(Window.partitionBy("month").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("spent")
    inner = Window.partitionBy("month", "part").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(before, ["month", "part"]).withColumn("prior", F.round(F.col("before") + F.coalesce(F.sum("cost").over(inner), F.lit(0.0)), 8))
    return summed.withColumn("allowed", F.col("prior") < limit).drop("before", "part", "month")


def over_limit(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Per client, endpoint and minute with more requests than allowed, how many; works on a stream under a watermark."""
    table = requests.sparkSession.createDataFrame(list(limits.items()), "endpoint string, allowed int")
    counted = requests.groupBy("client", "endpoint", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(table), "endpoint").where("n > allowed").select("client", "endpoint", F.col("w.start").alias("minute"), "n", (F.col("n") - F.col("allowed")).alias("over"))
