"""The logs as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.logs import COSTS, cost_of, over_limit


def spend_stream(calls: DataFrame, costs: dict[str, float] = COSTS, late: str = "1 day") -> DataFrame:
    """Spend per month and call type; for update mode (a month outlasts any watermark, and the state is months times types)."""
    return cost_of(calls.withWatermark("ts", late), costs).groupBy(F.date_trunc("MONTH", "ts").alias("month"), "call_type").agg(F.round(F.sum("cost"), 8).alias("spent"), F.count("*").alias("calls"))


def call_sketches(calls: DataFrame, width: str = "5 minutes", keys: tuple[str, ...] = ("call_type",)) -> DataFrame:
    """(start, keys, calls, errors, total_ms, sketch) per window and keys, for batches and streams: what statistics need, of bounded size, and can be merged."""
    w = calls.groupBy(F.window("ts", width).alias("w"), *keys)
    sums = w.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("latency_ms").alias("total_ms"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("sketch"))
    return sums.select(F.col("w.start").alias("start"), *keys, "calls", "errors", "total_ms", "sketch")


def merged_sketches(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of call_sketches, from any number of batches and windows, summed up by other keys; percentiles are of all calls, not of the windows' own."""
    sums = (F.sum(c).alias(c) for c in ("calls", "errors", "total_ms"))
    return sketches.groupBy(*keys).agg(*sums, F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_stats(sketches: DataFrame, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Sketches as calls, errors, mean and percentiles. A percentile's rank is off by 1.4 % of the calls at most, by far the most often."""
    rest = [c for c in sketches.columns if c not in ("total_ms", "sketch")]
    quantiles = (F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}_ms") for p in percents)
    return sketches.select(*rest, F.round(F.col("total_ms") / F.col("calls"), 6).alias("avg_ms"), *quantiles)


def call_stats_stream(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("call_type",)) -> DataFrame:
    """Calls, errors, mean latency and percentiles per window and keys; for append mode, late rows beyond the watermark drop."""
    return sketched_stats(call_sketches(calls.withWatermark("ts", late), width, keys))


def over_limit_stream(requests: DataFrame, limits: dict[str, int], late: str = "5 minutes") -> DataFrame:
    return over_limit(requests.withWatermark("ts", late), limits)
