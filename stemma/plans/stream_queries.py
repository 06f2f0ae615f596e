"""Queries that run the streaming jobs over the event table as it stands and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.etl import build_verse_index
from stemma.operators.search import build_index, terms
from stemma.plans.log_queries import COST_SQL, RATE_LIMITS
from stemma.plans.registry import query
from stemma.session import Scratch
from stemma.sources.bindings import BINDINGS, bind
from stemma.streaming import jobs
from stemma.streaming.mergelog import MergeLog
from stemma.streaming.mergelog import ingest_stream as start_ingest


def live_logs(spark: SparkSession, d: str) -> DataFrame:
    """The log binding over the events as a stream."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    return spark.sql(BINDINGS["logs"].replace("FROM events", "FROM {events}"), events=events.withColumn("ts", F.col("ts").cast("timestamp")))


def settled(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is; every batch replaces the rows of its keys in a table of the shared folder."""
    spark = stream.sparkSession
    scratch = Scratch(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{scratch.root}/out/{batch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out/*")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("m")).select(*keys, *(f"m.{c}" for c in rest))


@query("logs", f"SELECT date_trunc('month', ts)::TIMESTAMP AS month, call_type, round(sum({COST_SQL}::DOUBLE), 8) AS spent, count(*) AS calls FROM logs GROUP BY ALL")
def spend_stream(spark, d):
    return newest(settled(jobs.spend_stream(live_logs(spark, d)), "update"), ["month", "call_type"])


@query("logs", "SELECT client, endpoint, minute, n, n - allowed AS over FROM (SELECT client, endpoint, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM logs GROUP BY ALL) JOIN (VALUES ('search', 0), ('reader', 0), ('default', 1), ('health', 1)) l(endpoint, allowed) USING (endpoint) WHERE n > allowed")
def over_limit_stream(spark, d):
    return newest(settled(jobs.over_limit_stream(live_logs(spark, d), RATE_LIMITS), "update"), ["client", "endpoint", "minute"])


#: How far a percentile's rank may be off, as a share of a window's calls.
RANK_ERROR = 0.03
PROVIDED = "split_part(call_type, '_', 1) AS provider, split_part(call_type, '_', 1) || '-' || CAST(event_id % 2 AS {text}) AS model"


def provided(logs):
    """Calls with provider and model."""
    return logs.selectExpr("*", "split_part(call_type, '_', 1) AS provider", "concat(split_part(call_type, '_', 1), '-', cast(event_id % 2 as string)) AS model")


def within(stats: DataFrame, calls: DataFrame, keys: list[str], p: int) -> DataFrame:
    """keys, and whether a percentile's rank among the calls themselves is as near as RANK_ERROR, or one call."""
    at = calls.join(stats.select(*keys, f"p{p}_ms"), keys).groupBy(*keys).agg(F.count_if(F.col("latency_ms") < F.col(f"p{p}_ms")).alias("under"), F.count_if(F.col("latency_ms") <= F.col(f"p{p}_ms")).alias("upto"), F.count("*").alias("n"))
    off = F.greatest(F.lit(1.0), RANK_ERROR * F.col("n"))
    return at.select(*keys, ((F.col("under") - off <= p / 100 * F.col("n")) & (F.col("upto") + off >= p / 100 * F.col("n"))).alias(f"p{p}_held"))


def with_bounds(stats: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    for p in (50, 95):
        stats = stats.join(within(stats, calls, keys, p), keys)
    return stats.drop("p50_ms", "p95_ms")


@query("logs", f"SELECT * FROM (SELECT time_bucket(INTERVAL '5 minutes', ts)::TIMESTAMP AS start, provider, model, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, round(avg(latency_ms), 6) AS avg_ms, true AS p50_held, true AS p95_held FROM (SELECT *, {PROVIDED.format(text='VARCHAR')} FROM logs) GROUP BY 1, 2, 3) WHERE start + INTERVAL '15 minutes' <= (SELECT max(ts) FROM logs)")
def call_stats_stream(spark, d):
    keys = ["start", "provider", "model"]
    stats = settled(jobs.call_stats_stream(provided(live_logs(spark, d)), keys=("provider", "model")), "append").drop("_batch")
    return with_bounds(stats, provided(bind(spark, d, "logs")).withColumn("start", F.window("ts", "5 minutes").start), keys)


@query("logs", f"SELECT provider, model, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, round(avg(latency_ms), 6) AS avg_ms, true AS p50_held, true AS p95_held FROM (SELECT *, {PROVIDED.format(text='VARCHAR')} FROM logs) GROUP BY ALL")
def call_stats_merged(spark, d):
    """Statistics by provider and model from sketches of each six hours; that of many windows is as near as that of one."""
    calls = provided(bind(spark, d, "logs"))
    stats = jobs.sketched_stats(jobs.merged_sketches(jobs.call_sketches(calls, "6 hours", ("provider", "model")), ("provider", "model")))
    return with_bounds(stats, calls, ["provider", "model"])


BUCKETS, PARTS = 8, 3
#: Which passages are deleted for good: the sevenths of each work are deleted, and of every other work come back.
STAYS = "(id % 10 <> 7 OR (id // 1000) % 2 = 0)"


def ingest(spark: SparkSession, d: str) -> tuple[MergeLog, int]:
    """The verse passages as they arrive in four batches: all of them, every third with a wrong header; corrections, and deletions; late rows of
    older versions of both; and passages that come back. Gives the log and the last batch."""
    scratch = Scratch(spark)
    rows = scratch.cut(bind(spark, d, "verse_passages").select("id", "header"))
    wrong = F.expr("case when id % 3 = 0 then concat('Unread ', id) else header end")
    row = lambda version, header, where, deleted=False: rows.where(where).select("id", F.lit(version).alias("version"), F.lit(deleted).alias("deleted"), header.alias("header"))
    right, none = F.col("header"), F.lit(None).cast("string")
    arrivals = [
        row(2, wrong, "true").union(row(1, F.lit("John 1:1"), "id % 5 = 0")),
        row(3, right, "id % 3 = 0").union(row(5, none, "id % 10 = 7", True)),
        row(1, F.lit("Mark 9:9"), "id % 2 = 0").union(row(4, F.lit("Mark 9:9"), "id % 10 = 7")),
        row(6, right, "id % 10 = 7 and (id div 1000) % 2 = 0"),
    ]
    derive = {
        "verses": ("passage_id", build_verse_index),
        "postings": ("id", lambda p: build_index(p, ("header",)).postings),
        "pending": ("id", lambda p: p.select("id")),
    }
    log = MergeLog(spark, f"{scratch.root}/out", derive, BUCKETS, F.size(terms(F.col("header"))), PARTS)
    source = spark.readStream.schema("id long, version int, deleted boolean, header string").parquet(f"{scratch.root}/in/*")
    for no, arrival in enumerate(arrivals):
        arrival.write.parquet(f"{scratch.root}/in/{no}")
        if no == len(arrivals) - 1:
            scratch.drop(rows)
        start_ingest(source, log, f"{scratch.root}/log").awaitTermination()
        log.vacuum(no)
    return log, len(arrivals) - 1


@query("verse_passages", f"SELECT id AS passage_id, book, chapter, verse_start, coalesce(verse_end, -1) AS verse_end FROM verse_passages WHERE {STAYS}")
def ingest_stream(spark, d):
    log, last = ingest(spark, d)
    return log.table("verses", last).select("passage_id", "book", "chapter", "verse_start", "verse_end").fillna(-1, "verse_end")


WORDS = "list_filter(regexp_split_to_array(lower(header), '[^\\pL\\pN]+'), lambda x: x <> '')"


@query("verse_passages", f"SELECT 'postings' AS name, term AS item, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM verse_passages WHERE {STAYS}) GROUP BY term UNION ALL SELECT 'pending', CAST(id % 10 AS VARCHAR), count(*) FROM verse_passages WHERE {STAYS} GROUP BY id % 10 UNION ALL SELECT 'passages', 'all', count(*) FROM verse_passages WHERE {STAYS} UNION ALL SELECT 'lengths', 'all', CAST(sum(len({WORDS})) AS BIGINT) FROM verse_passages WHERE {STAYS}")
def ingest_refresh(spark, d):
    """What the log holds after all batches, with the count and the summed length that it kept on the way."""
    log, last = ingest(spark, d)
    count, mean = log.totals(last)
    sums = spark.createDataFrame([("passages", "all", count), ("lengths", "all", round(mean * count))], "name string, item string, n long")
    postings = log.table("postings", last).groupBy(F.lit("postings").alias("name"), F.col("term").alias("item")).agg(F.count("*").alias("n"))
    pending = log.table("pending", last).groupBy(F.lit("pending").alias("name"), F.expr("cast(id % 10 as string)").alias("item")).agg(F.count("*").alias("n"))
    return postings.unionByName(pending).unionByName(sums)
