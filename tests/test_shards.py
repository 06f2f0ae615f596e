"""Batches over several shards."""

from pyspark.sql import functions as F

from stemma.operators import embed as M


def test_shards_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 50)
    texts = spark.range(1000).select("id", F.lit("text").alias("clean"), F.lit(10).cast("long").alias("tokens"))
    got = M.pack_batches(texts).toPandas()
    assert sorted(got.id) == list(range(1000)) and got["shard"].nunique() == 20
