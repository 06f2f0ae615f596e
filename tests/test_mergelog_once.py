"""A batch's rows go over once when versions are compared, and nothing derived from them does."""

import os
import random

from pyspark.sql import functions as F

from stemma.operators import search as S
from stemma.streaming.mergelog import MergeLog
from tests.test_mergelog import DERIVE, SCHEMA, batches_of, check


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passages_are_shuffled_once_a_write_and_derived_rows_never(spark, tmp_path, monkeypatch):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 3, F.size(S.terms(F.col("text"))), most=2)
    plans, write = [], log.write
    monkeypatch.setattr(log, "write", lambda rows, key, name, part: plans.append((name, part, plan(rows).count("Exchange"))) or write(rows, key, name, part))
    batches = batches_of(random.Random(4), 2)
    for no, rows in enumerate(batches):
        log.apply(spark.createDataFrame(rows, SCHEMA), no)
        check(spark, log, no, batches[: no + 1])
    assert {part for _, part, _ in plans} >= {"0", "1", "1-all"}
    assert all(n == (name == "passages") for name, _, n in plans)
    assert set(os.listdir(f"{tmp_path}/log")) == {"passages", "manifest", *DERIVE}
    # what batch and compaction both have is written once for a bucket
    assert all(len(parts) <= 1 for (name, _), (parts, _, _) in log.manifest(1).items() if name != "passages")


def test_a_bucket_of_one_part_is_read_as_it_is(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 2, F.size(S.terms(F.col("text"))), most=2)
    batches = [[(i, v, v == 2 and i % 5 == 0, f"John {i + 1}:{v}", "a b") for i in range(40)] for v in (1, 2)]
    for no, rows in enumerate(batches):
        log.apply(spark.createDataFrame(rows, SCHEMA), no)
        check(spark, log, no, batches[: no + 1])
        log.vacuum(no)
        check(spark, log, no, batches[: no + 1])
    for name in DERIVE:
        assert "Exchange" not in plan(log.table(name, 1)) and "Join" not in plan(log.table(name, 1))


def test_buckets_of_one_part_and_of_several(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 5, F.size(S.terms(F.col("text"))), most=3)
    batches, mixed = batches_of(random.Random(8), 5), False
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for no, rows in enumerate(batches):
        log.apply(spark.createDataFrame(rows, SCHEMA), no)
        before = log.manifest(no)
        log.apply(spark.createDataFrame(rows, SCHEMA), no)  # done again
        assert log.manifest(no) == before
        log.vacuum(no)
        check(spark, log, no, batches[: no + 1])
        mixed = mixed or len({len(parts) for (name, _), (parts, _, _) in before.items() if name == "passages"}) > 1
    assert mixed
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting
