"""The merge log: any order of versions, deletions and replays ends where a rebuild does."""

import random

from pyspark.sql import functions as F

from stemma.operators import etl as E
from stemma.operators import search as S
from stemma.streaming.mergelog import MergeLog, ingest_stream

SCHEMA = "id long, version long, deleted boolean, header string, text string"
DERIVE = {"verses": ("passage_id", E.build_verse_index), "words": ("id", lambda p: p.select("id", F.explode(S.terms(F.col("text"))).alias("term")))}


def rebuilt(batches):
    """The passages that stand: the highest version of each id, deletions left out. No two rows share id and version."""
    best = {}
    for row in (r for b in batches for r in b):
        if row[0] not in best or row[1] > best[row[0]][1]:
            best[row[0]] = row
    return [r for r in best.values() if not r[2]]


def state(log, batch):
    names = {"passages": ("id", "version", "header", "text"), "words": ("id", "term"), "verses": ("passage_id", "book", "chapter", "verse_start")}
    return {name: sorted(map(tuple, log.table(name, batch).select(*columns).collect())) for name, columns in names.items()}


def check(spark, log, batch, batches):
    want = rebuilt(batches)
    df = spark.createDataFrame(want, SCHEMA)
    got = state(log, batch)
    assert got["passages"] == sorted((i, v, h, t) for i, v, _, h, t in want)
    assert got["words"] == sorted((i, w) for i, _, _, _, t in want for w in t.split())
    assert got["verses"] == sorted(map(tuple, E.build_verse_index(df).select("passage_id", "book", "chapter", "verse_start").collect()))
    count, mean = log.totals(batch)
    assert count == len(want) and abs(mean * count - sum(len(t.split()) for *_, t in want)) < 1e-6


def batches_of(rng, n):
    """Batches of versions in random order; an id's versions differ."""
    free = [(i, v) for i in range(12) for v in range(1, 8)]
    rng.shuffle(free)
    row = lambda i, v: (i, v, rng.random() < 0.25, f"John {i}:{v}" if rng.random() < 0.7 else "Preface", " ".join(rng.choice("abc") for _ in range(rng.randrange(4))))
    return [[row(i, v) for i, v in free[k::n]][:12] for k in range(n)]


def test_any_order_equals_a_rebuild(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 3, F.size(S.terms(F.col("text"))), most=3)
    batches = batches_of(random.Random(1), 5)
    for no, rows in enumerate(batches):
        log.apply(spark.createDataFrame(rows, SCHEMA), no)
        check(spark, log, no, batches[: no + 1])
    assert all(len(parts) < 3 for parts, _, _ in log.manifest(4).values())
    # a batch done again, also one that compacted, leaves everything as it was
    before = log.manifest(4)
    log.apply(spark.createDataFrame(batches[4], SCHEMA), 4)
    assert log.manifest(4) == before
    check(spark, log, 4, batches)
    # rows that came before change nothing when they come again
    log.apply(spark.createDataFrame(batches[0] + batches[2], SCHEMA), 5)
    assert log.manifest(5) == before
    log.vacuum(5)
    check(spark, log, 5, batches)


def test_a_stream_of_files(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 4, F.size(S.terms(F.col("text"))))
    batches = [[(1, 1, False, "John 1:1", "a b"), (2, 2, False, "John 1:2", "c")], [(2, 1, False, "Late", "old"), (1, 2, True, None, ""), (3, 1, None, "Mark 2:3", "f")], [(1, 1, False, "Late", "old"), (2, 3, False, "Preface", "d e")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), log, f"{tmp_path}/c").awaitTermination(120)
    check(spark, log, 2, batches)
    # a batch changes the buckets of its own ids only
    assert sum(len(parts) for (name, _), (parts, _, _) in log.manifest(2).items() if name == "passages") <= 5


def test_edges(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 2)
    log.apply(spark.createDataFrame([], SCHEMA), 0)
    assert log.table("passages", 0) is None and log.totals(0) == (0, 0.0)
    rows = [(None, 1, False, "x", "x"), (1, None, False, "x", "x"), (1, 1, False, "a", "a"), (1, 1, True, "a", "a"), (2, 5, False, None, None)]
    log.apply(spark.createDataFrame(rows, SCHEMA).drop("deleted").union(spark.createDataFrame([], SCHEMA).drop("deleted")), 1)
    assert sorted(r.id for r in log.table("passages", 1).collect()) == [1, 2]
    log.apply(spark.createDataFrame([(1, 9, True, None, None), (1, 9, False, "b", "b")], SCHEMA), 2)
    assert [r.id for r in log.table("passages", 2).collect()] == [2] and log.totals(2)[0] == 1


def test_a_compaction_finds_the_newest_versions_once(spark, tmp_path, monkeypatch):
    log = MergeLog(spark, f"{tmp_path}/log", DERIVE, 3, F.size(S.terms(F.col("text"))), most=2)
    batches = batches_of(random.Random(4), 2)
    log.apply(spark.createDataFrame(batches[0], SCHEMA), 0)
    calls, newest = [], log.newest
    monkeypatch.setattr(log, "newest", lambda *a: calls.append(a) or newest(*a))
    log.apply(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert len(calls) == 2  # for what the batch meets, and for the compaction
    check(spark, log, 1, batches)
