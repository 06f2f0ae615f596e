"""The pairs of passages and refs: spread over tasks however many are on a verse, and whole."""

from collections import Counter

from pyspark.sql import functions as F

from stemma.operators import catalog as C


def made(spark, passages, refs):
    """catena of passages on John 1:1 to 1:3 and refs (ref_id, verse)."""
    index = spark.createDataFrame([(i, "John", 1, a, b) for i, a, b in passages], "passage_id long, book string, chapter int, verse_start int, verse_end int")
    ids = spark.createDataFrame([(i, i % 2, "h") for i, _, _ in passages], "id long, work_id long, header string").distinct()
    works, authors = spark.range(2).selectExpr("id", "id as author_id", "concat('t', id) as title"), spark.range(2).selectExpr("id", "'n' as name")
    asked = spark.createDataFrame([(r, "JOHN", 1, v) for r, v in refs], "ref_id long, book string, chapter int, verse int")
    return C.catena(ids, works, authors, index, asked)


def test_a_verse_that_all_are_on_is_spread_over_tasks(spark):
    got = made(spark, [(i, 1, None) for i in range(200)], [(r, 1) for r in range(1100)])
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and sum(r["count"] for r in tasks) == 200 * 1100
    assert got.distinct().count() == 200 * 1100


def test_more_refs_than_a_list_holds_equal_refs_and_nulls(spark):
    passages = [(1, 1, None), (2, 1, 3), (3, 2, 1), (4, None, 2), (5, 2, None), (6, 3, 3)]
    refs = [(r, r % 3 + 1) for r in range(3 * C.LIST + 7)] + [(5, 3), (5, 3), (None, 1), (None, 1), (9, None)]
    got = made(spark, passages, refs)
    want = Counter((r, i, f"t{i % 2}") for r, v in refs for i, a, b in passages if None not in (v, a) and a <= v <= (a if b is None else b))
    assert Counter((r.ref_id, r.id, r.work) for r in got.collect()) == want
    assert {"ref_id", "id", "work_id", "header", "author_id", "work", "author"} == set(got.columns)
