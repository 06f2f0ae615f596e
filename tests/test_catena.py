"""Passages on verses: what goes over before pairs are made, and results on odd headers."""

import random

from pyspark.sql import functions as F

from stemma.operators import catalog as C
from stemma.operators.intervals import holding_ranges


def test_exploded_points_are_not_sent_to_all(spark):
    ranges = spark.range(1000).selectExpr("id as rid", "id as lo", "id + 3 as hi", "1 as k")
    plan = holding_ranges(ranges, "lo", "hi", spark.range(9).selectExpr("id as at", "1 as k"), "at", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_first_passages_are_taken_before_refs_meet_them(spark):
    rng = random.Random(7)
    heads = ["John 1:2", "john 1:2-4", "John 1:2-", "John 1:20", "John 1:", "John 1", "John 1:-3", "John 1:2a", "Mark 1:2", "John 1:2:2", None]
    passages = [(i, rng.randrange(4), rng.choice(heads)) for i in range(200)]
    works, authors = [(0, 0, "Commentary on X"), (1, 0, "commentary on A"), (2, 1, "Notes"), (3, 1, "Commentary on X")], [(0, "b"), (1, "a")]
    refs = [(1, "JOHN", 1, None), (2, "John", 1, 2), (3, "john", 1, -3), (4, "Mark", 1, None), (5, "John", 1, 9), (2, "Mark", 1, 2), (1, "John", 1, 2), (6, None, 1, 2)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = C.catena_by_header(df(passages, "id long, work_id long, header string"), df(works, "id long, author_id long, title string"), df(authors, "id long, name string"), df(refs, "ref_id long, book string, chapter int, verse int"), 5)
    title, name = {w: (t, a) for w, a, t in works}, dict(authors)
    want = []
    for ref in {r[0] for r in refs}:
        met = []
        for _, book, chapter, verse in (r for r in refs if r[0] == ref):
            for i, w, h in passages:
                head, _, tail = (h or "").partition(":")
                if h and ":" in h and w != 2 and head.lower() == " ".join(x for x in ((book or "").lower(), str(chapter)) if x) and (verse is None or tail == str(verse) or tail.startswith(f"{verse}-")):
                    met.append((name[title[w][1]], title[w][0], i))
        want += [(ref, n + 1, x[2]) for n, x in enumerate(sorted(met)[:5])]
    assert sorted((r.ref_id, r.place, r.id) for r in got.collect()) == sorted(want)
    assert "WindowGroupLimit [head" in got._jdf.queryExecution().optimizedPlan().toString()


def test_verses_of_many_refs(spark):
    index = spark.range(300).select(F.col("id").alias("passage_id"), F.lit("John").alias("book"), F.lit(1).alias("chapter"), F.expr("cast(id % 9 as int) as verse_start"), F.expr("case when id % 2 = 0 then cast(id % 9 + id % 4 as int) end as verse_end"))
    refs = spark.range(100).select(F.col("id").alias("ref_id"), F.lit("JOHN").alias("book"), F.lit(1).alias("chapter"), F.expr("cast(id % 12 as int) as verse"))
    passages = spark.range(300).selectExpr("id", "id % 3 as work_id", "'h' as header")
    works, authors = spark.range(3).selectExpr("id", "id as author_id", "'t' as title"), spark.range(3).selectExpr("id", "'n' as name")
    got = C.catena(passages, works, authors, index.union(index.limit(10)), refs)
    want = index.union(index.limit(10)).join(refs.select("ref_id", "verse"), F.expr("verse between verse_start and coalesce(verse_end, verse_start)")).select("ref_id", "passage_id")
    assert sorted(map(tuple, got.select("ref_id", "id").collect())) == sorted(map(tuple, want.collect()))
