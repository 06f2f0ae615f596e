"""Running values and pages over keys that are spread over many tasks."""

import random

from pyspark.sql import functions as F

from stemma.operators import reader as R
from stemma.operators.scan import running
from stemma.session import Scratch


def test_running_values_of_one_key_in_eight_ranges(spark):
    rng = random.Random(1)
    rows = [(1, i, rng.randrange(9), rng.choice([None, None, "a", "b"])) for i in range(500)] + [(k, i, 1, None) for k in (2, 3, None) for i in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x int, m string")
    got = running(df, ["k"], ["i"], Scratch(spark), sums={"sum": F.col("x")}, lasts={"last": F.col("m")}, ranges=8).collect()
    want, sums, lasts = set(), {}, {}
    for k, i, x, m in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        sums[k] = sums.get(k, 0) + x
        lasts[k] = m or lasts.get(k)
        want.add((k, i, sums[k], lasts[k]))
    assert {(r.k, r.i, r.sum, r["last"]) for r in got} == want and len(got) == len(rows)
    assert running(df.limit(0), ["k"], ["i"], Scratch(spark), sums={"sum": F.col("x")}).count() == 0


def test_chapters_of_one_work_in_eight_ranges(spark):
    rng = random.Random(2)
    rows = [(w, i * 3, rng.choice(["A", "B", None])) for w in (1, 2) for i in range(200 if w == 1 else 2)]
    df = spark.createDataFrame(rows, "work_id int, id long, header string")
    want = []
    for w in (1, 2):
        headers = [h for v, _, h in rows if v == w]
        for n, h in enumerate(headers):
            if n and h == headers[n - 1]:
                want[-1][4] += 1
            else:
                want.append([w, (want[-1][1] + 1 if want and want[-1][0] == w else 0), h, n, 1])
    chapters = R.chapter_index(df, ranges=8)
    assert sorted([list(r) for r in chapters.collect()], key=lambda r: r[:2]) == want
    places = spark.createDataFrame([(w, n) for w in (1, 2) for n in range(200 if w == 1 else 2)], "work_id int, at int")
    got = {(r.work_id, r.at): (r.run, r.header) for r in R.active_chapter(chapters, places, ranges=8).collect()}
    assert got == {(w, n): next((r, h) for v, r, h, s, c in want if v == w and s <= n < s + c) for w, n in got} and len(got) == 202


def tiled(sizes, budget, most):
    pages, used, held = [], 0, 0
    for n, x in enumerate(sizes):
        if not pages or held == most or used + x > budget:
            pages.append([n, n])
            used = held = 0
        pages[-1][1] = n
        used, held = used + x, held + 1
    return pages


def test_pages_across_blocks(spark):
    rng = random.Random(3)
    works = {w: [rng.choice([0, 1, 5, 30, 90]) for _ in range(n)] for w, n in ((1, 1), (2, 7), (3, 8), (4, 9), (5, 500), (6, 64))}
    df = spark.createDataFrame([(w, i, x) for w, sizes in works.items() for i, x in enumerate(sizes)], "work_id int, id long, size long")
    for budget, most, block in ((60, 4, 8), (60, 8, 8), (1000, 5, 8), (10, 3, 64)):
        got = sorted(map(tuple, R.paginate(df, budget, most, 20, block, ranges=8).select("work_id", "page", "lo", "hi", "complete", "has_prev", "has_next").collect()))
        want = []
        for w, sizes in works.items():
            pages = [[0, len(sizes) - 1]] if sum(sizes) <= 20 else tiled(sizes, budget, most)
            want += [(w, p + 1, lo, hi, sum(sizes) <= 20, p > 0, p < len(pages) - 1) for p, (lo, hi) in enumerate(pages)]
        assert got == sorted(want)
