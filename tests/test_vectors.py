"""Vector search over stored pieces against every product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import search as S
from stemma.operators import vectors as V
from stemma.session import Scratch


def plain(x, ids, k, own=None):
    """(query, rank, row) of all products; own(i): rows that query i may find."""
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.maximum(norms, 1e-10)[:, None]
    want = set()
    for i in ids:
        if norms[i]:
            s = np.round(unit @ unit[i], 9)
            want |= {(i, r + 1, j) for r, j in enumerate(sorted(own(i) if own else range(len(x)), key=lambda j: (-s[j], j))[:k])}
    return want


def rows(found):
    return {(r.query_id, r["rank"], r.id) for r in found.collect()}


@pytest.mark.parametrize("queries, piece, centres", ((16384, 2048, 512), (10, 7, 5)))
def test_against_all_products(spark, monkeypatch, queries, piece, centres):
    for name, value in (("QUERIES", queries), ("PIECE", piece), ("CENTRES", centres)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(230, 4))
    x[40:90] = x[3]  # many copies of one vector
    x[100:104] = 0
    x[110:150] = rng.normal(0, 0.01, (40, 4)) + [1, 0, 0, 0]
    v = spark.createDataFrame([(i, r.tolist(), f"a{i % 3}") for i, r in enumerate(x)], "passage_id long, embedding array<double>, author string")
    q = v.where("passage_id % 5 = 0").select(F.col("passage_id").alias("query_id"), "embedding", F.expr("case when passage_id % 2 = 0 then upper(author) end").alias("author"))
    ids = range(0, 230, 5)
    assert rows(S.vector_topk(q, v, 4, 7)) == plain(x, ids, 7, lambda i: [j for j in range(230) if i % 2 or j % 3 == i % 3])
    assert rows(S.vector_topk(q.drop("author"), v, 4, 60)) == plain(x, ids, 60)
    assert rows(S.vector_topk(q.drop("author"), v, 4, 500)) == plain(x, ids, 500)


def test_pieces_too_far_away_are_passed_over(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (20, 8))[np.arange(2000) % 20] + rng.normal(0, 0.02, (2000, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "passage_id long, embedding array<double>")
    scratch = Scratch(spark)
    stored = V.store_vectors(v, 8, scratch)
    skipped, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    q = v.where("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "embedding")
    assert rows(V.nearest(q, stored, 8, 10, scratch, skipped, met)) == plain(x, range(0, 2000, 50), 10)
    assert skipped.value + met.value == 40 * 2000 and skipped.value > 0.8 * 40 * 2000
    assert stored.pieces.agg(F.sum("n")).first()[0] == 2000


def test_no_vectors_and_no_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "passage_id long, embedding array<double>")
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    assert rows(S.vector_topk(q, v, 2, 3)) == {(1, 1, 1)}
    assert S.vector_topk(q, v.limit(0), 2, 3).count() == 0 and S.vector_topk(q.limit(0), v, 2, 3).count() == 0
