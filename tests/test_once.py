"""Texts and headers are worked on once."""

from stemma.operators import embed as M
from stemma.operators import reader as R
from stemma.session import Scratch


def test_excerpts_without_a_title_run_over_the_lines_once(spark, monkeypatch):
    cuts, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, *a, **k: cuts.append(a) or cut(self, *a, **k))
    got = R.excerpts(spark.createDataFrame([(1, 0, "one two"), (1, 1, "three four five")], "doc_id long, seq int, text string"), 13)
    assert {(r.seq, r.text) for r in got.collect()} == {(0, "one two")} and len(cuts) == 1


def test_reorder_reads_headers_once(spark):
    rows = [(1, 1, "John 2:1"), (2, 1, "John 1:1"), (3, 1, "John 1:2"), (4, None, "John 1:1"), (5, 2, None)]
    moved, report = R.reorder(spark.createDataFrame(rows, "id long, work_id long, header string"))
    assert "regexp" not in moved._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {tuple(r) for r in moved.collect()} == {(1, 1, "John 1:1"), (2, 1, "John 1:2"), (3, 1, "John 2:1"), (5, 2, None)}
    assert {tuple(r) for r in report.collect()} == {(1, "VERSE", 3), (2, None, 0)}


def test_embedding_cleans_texts_once(spark):
    texts = spark.createDataFrame([(1, "word"), (2, ""), (3, None), (4, "known")], "id long, text string").selectExpr("id", "upper(text) as clean")
    done = M.embed(texts, M.hashing_encoder(8), spark.createDataFrame([(4, [1.0])], "passage_id long, embedding array<float>"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert sorted(r.passage_id for r in done.collect()) == [1, 4]
