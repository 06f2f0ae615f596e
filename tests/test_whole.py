"""Text and search queries over all rows, and marks and citations against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import search as S
from stemma.plans import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, source, key", [("strip_citations", "documents", "doc_id"), ("flag_truncated", "documents", "doc_id"), ("prepare_texts", "documents", "doc_id")])
def test_every_row_comes_back(spark, name, source, key):
    assert registry.QUERIES[name](spark, D).count() == spark.read.parquet(f"{D}/{source}.parquet").count()


def test_whole_texts_keep_their_length(spark):
    got = {r.id: r.n for r in registry.QUERIES["prepare_texts"](spark, D).collect()}
    assert got == {r.doc_id: len(r.text.strip()) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def test_queries_are_all_ids_divisible_by_fifty(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{D}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert {r.query_id for r in registry.QUERIES["vector_topk"](spark, D).select("query_id").distinct().collect()} == ids


def test_citations_after_of(spark):
    texts = ["He speaks of, and out of , Matthew 5:3. this", "proof, hoof , of\t,", 'a "  b" of Matthew 5:3, c', "roof of,of,"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").orderBy("i").select(T.strip_citations(F.col("x")).alias("t")).collect()]
    assert got == [T._citations_off(x).strip() for x in texts]
    assert got[0] == "He speaks, and out, this" and got[1] == "proof, hoof,,"


def test_marks_of_special_characters_and_short_terms(spark):
    asked = ["what? (a.b) c++", "it is", "[x]* $5.00 a|b|c", "don't \\d+", "", "Plain words"]
    texts = ["What? what (a.b) axb c++ ccc it IS", "[x]* [y] $5.00 $5x00 a|b|c abc", "Don't dont \\d+ 123 PLAIN words"]
    rows = [(q, i, t) for q in range(len(asked)) for i, t in enumerate(texts)]
    marked = S.highlight(spark.createDataFrame(rows, "query_id int, id int, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"))

    def plain(query, text):
        ts = list(dict.fromkeys(t for t in query.lower().strip().split() if len(t) >= 3))
        return re.sub("|".join(map(re.escape, ts)), lambda m: f"<mark>{m[0]}</mark>", text, flags=re.I) if ts else text

    assert {(r.query_id, r.id): r.marked for r in marked.collect()} == {(q, i): plain(asked[q], t) for q, i, t in rows}
