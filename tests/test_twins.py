"""Queries and their SQL on rows that the smallest tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stemma.plans import registry


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as rows by column."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours = registry.QUERIES[name](spark, str(folder))
    theirs = con.execute(registry.ORACLE[name])
    names = [c[0] for c in theirs.description]
    return sorted(map(repr, ours.select(*names).collect())), sorted(repr(r) for r in ours.sparkSession.createDataFrame(theirs.fetchall(), ours.select(*names).schema).collect())


HTML = "<html><head><title>T</title></head><body><article><h1>The one&amp;&amp two &am three&amp</h1><p>The and &lt;a &amp;lt; b&gt c.</p><p>That&quot is&amp</p></article></body></html>"


@pytest.mark.parametrize("name", ["strip_html", "prepare_pages", "chunk_pages", "section_between", "compose_sections"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    ours, theirs = both(spark, tmp_path, name, pages={"page_id": pa.array([1, 2], pa.int64()), "url": ["u", "u"], "html": [HTML, HTML.replace("one", "1")]})
    assert ours and ours == theirs


def test_paragraphs_with_references_without_a_semicolon(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "paragraphs", pages={"page_id": pa.array([1], pa.int64()), "url": ["u"], "html": [HTML]})
    assert any("two &am three&'" in r for r in ours) and ours == theirs


def texts(of):
    n = len(of)
    return {"doc_id": pa.array(range(n), pa.int64()), "text": of, "lang": ["en"] * n, "source": ["src1"] * n, "n_chars": pa.array(map(len, of), pa.int64())}


def test_marks_of_words_that_begin_alike(spark, tmp_path):
    asked = ["the thenstti", "thenstti the", "can canal", "canal can", "and andes", "andes and", "for form", "form for"]
    labels = {"doc_id": pa.array([0], pa.int64()), "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}
    ours, theirs = both(spark, tmp_path, "highlight", documents=texts([f"{a} Then Thenstti." for a in asked]), labels=labels, benchmark={"item_id": pa.array(range(8), pa.int64()), "text": asked})
    assert any("<mark>the</mark>nstti" in r for r in ours) and any("<mark>thenstti</mark>" in r for r in ours) and ours == theirs


def test_names_in_texts_with_letters_of_two_capitals(spark, tmp_path):
    names = {"item_id": pa.array([1, 2], pa.int64()), "text": ["Chß schß one", "Massen two three"]}
    ours, theirs = both(spark, tmp_path, "resolve_names_in_texts", documents=texts(["Chß a b", "Chß a b", "x Massen two", "a", "Maß c d"]), benchmark=names)
    assert any("Massen" in r for r in ours) and ours == theirs
