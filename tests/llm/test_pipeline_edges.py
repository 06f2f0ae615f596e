"""Every stage of the pipeline on no rows, nulls in every column, repeated rows and other columns."""

import random

import corpus_pipeline as P
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, rid string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, 1, "clash") for d, t, lang, s, n in rows], SCHEMA)


def prose(seed, n=120):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(10)) for _ in range(n // 10))


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_no_rows(spark, stage):
    assert stage(spark, documents(spark, []), "").count() == 0


ROWS = [(1, prose(1), "en", "a", 9), (None, prose(2), None, None, None), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, prose(5), "xx", None, 1), (5, prose(5), "xx", None, 1), (None, None, None, None, None), (6, prose(6, 20000), "en", "a", 1)]


def test_stages_on_nulls_and_repeats(spark):
    docs = documents(spark, ROWS)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(P.quality(spark, docs, "")) == sorted([1, None, 5, 5, 6], key=repr)
    kept = P.lines(spark, docs, "").collect()
    assert len(kept) == len(ROWS) and all((r.text is None) == (r.n_chars is None) for r in kept)
    assert ids(P.near_duplicates(spark, docs, "")) == sorted([1, None, 3, 5, 6], key=repr)
    mixed = P.mixture(spark, docs, "").collect()
    assert {r.doc_id for r in mixed} <= {1, None, 5, 6} and all(r.text for r in mixed) and max(sum(x == r for x in mixed) for r in mixed) <= 4
    packed = P.packed(spark, docs, "").collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_tokens == 1) == 3 and sum(1 for r in packed if r.doc_id == 5 and r.start == 0) == 2
    assert all(f(spark, docs, "").columns == list(P.COLUMNS) for _, f in P.STAGES[:-1])
