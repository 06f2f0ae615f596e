"""The pipeline's near-duplicates on rows without an id and on repeated ids."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def survivors(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)
    return sorted(((r.doc_id, r.text, r.source) for r in P.near_duplicates(spark, docs, "").collect()), key=repr)


def test_texts_without_an_id_stay_once(spark):
    rows = [(None, "only here without any id", "s"), (None, "only here without any id", "s"), (None, "two of this", "s"), (4, "Two of THIS", "s"), (None, None, "s")]
    assert survivors(spark, rows) == sorted([(None, "only here without any id", "s"), (4, "Two of THIS", "s"), (None, None, "s")], key=repr)


def test_repeated_ids_leave_one_row_a_group(spark):
    rows = [(7, "a first text of it", "s"), (7, "a first text of it", "s"), (7, "quite another set of words", "s"), (2, "quite another set of words", "s"), (7, "A first text of it", "s"), (9, "a first text of it", "t")]
    got = survivors(spark, rows)
    assert len(got) == 2 and [d for d, _, _ in got] == [2, 7]
    assert {t.lower() for _, t, _ in got} == {"a first text of it", "quite another set of words"}


def test_one_id_stands_for_each_of_its_groups(spark):
    rows = [(7, "a first text of it", "s"), (7, "quite another set of words", "s"), (8, "a first text of it", "s"), (8, "quite another set of words", "s")]
    assert survivors(spark, rows) == [(7, "a first text of it", "s"), (7, "quite another set of words", "s")]
