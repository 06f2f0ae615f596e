"""Every stage of the pipeline against a plain version of it, each on its own input."""

from collections import Counter

import corpus_pipeline as P
import duckdb
import pytest
from stemma.llm import queries as Q
from stemma.session import Scratch, table

from tests_plain import plain_lines, plain_simhash

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    frames, scratch = [table(spark, D, "documents")], Scratch(spark)
    for _, stage in P.STAGES:
        frames.append(scratch.cut(stage(spark, frames[-1], D)))
    return frames


def rows(df):
    return df.select(*P.COLUMNS).toPandas()


def test_all_but_the_last_return_the_columns(stages):
    assert all(f.columns == list(P.COLUMNS) for f in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    before, after = rows(stages[0]), set(rows(stages[1]).doc_id)
    labels = table(spark, D, "labels").toPandas()
    clean = before.merge(labels[labels.quality == 1], on="doc_id")
    clean = clean[[len(t.split()) >= 50 for t in clean.text]]
    assert len(clean) and set(clean.doc_id) <= after < set(before.doc_id)


def by_sql(documents, name):
    """The rows of a query's SQL over a stage's own input."""
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(Q.oracle_sql()[name]).df()


def test_quality_is_its_sql(stages):
    want = by_sql(rows(stages[0]), "op7_quality_rules")
    assert sorted(rows(stages[1]).doc_id) == sorted(want[want.kept].doc_id)


def test_mix_is_its_sql(stages):
    want = by_sql(rows(stages[3]), "op8_mixing")
    assert Counter(rows(stages[4]).doc_id) == Counter({d: t // z for d, t, z in zip(want.doc_id, want.taken, want["size"]) if t})


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert dict(zip(after.doc_id, after.text)) == plain_lines(list(zip(before.doc_id, before.text)))


def test_near_duplicates(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert sorted(after.doc_id) == sorted(set(plain_simhash(list(zip(before.doc_id, before.text))).values()))


def test_mix(stages):
    before, after = rows(stages[3]), rows(stages[4])
    size = {d: len(t.split()) for d, t in zip(before.doc_id, before.text)}
    assert set(after.doc_id) <= set(size) and after.doc_id.value_counts().max() <= 2
    assert abs(sum(size[d] for d in after.doc_id) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())


def test_packed(stages):
    before, got = rows(stages[4]), stages[5].toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert set(got.doc_id) == set(before.doc_id)


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, P.run(spark, D).select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))
