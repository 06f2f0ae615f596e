"""The pipeline's quality rules on labelled texts of 50 to 199 words."""

import corpus_pipeline as P
from stemma.llm.quality_rules import judge
from stemma.session import table

D = "/root/testdata/sf0.01"


def test_short_bad_texts_go_and_clean_ones_stay(spark):
    docs = table(spark, D, "documents")
    labels = table(spark, D, "labels").toPandas().drop_duplicates("doc_id")
    measured = judge(docs).select("doc_id", "n_words", "base_failed", "js_classes").toPandas().merge(labels, on="doc_id")
    short = measured[(measured.n_words >= 50) & (measured.n_words < 200) & ~measured.base_failed]
    kept = {r.doc_id for r in P.quality(spark, docs, D).select("doc_id").collect()}
    bad = set(short[(short.quality == 0) & ~(short.js_classes > 0.3)].doc_id)
    clean = set(short[short.quality == 1].doc_id)
    assert bad and len(bad & kept) <= len(bad) // 4
    assert len(clean & kept) >= 0.99 * len(clean)
