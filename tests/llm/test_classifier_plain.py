"""The classifier against a plain version over all its texts, and its weights against the hinge-loss objective."""

import math
import zlib

import numpy as np

from stemma.llm.nbsvm import Features, classify, dual_descent, logistic

D = "/root/testdata/sf0.001"
BITS = 18


def objective(w, rows, values, y, c):
    most = {s: c * len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    margins = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
    return 0.5 * w @ w + sum(most[s] * max(0.0, 1 - s * m) for s, m in zip(y, margins))


def test_weights_are_the_optimum():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(80) < 0.4, 1.0, -1.0)
    rows = [np.unique(rng.integers(0, 12, 4)) for _ in y]
    values = [rng.normal(0.3 * s, 1, len(r)) for s, r in zip(y, rows)]
    w = dual_descent(rows, values, y, 12, 1.0, 4000)
    best = objective(w, rows, values, y, 1.0)
    for scale in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(200):
            assert best <= objective(w + scale * rng.normal(size=13), rows, values, y, 1.0) + 1e-4


def test_scores_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in classify(docs, labels.selectExpr("doc_id", "quality AS label")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    taught = {d: int(sum(v) / len(v) >= 0.5) for d, v in marks.items() if d in texts and zlib.crc32(str(d).encode()) % 4 != 2}
    grams = {d: Features(BITS)(t) for d, t in texts.items()}
    count = {0: {}, 1: {}}
    for d, label in taught.items():
        for g in grams[d].tolist():
            count[label][g] = count[label].get(g, 0) + 1
    total = {label: 2**BITS + sum(c.values()) for label, c in count.items()}
    ratio = lambda g: np.float32(math.log((count[1].get(g, 0) + 1) / total[1]) - math.log((count[0].get(g, 0) + 1) / total[0]))
    vector = {d: np.array([ratio(g) for g in grams[d].tolist()], np.float32) for d in texts}
    vector = {d: v / max(1e-9, float(np.sqrt(v @ v))) for d, v in vector.items()}
    tune = {d: zlib.crc32(str(d).encode()) % 4 == 3 for d in taught}
    order = sorted(taught, key=lambda d: (1 + taught[d] + 2 * tune[d], grams[d].astype(np.int64).tobytes()))
    fit, held = [d for d in order if not tune[d]], [d for d in order if tune[d]]
    sign = lambda ds: np.array([1.0 if taught[d] else -1.0 for d in ds])
    w = dual_descent([grams[d] for d in fit], [vector[d] for d in fit], sign(fit), 2**BITS, 1.0, 20)
    margin = {d: w[grams[d]] @ vector[d] + w[-1] for d in texts}
    a, b = logistic(np.array([margin[d] for d in held]), sign(held))
    assert len(got) == len(texts) and len(taught) > 20 and len(set(got.values())) > 50
    for d in texts:
        assert abs(got[d] - 1 / (1 + math.exp(-(a * margin[d] + b)))) < 1e-4


def test_other_columns_and_repeated_rows(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.selectExpr("doc_id", "quality AS label")
    plain = {(r.doc_id, round(r.score, 6)) for r in classify(docs, labels).collect()}
    clash = docs.selectExpr("*", "1 AS label", "2 AS y", "3 AS h", "4 AS score", "true AS held_out")
    assert {(r.doc_id, round(r.score, 6)) for r in classify(clash, labels.selectExpr("*", "'x' AS text", "5 AS h")).collect()} == plain
    twice = classify(docs.limit(20).union(docs.limit(20)), labels).collect()
    assert len(twice) == 40 and len({(r.doc_id, r.score) for r in twice}) == 20


def test_a_repeated_id_is_fitted_once(spark):
    """However many rows an id has, one of them is in the fitted sample: the model is that of the distinct rows with the same counts."""
    rng = __import__("random").Random(4)
    texts = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["spam", "buy", "win"]) for _ in range(12))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, label int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    many = spark.createDataFrame([r for r in texts for _ in range(7)], "doc_id long, text string")
    a = {r.doc_id: r.score for r in classify(once, labels, smoothing=1.0).collect()}
    b = {r.doc_id: r.score for r in classify(many, labels, smoothing=7.0).collect()}  # counts are sevenfold, ratios the same
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-5
