"""Blocks of postings: only what a query can need is decoded, and the results are those of scoring everything."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest

from stemma.operators import postings as P
from stemma.operators import search as S
from stemma.session import Scratch

SCHEMA = "id long, text string, author string, work string"


def lists_of(rng, n, terms, most=9):
    """Postings of some terms over ids below n, in blocks of 16, and every term's rows."""
    out, rows = [], []
    for t in range(terms):
        ids = np.sort(rng.choice(n, rng.integers(1, n // (t + 2)), replace=False))
        tfs, dls = rng.integers(1, most, len(ids)), 20 + ids % 31
        share = tfs * 2.2 / (tfs + 1.2 * (0.25 + 0.75 * dls / 30.0))
        cuts = [slice(i, i + 16) for i in range(0, len(ids), 16)]
        lo, hi, top = (np.array([f(x) for c in cuts for x in [c]]) for f in (lambda c: ids[c][0], lambda c: ids[c][-1], lambda c: share[c].max()))
        out.append(P.Postings(lo, hi, top, np.arange(len(cuts)), lambda r, ids=ids, tfs=tfs, dls=dls, cuts=cuts: (ids[cuts[r]], tfs[cuts[r]], dls[cuts[r]])))
        rows.append(dict(zip(ids.tolist(), share)))
    return out, rows


@pytest.mark.parametrize("needed", ([True, True, True], [False, False, False], [True, False, False], [False, False, True]))
def test_best_against_all_scores(needed):
    skipped = 0
    for seed in range(30):
        rng = np.random.default_rng(seed)
        lists, rows = lists_of(rng, 2000, 3)
        weights = [0.3, 1.5, 0.0 if needed[2] and not all(needed) else 2.0]
        scored = [w > 0 for w in weights]
        ids, scores = P.best_of_shard(lists, needed, weights, 30.0, 5)
        want = {}
        for i in set().union(*rows):
            must = all(i in r for r, n in zip(rows, needed) if n)
            if must and (all(needed) or any(i in r for r, n in zip(rows, needed) if not n)) and any(scored):
                want[i] = round(sum(w * r[i] for r, w in zip(rows, weights) if i in r), 6)
        best = sorted(want, key=lambda i: (-want[i], i))[:5]
        assert ids.tolist() == best and np.allclose(scores, [want[i] for i in best])
        skipped += sum(len(x.lo) - len(x.held) for x in lists)
    assert skipped > 20


def test_blocks_under_the_bar_are_not_decoded():
    ids, tfs = np.arange(16_000), np.ones(16_000, int)
    tfs[4992:5008] = 50
    share = tfs * 2.2 / (tfs + 1.2)
    cuts = [slice(i, i + 16) for i in range(0, 16_000, 16)]
    x = P.Postings(ids[::16], ids[15::16], np.array([share[c].max() for c in cuts]), np.arange(1000), lambda r: (ids[cuts[r]], tfs[cuts[r]], np.full(16, 30)))
    got, _ = P.best_of_shard([x], [True], [1.0], 30.0, 10)
    assert got.tolist() == list(range(4992, 5002)) and len(x.held) == 1


def plain(docs, queries, k, title=False, author=None):
    """Every passage scored for every query of single terms."""
    fields = {i: [x.lower().split() for x in (t, a, w)] for i, t, a, w in docs}
    lengths = {i: sum(map(len, f)) for i, f in fields.items()}
    mean, out = sum(lengths.values()) / len(lengths), set()
    held = {i: Counter(f[2] if title else f[0] + f[1] + f[2]) for i, f in fields.items()}
    for q, text in queries:
        terms = dict.fromkeys(text.lower().split())
        df = {t: sum(t in h for h in held.values()) for t in terms}
        scores = {}
        for i, t, a, w in docs:
            there = [x for x in terms if x in held[i]]
            if (there if title else len(there) == len(terms)) and (not title or not w.lower().startswith("commentary on ")) and (author is None or a.lower() == author):
                scores[i] = round(sum(max(log((len(docs) - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) * held[i][x] * 2.2 / (held[i][x] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for x in there), 6)
        out |= {(q, r + 1, i, scores[i]) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k])}
    return out


@pytest.mark.parametrize("block, shard, asked", ((4, 500, 2), (256, 1 << 22, 4096)))
def test_searches_against_all_scores(spark, monkeypatch, block, shard, asked):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("ASKED", asked)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(block)
    vocabulary = [f"t{i}" for i in range(25)]
    pick = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(1, 26)]) for _ in range(n))
    docs = [(i * 7, pick(rng.randrange(0, 30)), rng.choice(["A", "b b"]), rng.choice(["Commentary on t1", "t2 of t3", "t3"])) for i in range(120)]
    queries = [(i, pick(rng.randrange(1, 5))) for i in range(12)] + [(50, "nowhere t1"), (51, "t1 t1 t2")]
    index = S.store_index(spark.createDataFrame(docs, SCHEMA), Scratch(spark))
    asks = spark.createDataFrame(queries, "query_id long, query string")
    rows = lambda df: {tuple(r) for r in df.select("query_id", "rank", "id", "score").collect()}
    close = lambda a, b: {x[:3] for x in a} == {x[:3] for x in b} and all(abs(x[3] - dict(((q, r), s) for q, r, _, s in b)[x[0], x[1]]) < 2e-6 for x in a)
    assert close(rows(S.bm25_search(asks, index, 7)), plain(docs, queries, 7))
    assert close(rows(S.title_search(asks, index, 7)), plain(docs, queries, 7, title=True))
    by = asks.selectExpr("*", "'B B' as author")
    assert close(rows(S.bm25_search(by, index, 7)), plain(docs, queries, 7, author="b b"))
    assert index.blocks.where("n > 256 or size(ids) <> n or lo <> ids[0]").count() == 0


def test_nothing_to_find(spark):
    index = S.store_index(spark.createDataFrame([], SCHEMA), Scratch(spark))
    asks = spark.createDataFrame([(1, "word"), (2, ""), (3, None)], "query_id long, query string")
    assert S.bm25_search(asks, index).count() == 0 and S.title_search(asks, index).count() == 0
    one = S.store_index(spark.createDataFrame([(1, None, None, None), (2, "", "", "")], SCHEMA), Scratch(spark))
    assert S.bm25_search(asks, one).count() == 0 and S.bm25_search(asks.limit(0), one).count() == 0
