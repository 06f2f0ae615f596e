"""Spelling variants against all one-letter edits of every word."""

import random
import re
import zlib
from collections import Counter

from stemma.llm import variants as V

SCHEMA = "doc_id long, text string, word string, n long"


def plain(rows, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = {c for w in words for c in w}
    form, near = {}, {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        met = [x for x in edits - {w} if x in words]
        best = min(met, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(met), best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, form[w] or "", words.get(form[w], 0), root(w), near[w]) for w, n in words.items())


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    return sorted((r.word, r.n, r.form or "", r.form_n or 0, r.root, r.n_near) for r in V.group_variants(df, **more).collect())


def corpus(seed, letters="abÀÿ", n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
    pool = [word() for _ in range(80)]
    return [(i, " ".join(w if rng.random() < 0.8 else w[:k] + rng.choice(letters) + w[k + rng.randrange(2) :] for w in (rng.choice(pool) for _ in range(80)) for k in [rng.randrange(len(w))])) for i in range(n)]


def test_against_all_edits(spark):
    for seed, letters in ((1, "abÀÿ"), (2, "aA"), (3, "abcdefgh")):
        rows = corpus(seed, letters)
        want = plain(rows)
        assert found(spark, rows) == want and any(w[2] for w in want)


def test_tries_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 9)
    monkeypatch.setattr(V, "COUNTED", 16)
    rows = corpus(7)
    assert found(spark, rows) == plain(rows)


def test_numbers_name_texts(spark, monkeypatch):
    """A node's number stands for one beginning in all parts, and each beginning has one number."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(400)})
    rows = V.numbered(spark.createDataFrame([(w,) for w in words], "word string"), "word", 13).collect()
    texts, numbers = {}, {}
    for r in rows:
        for i, node in enumerate(r.nodes):
            assert texts.setdefault(node, r.word[:i]) == r.word[:i] and numbers.setdefault(r.word[:i], node) == node
    assert [r.word for r in sorted(rows, key=lambda r: (r.part, r.place))] == words and len({r.part for r in rows}) > 5


def test_chains_of_forms(spark):
    chain = [("aaaaa" + "b" * i, 3 * 2 ** (6 - i)) for i in range(7)]
    rows = [(1, " ".join(f"{w} " * n for w, n in chain))]
    got = {r[0]: r for r in found(spark, rows, every=1 << 40)}
    assert all(got[w][4] == "aaaaa" for w, _ in chain) and got["aaaaabb"][2] == "aaaaab" and got["aaaaa"][2] == ""


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(V, "SPAN", 50)
    long = "ab" * 20_000
    rows = [(1, None), (2, ""), (None, "Straße STRASSE straSSe strasse " * 3), (3, f"{long} {long}x " * 4), (3, f"{long} {long}x " * 4), (4, "...\n\t123"), (5, "É école ecole École écoLe ÉCOLE " * 4), (6, "aaaaa aaaaaa aaaaaaa " * 5)]
    got = found(spark, rows)
    assert [g for g in got if not g[0].startswith("abab")] == plain([r for r in rows if r[0] != 3])
    assert [g[5] for g in got if g[0].startswith("abab")] == [1, 1]
    assert found(spark, []) == [] and found(spark, [(1, "one two")]) == []
