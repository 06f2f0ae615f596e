"""SimHash groups and components against plain versions."""

import random
from itertools import combinations

import xxhash

from stemma.llm.components import components
from stemma.llm.simhash import fingerprint, links, signed, simhash_groups
from stemma.session import Scratch, table

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_groups(rows):
    fps = {d: plain_fingerprint(t) for d, t in rows}
    parent = {d: d for d in fps}
    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    return {(d, f"{fps[d]:016x}", find(parent, d)) for d in fps}


def test_components_of_chains_rings_and_stars(spark):
    rng = random.Random(3)
    edges = []
    for base, size in ((0, 60), (1000, 2), (2000, 40)):
        ids = [base + i for i in range(size)]
        rng.shuffle(ids)
        edges += list(zip(ids, ids[1:]))
    edges += [(3000, 3000 + i) for i in range(1, 30)] + [(5, 5), (None, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {n: n // 1000 * 1000 for e in edges if None not in e and e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_links_full_buckets_keep_every_close_pair(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << i) for i in range(12)} | {centre ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)} | {rng.getrandbits(64) for _ in range(50)}
    fps |= {(f ^ (1 << 63)) for f in list(fps)[:5]}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for bucket in (4, 1000):
        got = {(r.u % 2**64, r.v % 2**64) for r in links(df, Scratch(spark), bucket=bucket).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in got)
        joined = {r.node % 2**64: r.root for r in components(links(df, Scratch(spark), bucket=bucket), Scratch(spark)).collect()}
        for a, b in combinations(fps, 2):
            if (a ^ b).bit_count() <= 2:
                assert joined[a] == joined[b]


def test_groups_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in simhash_groups(docs).collect()} == plain_groups(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    long = "word " * 30000
    rows = [(4, None, "x"), (3, "", "x"), (9, " \t\n", None), (7, "A b C", "x"), (7, "A b C", "x"), (5, "a B c", "x"), (6, long, ""), (None, "a b c", ""), (8, "É é", "")]
    got = simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(got) == len(rows)
    assert {by[d].copy().pop()[1] for d in (3, 4, 9)} == {3} and by[3].copy().pop()[0] == "0" * 16
    assert {by[d].copy().pop()[1] for d in (5, 7, None)} == {5}
    assert by[6] == {(f"{plain_fingerprint(long):016x}", 6)}
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_keeps_other_letters():
    assert fingerprint("É a b c") != fingerprint("é a b c") == plain_fingerprint("é A B C")
