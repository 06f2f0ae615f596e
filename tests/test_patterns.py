"""Patterns found in texts by the automaton and, beyond its bounds, by first letters: both against every pair."""

import random

from stemma.operators.patterns import holding


def test_pairs_are_those_of_every_pair(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abAB é") for _ in range(rng.randrange(most)))
    parts = [(i, word(7)) for i in range(150)] + [(150, None), (151, ""), (152, "a"), (153, "A"), (0, "ab"), (0, "ab")]
    texts = [(i, word(30)) for i in range(60)] + [(60, None), (61, ""), (62, "ab " * 5_000), (62, "ab " * 5_000)]
    t, p = spark.createDataFrame(texts, "tid int, body string"), spark.createDataFrame(parts, "pid int, name string")
    every = [(i, t, j, n) for i, t in texts for j, n in parts if t and n and n.lower() in t.lower()]
    top = {t: max(len(x[3]) for x in every if x[1] == t) for t in {x[1] for x in every}}
    for longest, want in ((False, every), (True, [x for x in every if len(x[3]) == top[x[1]]])):
        for most, chars in ((1000, 10_000), (3, 10_000)):
            got = holding(t, "body", p, "name", longest, most, chars)
            assert sorted((r.tid, r.body, r.pid, r.name) for r in got.collect()) == sorted(want)
    assert holding(t, "body", p.limit(0), "name").count() == 0 and holding(t.limit(0), "body", p, "name").count() == 0
