"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stemma.llm.lines import dedup_lines
from stemma.llm.mixing import mix
from stemma.llm.nbsvm import Features, classify, dual_descent
from stemma.llm.packing import first_fit_decreasing, pack, token_ids
from stemma.llm.passages import remove_repeats, rolling, winnow
from stemma.llm.quality_rules import judge
from stemma.llm.secrets import find_secrets
from stemma.llm.topk import Lists, nearest, top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)


# secrets


def spans(spark, *texts):
    rows = find_secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [r.spans for r in rows]


def test_secret_spans(spark):
    key = "AKIA" + "Z9" * 8
    assert spans(spark, f"é😀 PassWord = 'hunter22' {key} x", "token=abc", "a" * 24, "password=token:abcdefgh") == ["assign:3:23,access:25:45", "", "hex:0:24", ""]
    assert spans(spark, "API_KEY : zz-zz_zz", "apikey\"=\"123456") == ["assign:0:18", "assign:0:15"]


def test_weak_parts_need_each_other(spark):
    mixed, far = "Ab1" * 8, " " * 400
    together = f"user: bob see https://db.example/x key {mixed}"
    a = together.index("https"), together.index(mixed)
    assert spans(spark, together)[0] == f"ident:0:9,endpoint:{a[0]}:{a[0] + 20},secret:{a[1]}:{a[1] + 24}"
    assert spans(spark, f"key {mixed} only", "user: bob only", f"user: bob{far}{mixed}", "see https://db.example/x") == ["", "", "", ""]


def test_many_matches_of_one_text(spark):
    """Places after more matches than one run holds, strong spans over weak ones, against Python's own matches."""
    import re

    text = "".join(f"é{'Ab1' * 7}-{i} token=abc{i % 1000:03d} {'0f' * 12} " for i in range(1500))
    want = [(m.start(), "assign", m.end()) for m in re.finditer(r"token=[A-Za-z0-9+/_.=-]{6,}", text)] + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    got = find_secrets(docs(spark, [(1, text, "s"), (None, text, "s"), (None, "user: bob " + "Ab1" * 8, "s")])).collect()
    assert all(r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want)) for r in got if r.n_hex) and sum(r.n_hex for r in got) == 3000
    assert [r.spans for r in got if not r.n_hex] == ["ident:0:9,secret:10:34"]


def test_secret_edges(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "token=abcdef", "s"), (3, "token=abcdef", "s"), (3, "token=abcdef", "s"), (4, "token=abcdef " * 3000, None)]
    got = find_secrets(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in got if r.doc_id in (1, 2))
    assert [r.n_assign for r in got if r.doc_id == 3] == [1, 1] and [r.n_assign for r in got if r.doc_id == 4] == [3000]
    assert find_secrets(docs(spark, [])).count() == 0


# passages


def test_rolling_and_winnow():
    h = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    for n in (1, 2, 3, 16, 50, 299, 300):
        r = rolling(h, n, np.uint64(0x9E3779B97F4A7C15))
        assert len(r) == 301 - n and (rolling(h[5:], n, np.uint64(0x9E3779B97F4A7C15)) == r[5:]).all() if n < 200 else len(r) == 301 - n
    at = winnow(h, 35)
    assert all(((at >= i) & (at < i + 35)).any() for i in range(len(h) - 34))


def plain_removed(rows, span):
    words = [(d, (t or "").encode().split()) for d, t, _ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, d), d) if d is not None else first.get(k, 1 << 60)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_repeats_against_all_windows(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 120, 300)]
    rows = [(d, " ".join([word() for _ in range(rng.randrange(80))] + rng.choice(shared) + [word() for _ in range(rng.randrange(60))] + rng.choice(shared)[: rng.randrange(20, 320)]), "s") for d in range(40)]
    rows += [(90, rows[3][1], "s"), (91, rows[3][1], "s"), (2, rows[3][1], "s"), (92, None, "s"), (93, "", "s"), (94, "x " * 200, "s"), (95, "x " * 170, "s"), (90, rows[3][1], "s"), (96, "long " * 40000, "s")]
    assert sorted(map(tuple, remove_repeats(docs(spark, rows)).collect()), key=repr) == plain_removed(rows, 50)


def test_repeats_edges(spark):
    rows = [(None, "a b " * 40, "s"), (5, "a b " * 40, "s"), (6, "a b " * 40, "s")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs(spark, rows)).collect()}
    assert got == {None: 0, 5: 0, 6: 80}
    assert remove_repeats(docs(spark, [])).count() == 0


# packing


def test_token_ids_are_the_tokenizers_own(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["", " ", "It's  a\n\ntest\t é😀 don't 12345", f"{end} x", f"x {end}", f"a{end}{end} b", end, f" {end} \n{end}", end[:-1] + end, f"don{end}'t", "\u3000\x00\x85 a\u200b"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    # every character beside letters, digits, spaces and signs, so that both libraries cut all texts alike
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}1{c}{c} {c}.{c}\n" for c in signs[k : k + 4096]) for k in range(0, len(signs), 4096)]
    assert [k for k, x in enumerate(texts) if token_ids(x).tolist() != t.encode(x, add_special_tokens=False).ids + [0]] == []


def test_first_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        lengths = rng.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            b = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= lengths[i]
        assert [(bins[i], offsets[i]) for i in range(n)] == [want[i] for i in range(n)]


def test_packing_is_an_exact_round_trip(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "word " * 3000, "s"), (4, "tie", "s"), (5, "tie", "s"), (4, "tie", "s"), (None, "no id", "s"), (6, "a<|endoftext|>b", "s"), (7, "x" * 8 * 1023, "s")] + [(i, f"text {i} " * (i % 37), "s") for i in range(10, 90)]
    got = pack(docs(spark, rows), group=40).collect()
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for d, text, _ in rows:
        ids = token_ids(text)
        copies = sum(1 for x in rows if x[0] == d)
        mine = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) * copies
        for r in mine:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert pack(docs(spark, [])).count() == 0


# quality rules


def test_quality_edges(spark):
    prose = "the cat and the dog went to a house in the town that it was for the man of the sea. " * 1
    varied = " ".join(f"{w}{i}" if i % 3 else w for i, w in enumerate((prose * 12).split()))
    rows = [(1, None, "s"), (2, "", "s"), (3, "too short", "s"), (4, varied, "s"), (4, varied, "s"), (5, "same words here " * 40, "s"), (6, "#$%&|<>* " * 900, "s"), (7, varied.upper() * 400, "s")]
    got = judge(docs(spark, rows).selectExpr("*", "1 AS kept", "2 AS n_words")).collect()
    assert len(got) == len(rows) and len(got[0].asDict()) == len(got[0])
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].kept and not by[4].base_failed and by[5].base_failed and by[5].n_repeat_words == 120
    assert by[6].n_symbols == 7200 and not by[6].kept
    assert judge(docs(spark, [])).count() == 0
    assert not judge(docs(spark, [(1, varied, "s")]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).first().base_failed


def test_languages_without_a_reference_fall_to_the_base_rules(spark):
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    alphabets = {"ru": "абвгдежзийклмнопрстуфхцчшщ", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "zh": "的一是不了人我在有他这中大来上", "hi": "कखगघचछजझटठडढतथदधनपफबभमयरलव"}
    english = ["the", "of", "and", "to", "in", "that", "was", "it", "for", "on"]
    prose = lambda n: " ".join(rng.choice(english) if rng.random() < 0.4 else text("abcdefghilmnoprstu", 1) for _ in range(n))
    rows = [(i, prose(n), "en") for i, n in enumerate([60, 90, 150, 199, 200, 400] * 5)]
    rows += [(100 + 10 * k + j, text(a, n), lang) for k, (lang, a) in enumerate(alphabets.items()) for j, n in enumerate((60, 120, 199, 260))]
    rows += [(200 + j, text(alphabets["ru"], n), None) for j, n in enumerate((60, 260))] + [(300 + j, "\u0301".join(text("ABC#$%&", n)), "en") for j, n in enumerate((60, 150, 260))]
    df = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], DOCS)
    got = {r.doc_id: r for r in judge(df).collect()}
    assert all(got[d].kept for d in got if d < 300) and not any(got[d].kept for d in got if d >= 300)
    assert all((got[d].js_words is None) == (d >= 100 and d < 300) for d in got)
    # letters without case count as letters, in the declared language of a reference too
    mixed = judge(spark.createDataFrame([(d, t, "en", "s", 0) for d, t, _ in rows if d < 130], DOCS)).where("doc_id < 100 and not kept").count()
    assert mixed == 0


def test_repeat_words_by_hand(spark):
    text = "a b c d a b c x y z a b c\n\na b\n a b\na b"
    r = judge(docs(spark, [(1, text, "s")])).first()
    w = text.split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    assert r.n_repeat_words == len({i + o for i, t in enumerate(tri) if tri.count(t) > 1 for o in range(3)})
    assert r.n_dup_lines == 1 and r.word_chars == len("".join(w))


# mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "é", None, "z"])) for i in range(400)] + [(900, None, "a"), (901, "", None), (902, "w " * 30, "only"), (902, "w " * 30, "only")]
    df = docs(spark, rows).selectExpr("*", "0 AS taken", "1 AS whole", "2 AS s2", "3 AS extra")
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(mix(df).collect(), key=repr) == sorted(got, key=repr)
    total = sum(r.size for r in got)
    sums = {}
    for r in got:
        assert r.taken <= 2 * r.size
        s = sums.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert abs(sum(s[1] for s in sums.values()) - 1.5 * total) < 1e-6 * total
    assert all(s[1] <= 2 * s[2] + 1e-9 for s in sums.values()) and all(abs(s[0] - s[1]) <= 30 for s in sums.values())
    assert mix(docs(spark, [])).count() == 0
    only = mix(df, keep=("doc_id", "text")).collect()
    assert only[0].asDict().keys() == {"doc_id", "text", "size", "source_size", "target", "taken"} and sorted((r.doc_id, r.taken) for r in only) == sorted((r.doc_id, r.taken) for r in got)
    assert mix(docs(spark, [(1, None, "a"), (2, "", None)])).where("taken <> 0 or target <> 0").count() == 0


def test_equal_rows_at_the_limit_are_taken_one_by_one(spark):
    rows = [(7, "w " * 50, "a")] * 60 + [(None, "v " * 40, "b")] * 30 + [(None, "u " * 40, "b")] * 30 + [(8, "w " * 50, "c")] * 60
    got = mix(docs(spark, rows)).collect()
    for source, size in (("a", 50), ("b", 40), ("c", 50)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2 and all(r.taken <= 2 * r.size for r in mine)


def test_inclusion_rates_follow_their_probabilities(spark):
    rows = [(i, "w " * (10 + 10 * (i % 4)), "abc"[i % 3]) for i in range(1200)]
    got = [r for seed in range(3) for r in mix(docs(spark, rows), seed=f"s{seed}", keep=("doc_id", "source")).collect()]
    for source in "abc":
        mine = [r for r in got if r.source == source]
        whole = int(mine[0].target // mine[0].source_size)
        left, low, high = mine[0].target - whole * mine[0].source_size, 0.0, 1.0
        for _ in range(60):  # the rate that makes what is left of the target expected, by bisection
            rate = (low + high) / 2
            low, high = (rate, high) if sum(min(1, rate * r.size) * r.size for r in mine) < 3 * left else (low, rate)
        for size in {r.size for r in mine}:
            of_size = [r.taken / r.size - whole for r in mine if r.size == size]
            chance = min(1, rate * size)
            assert abs(sum(of_size) / len(of_size) - chance) < 4 * (chance * (1 - chance) / len(of_size)) ** 0.5 + 0.02


# top-k


def test_topk_edges_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (20, [0.3, 0.2]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.1]), (8, [1.0, -0.5]), (8, [1.0, -0.5]), (None, [1.0, 1.0]), (40, [1e30, 1e30]), (60, [0.5])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = top_k(df, df.where("vec_id % 20 = 0"), 3, block=3)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by[0])[1:] == [(2, 1, 64 * 64 + 32 * 32), (3, 2, 64 * 64 + 32 * 32)] and sorted(by[0])[0][1] == 40
    assert sorted(by[60]) == [(1, 7, 6 * 32)] and set(by) == {0, 20, 40, 60}
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 0.2, (300, 12))
    v[50:120] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    z = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    want = set()
    for q in range(0, 300, 20):
        s = z @ z[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        want |= {(q, r + 1, i, int(s[i])) for r, i in enumerate(best)}
    assert {tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), block=64).collect()} == want


def test_topk_of_repeated_ids_and_rows(spark):
    """Rows of the query's id are no candidates whatever their vectors; repeated rows are candidates each."""
    rows = [(20, [float(9 - i), 0.0]) for i in range(6)] + [(i, [0.1 * i, 0.0]) for i in range(1, 5)] + [(3, [0.3, 0.0])] * 2 + [(20, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id = 20"), 3, block=4).collect()
    assert len(got) == 6 * 3 and all([x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.rank == r] == [v] * 6 for r, v in ((1, 4), (2, 3), (3, 3)))


def test_topk_of_numbers_beyond_floats(spark):
    big = 2.0**24
    rows = [(0, [big, 1.0, big])] + [(i, [big, float(i), -big + i % 3]) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = [[int(64 * v) for v in x] for _, x in rows]
    scores = [sum(a * b for a, b in zip(z[0], x)) for x in z]
    want = [(i, scores[i]) for i in sorted(range(1, 120), key=lambda i: (-scores[i], i))[:5]]
    assert [(r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()] == want


def clean_or_zero(read, lists, depth, up, kind, q):
    """The tables of spoilt lists for the side that a query reads, and whatever for the other."""
    mine = (q > 0) == up
    n = lists.order.shape[1]
    part = slice(n - depth, n) if up else slice(0, depth)
    spoilt = read.__self__
    whole = Lists.__new__(Lists)
    whole.order, whole.values = (np.where(mine[:, None], a, b) for a, b in ((spoilt.order, lists.order), (spoilt.values, lists.values)))
    whole.low, whole.high = lists.low, lists.high
    assert (whole.order[:, part] < n).all()  # nothing spoilt is read
    return Lists.read(whole, depth, up, kind)


def test_lists_are_read_only_as_far_as_the_bounds_need():
    """Nothing beyond the depth is looked at: with all that spoilt, the answers are the same."""
    rng = np.random.default_rng(5)
    x = np.floor(np.abs(rng.pareto(1.5, (4000, 6))) * 8)  # few rows are high in any list
    clustered = np.floor(rng.normal(0, 12, (40, 32))[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 32)))
    depths, ids, none = [], np.arange(4000), np.full(1, -np.inf)
    for rows, few in ((x, 64), (x[:, :2] - 4, 64), (clustered, 16)):
        lists = Lists(rows, ids)
        for i in range(0, 4000, 200):
            q = rows[i] * (-1.0) ** np.arange(2) if rows.shape[1] == 2 else rows[i]
            first = lists.first
            ((left, scores, depth),) = nearest(lists, q[None], 20, ids[i : i + 1], none, few)
            products = rows @ q
            products[i] = -np.inf
            best = np.lexsort((ids, -products))[:20]
            assert set(best) <= set(left) and (products[left] == scores).all()
            spoilt = Lists(rows, ids)
            spoilt.first = first
            for c in range(rows.shape[1]):
                unread = slice(0, 4000 - depth) if q[c] > 0 else slice(depth, 4000)
                if q[c]:
                    spoilt.order[c, unread], spoilt.values[c, unread] = 10**9, np.nan
            clean = spoilt.read
            # the side of a list that a query does not read from is not its business
            spoilt.read = lambda d, up, kind: tuple(np.where((q > 0)[:, None] == up, t, 0) for t in clean_or_zero(clean, lists, d, up, kind, q))  # noqa: B023
            ((rows_again, scores_again, depth_again),) = nearest(spoilt, q[None], 20, ids[i : i + 1], none, few)
            assert (rows_again == left).all() and (scores_again == scores).all() and depth_again == depth
            depths.append(depth)
    assert sum(d <= 1000 for d in depths) > 10 and max(depths) <= 4000


def test_many_queries_read_together():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 9, (700, 10)))
    lists = Lists(x, np.arange(700) % 350)
    found = nearest(lists, x[:90], 5, np.arange(90) % 350, np.full(90, -np.inf))
    for i, (rows, scores, depth) in enumerate(found):
        products = np.where(np.arange(700) % 350 == i, -np.inf, x @ x[i])
        best = np.sort(products)[::-1][:5]
        assert (np.sort(scores)[::-1][:5] == best).all() and (products[rows] == scores).all() and 0 < depth <= 700


def test_a_bar_from_before_and_lists_of_one_row():
    lists, q, none = Lists(np.array([[3.0, -1.0]]), np.array([7])), np.array([[2.0, 5.0]]), np.array([-np.inf])
    assert [a.tolist() for a in nearest(lists, q, 20, np.array([0]), none)[0][:2]] == [[0], [1.0]]
    assert nearest(lists, q, 20, np.array([7]), none)[0][0].tolist() == []
    assert nearest(lists, q, 1, np.array([0]), np.array([2.0]))[0][0].tolist() == []


# lines


def test_line_windows(spark):
    rows = [(1, "a\nb\nc\nd", "s"), (2, "x\na\nb\n\nc\ny", "s"), (3, "a\nb", "s"), (4, None, "s"), (5, "", "s"), (6, "q\nq\nq\nq\nq", "s"), (7, "b\nc\nd\ne", "s"), (7, "b\nc\nd\ne", "s"), (8, "z\n" * 20000, "s")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs(spark, rows).selectExpr("*", "5 AS n_removed", "6 AS gone", "7 AS rid")).collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0) and got[2] == ("x\n\ny", 6, 3) and got[3] == ("a\nb", 2, 0)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("q", 5, 4) and got[7] == ("e", 4, 3) and got[8][2] == 19999
    assert dedup_lines(docs(spark, [])).count() == 0


# classifier


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(300) < 0.3, 1.0, -1.0)
    rows = [np.array([0 if v > 0 else 1, 2 + rng.integers(20)]) for v in y]
    w = dual_descent(rows, [np.array([1.0, 0.3])] * 300, y, 22, 1.0, 30)
    assert all(np.sign(w[r] @ np.array([1.0, 0.3]) + w[-1]) == v for r, v in zip(rows, y))


def test_classifier_holds_out_and_handles_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    extra = docs(spark, [(10**9, None, "s"), (10**9 + 1, "", "s"), (None, "text", "s"), (10**9 + 2, "word " * 50000, "s"), (10**9 + 2, "word " * 50000, "s")])
    odd = labels.union(spark.createDataFrame([(None, 1), (5, None), (10**10, 0)], "doc_id long, label int"))
    got = classify(df.unionByName(extra), odd).toPandas()
    assert len(got) == 1005 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    real = got[got.doc_id < 10**9]
    assert (real.held_out == [zlib.crc32(str(int(d)).encode()) % 4 == 2 for d in real.doc_id]).all()
    both = real.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.label).mean() > 0.93
    assert got[got.doc_id == 10**9 + 2].score.nunique() == 1
    assert classify(docs(spark, []), labels).count() == 0
    assert set(classify(df.limit(5), labels.limit(0)).toPandas().score) == {0.5}


def test_features_of_nothing():
    assert len(Features(18)(None)) == len(Features(18)(" \n")) == 0
