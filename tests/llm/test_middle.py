"""Fill-in-middle against a plain version, the tree at every unit and block size, and odd input."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stemma.llm.middle import Units, fill_in_middle, restored

SCHEMA = "doc_id long, text string, output string, form string, n long"


def plain(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n):
    parts = ["a", "é", "😀", "\n", "\n\n", "\r\n", "line of words", " ", "<", "<S", "S>", "P", "\x00", "中文\n", "x" * 900]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", (1, 2, 3, 7, 64))
def test_every_cut(block):
    for text in [*texts(random.Random(block), 12), "", "\n", "x", "\n\n\n"]:
        units, data = re.findall(r"[^\n]*\n|[^\n]+", text), text.encode()
        tree = Units(data, block)
        assert tree.count == len(units)
        for n in range(len(units) + 1):
            head = "".join(units[:n])
            assert tree.cut(n) == (len(head.encode()), len(head))


@pytest.mark.parametrize("rate, spm", ((100, 50), (30, 50), (100, 0), (0, 100)))
def test_forms_against_the_plain_version(spark, rate, spm):
    rows = list(enumerate(texts(random.Random(5), 300))) + [(400, "a <P> b\nc"), (401, "<M>"), (402, "x\ny<S>"), (403, None), (404, ""), (None, "one\ntwo\n"), (None, None), (405, "line\n" * 200_000), (3, "one\ntwo"), (3, "one\ntwo")]
    df = spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], SCHEMA)
    got = fill_in_middle(df, rate, spm).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got], key=key) == sorted([(i, *plain(i, t or "", rate, spm), t or "") for i, t in rows], key=key)


def test_no_rows(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
