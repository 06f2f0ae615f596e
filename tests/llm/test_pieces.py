"""SentencePiece ids and texts against the library."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stemma.llm.pieces import MODEL, Encoder, decode, encode, processor

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def own():
    return Encoder(MODEL)


def odd(rng):
    parts = ["▁", " ", "  ", "a", "b", "é", "\n", "\t", "\r", "the", "ing", "的", "中", "🙂", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "1", "22", " 2024", "'", "é", "ß", "Ω", "привет", "한국", "　", "▁" * 11, " " * 40]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))


def test_texts_and_odd_texts(own):
    sp, rng = processor(MODEL), random.Random(3)
    pieces = list(own.ids)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    texts += [odd(rng) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(20)) for _ in range(1000)]
    texts += ["".join(rng.choice(pieces) for _ in range(6)).replace("▁", " ") for _ in range(4000)]
    assert [own.encode(sp.normalize(t)).tolist() for t in texts] == sp.encode(texts)


def test_every_prefix_has_the_last_token_of_its_own_encoding(own):
    sp, rng = processor(MODEL), random.Random(4)
    for _ in range(200):
        text = sp.normalize(odd(rng))
        last = own.last_tokens(text)
        for n in range(1, len(text) + 1):
            if last[n] >= 0:
                assert own.packed(text[:n])[-4:] == last[n].to_bytes(4, "little")
    # merging the whole text plainly gives the same, wherever all characters have pieces
    known = {c for p in own.ids for c in p}
    for _ in range(300):
        text = "".join(c for c in sp.normalize(odd(rng)) if c in known)
        assert own.packed(text) == b"".join(i.to_bytes(4, "little") for i in own.merged(text))


@pytest.mark.parametrize("text", ("a" * 100_000, "ab" * 50_000, " " * 100_001, "word" * 40_000, "é" * 50_000, "one two\n" * 200_000, "\n" * 50_000))
def test_long_texts(own, text):
    sp = processor(MODEL)
    assert own.encode(sp.normalize(text)).tolist() == sp.encode(text)


def test_rows(spark):
    rows = [(1, "Some words\nof  two lines "), (2, ""), (3, None), (None, "x"), (1, "Some words\nof  two lines "), (4, "\x00▁ 🙂"), (5, "many words " * 150_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = decode(encode(df)).select("doc_id", "ids", "text").collect()
    sp = processor(MODEL)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = [(i, ids := sp.encode(t or ""), sp.decode(ids) if ids else "") for i, t in rows]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert encode(df.limit(0)).count() == 0 and decode(encode(df.limit(0))).count() == 0
    nothing = decode(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))).select("text").distinct().collect()
    assert [r.text for r in nothing] == [""]
