"""Substring dedup: seeds from winnowed anchors, joined and extended both ways, merged into maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.expr import let
from stemma.session import Scratch

BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of every n consecutive values, built by doubling, then mixed."""
    acc, have, part, size, factor = None, 0, h, 1, base
    while True:
        if n & size:
            acc, have = (part, size) if acc is None else (acc[: len(h) - have - size + 1] * factor + part[have : len(h) - size + 1], have + size)
        if size * 2 > n:
            break
        part = part[: len(h) - 2 * size + 1] * factor + part[size : len(h) - size + 1]
        size, factor = size * 2, np.multiply(factor, factor)
    acc = acc ^ (acc >> np.uint64(31))
    acc = acc * np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(29))


def winnow(g: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the smallest of some ``span`` consecutive values (the first of equals)."""
    views = np.lib.stride_tricks.sliding_window_view(g, span)
    picked = [np.unique(views[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(views)))) for i in range(0, len(views), 65536)]
    return np.unique(np.concatenate(picked))


def ranges(froms: np.ndarray, tos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged [from, to) of ranges sorted by their starts; ranges that touch are one."""
    if not len(froms):
        return froms, tos
    ends = np.maximum.accumulate(tos)
    new = np.flatnonzero(froms[1:] > ends[:-1])
    return froms[np.r_[0, new + 1]], ends[np.r_[new, len(froms) - 1]]


def _text_words(text) -> list[bytes]:
    return text.as_py().encode().split() if text.is_valid else []


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("rid"), F.col("text").cast("string"))


def repeats(docs: DataFrame, span: int = 50, seed: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, rid, froms, tos): in each text, the maximal repeats of documents with a smaller doc_id. rid names a text of a doc_id.

    1. Seeds: every distinct text gives its winnowed anchors: of each ``span - seed + 1`` consecutive ``seed``-word grams the one with
       the smallest hash, so that equal runs of ``span`` words have the same anchor at the same place. Anchors of two documents or more are seeds.
    2. Join and extend: every occurrence of a seed is joined to the seed's first one (the smallest doc_id, then text and place), and
       the match is extended word by word to both sides, up to the words that a window with this seed can reach; a longer match
       goes on at the next seed. A match of ``span`` words or more is a repeat if its document comes later than the first.
    3. What does not equal the seed's first occurrence can still equal another one. Such windows reach over the word where their
       occurrence parts from the first, so only occurrences that part at the same place by the same word can share them: their
       windows over that word are compared among themselves, by 128-bit hashes, as a grouped minimum of doc_id. Windows
       inside a match need not be there, as whatever equals them equals the first occurrence too.
    4. Repeats of a document are merged into maximal ones, [from, to) in words.

    So every document meets one partner a seed, never each other, and a passage in thousands of documents costs as many
    rows as it has occurrences. A text that an earlier document has too is a copy and is settled by its hash alone.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    reach = span - seed

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids, spots, grams = [], [], [], []
            for text in b.column(2):
                words = _text_words(text)
                ids.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(len(words))
                at = g = np.empty(0, np.uint64)
                if len(words) >= span:
                    g = rolling(word_hashes(words), seed, BASE)
                    at = winnow(g, reach + 1)
                    g = g[at]
                spots.append(at.astype(np.int32)), grams.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), _lists(spots, pa.int32()), _lists(grams, pa.int64())], ["doc_id", "rid", "words_id", "n_words", "at", "gram"])

    source = rows_of(docs)
    marked = scratch.cut(source.mapInArrow(anchors, "doc_id long, rid long, words_id binary, n_words long, at array<int>, gram array<long>"))
    firsts = marked.where(f"n_words >= {span}").groupBy("words_id").agg(F.min("doc_id").alias("first"))
    known = scratch.cut(marked.where("doc_id is not null").select("doc_id", "rid", "words_id", "n_words").distinct().join(firsts, "words_id", "left").select("doc_id", "rid", "words_id", "n_words", F.expr("coalesce(first < doc_id, false)").alias("copy")))

    firsts = known.where(f"not copy and n_words >= {span}").select("doc_id", "rid")
    own = marked.select("doc_id", "rid", "at", "gram").join(firsts, ["doc_id", "rid"]).select("doc_id", "rid", F.explode(F.arrays_zip("at", "gram")).alias("a")).select("doc_id", "rid", "a.at", "a.gram")
    own = scratch.cut(own)
    # written, so that both sides of the join are dealt anew and a hot gram can be split
    shared = scratch.cut(own.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"))
    seeds = scratch.cut(own.join(shared, "gram").groupBy("doc_id", "rid").agg(F.collect_set("at").alias("seeds")))
    scratch.drop(own), scratch.drop(shared)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every seed of a text with the hashes of the words before it, nearest first, and after it."""
        names = ["doc_id", "rid", "at", "gram", "before", "after"]
        for b in batches:
            for i in range(b.num_rows):
                h = word_hashes(_text_words(b.column(2)[i]))
                if len(h) < span:
                    continue
                at = np.unique(np.asarray(b.column(3)[i].values))
                gram, signed = rolling(h, seed, BASE)[at], h.view(np.int64)
                before = [signed[max(0, p - reach) : p][::-1] for p in at]
                after = [signed[p + seed : p + span] for p in at]
                ids = [pa.array(np.full(len(at), b.column(c)[i].as_py()), pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), _lists(before, pa.int64()), _lists(after, pa.int64())], names)

    met = source.join(seeds, ["doc_id", "rid"]).select("doc_id", "rid", "text", "seeds")
    occurrences = scratch.cut(met.mapInArrow(sides, "doc_id long, rid long, at int, gram long, before array<long>, after array<long>"))
    scratch.drop(seeds)
    place = F.struct("doc_id", "rid", "at")
    first = occurrences.groupBy("gram").agg(F.min(F.struct("doc_id", "rid", "at", "before", "after")).alias("first"), F.count("*").alias("n"))
    first = scratch.cut(first.select("gram", "n", F.col("first.doc_id").alias("lo"), F.struct("first.doc_id", "first.rid", "first.at").alias("place"), F.col("first.before").alias("first_before"), F.col("first.after").alias("first_after")))
    equal = lambda side: f"array_position(zip_with({side}, first_{side}, (x, y) -> not (x <=> y) or x is null), true)"
    run = lambda side: F.expr(let("p", equal(side), f"int(if(p > 0, p - 1, least(size({side}), size(first_{side}))))"))
    pairs = occurrences.join(first, "gram").where(place != F.col("place"))
    pairs = pairs.select("doc_id", "rid", "at", "gram", "before", "after", "lo", "n", run("before").alias("left"), run("after").alias("right"))
    ends = "n < 3 or size(before) = left and size(after) = right"
    extended = scratch.cut(pairs.withColumn("before", F.expr(f"if({ends}, null, before)")).withColumn("after", F.expr("if(before is null, null, after)")))
    scratch.drop(occurrences), scratch.drop(first)
    matches = extended.where(f"doc_id > lo and left + right >= {reach}").select("doc_id", "rid", F.expr("at - left").alias("s"), F.expr(f"at + {seed} + right").alias("e"))

    # an occurrence that parts from the first one can equal others only beyond the word where it does: those that part there alike
    parting = "array(named_struct('side', 0, 'n', left, 'word', get(before, left)), named_struct('side', 1, 'n', right, 'word', get(after, right)))"
    parted = extended.where("before is not null").withColumn("p", F.explode(F.expr(parting))).where("p.word is not null").withColumn("key", F.xxhash64("gram", "p"))
    alike = scratch.cut(parted.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"))
    # windows with this seed start from at - size(before) to at + size(after) - reach; those with that word before or after the match are taken
    most, least = f"size(after) - {reach}", "-size(before)"
    starts = f"if(p.side = 0, if(-left - 1 < {least}, array(), sequence({least}, least(-left - 1, {most}))), if(right - {reach} + 1 > {most}, array(), sequence(greatest(right - {reach} + 1, {least}), {most})))"
    hashes = f"gram, o, slice(before, 1, -o), slice(after, 1, {reach} + o)"
    rest = parted.join(alike.hint("merge"), "key").select("doc_id", "rid", "at", "gram", "before", "after", F.explode(F.expr(starts)).alias("o"))
    windows = scratch.cut(rest.select("doc_id", "rid", F.expr("at + o").alias("s"), F.expr(f"xxhash64({hashes})").alias("h1"), F.expr(f"xxhash64('window', {hashes})").alias("h2")))
    earliest = scratch.cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"))
    others = windows.join(earliest, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "rid", "s", F.expr(f"s + {span}").alias("e"))
    found = scratch.cut(matches.union(others).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("parts")))
    scratch.drop(extended), scratch.drop(windows), scratch.drop(earliest)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [ranges(*(np.asarray(p.values.field(k)) for k in (0, 1))) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists([m[0] for m in merged], pa.int32()), _lists([m[1] for m in merged], pa.int32())], ["doc_id", "rid", "froms", "tos"])

    repeated = found.mapInArrow(merge, "doc_id long, rid long, froms array<int>, tos array<int>")
    whole = known.where("copy").select("doc_id", "rid", F.expr("array(0)").alias("froms"), F.expr("array(int(n_words))").alias("tos"))
    return repeated.union(whole)


def remove_repeats(docs: DataFrame, span: int = 50, seed: int = 16) -> DataFrame:
    """``docs`` (doc_id, text) without the words of maximal repeats: doc_id, n_words, n_removed, kept_text.

    A window of ``span`` consecutive words (runs without ASCII white space) is removed if the same words also start in a
    document with a smaller doc_id; kept_text joins the other words by one space. A null or empty text has no words and
    gives an empty kept_text. Repeated rows are judged each for itself; rows that share a doc_id never remove each
    other. A row with a null doc_id comes back whole. Other columns are not read. An empty table gives no rows.
    """
    found = repeats(docs, span, seed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, texts = [], [], []
            for text, froms, tos in zip(b.column(2), b.column(3), b.column(4)):
                words = _text_words(text)
                parts, at = [], 0
                for s, e in zip(froms.as_py() or (), tos.as_py() or ()):
                    parts += words[at:s]
                    at = e
                parts += words[at:]
                counts.append(len(words)), gone.append(len(words) - len(parts)), texts.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows_of(docs).join(found, ["doc_id", "rid"], "left").select("doc_id", "rid", "text", "froms", "tos").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
