"""Spelling variants: words one letter apart, found by equal pairs of nodes of a forward and a reversed trie."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import Scratch

#: Runs of letters, after A-Z are lower-cased.
RUN, OTHER = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Words that a task counts before it passes the counts on, and the length of text that is searched at once.
COUNTED, SPAN = 1 << 17, 1 << 20
#: Words of a part of a trie, about, and the bits of a number within a part.
PART, BITS = 1 << 16, 40


def runs(text: bytes) -> Iterator[list[str]]:
    """The runs of letters of a text, a bounded span at a time."""
    lowered = text.lower().decode()  # of bytes only A-Z are lower-cased
    at = 0
    while at < len(lowered):
        end = len(lowered) if len(lowered) - at <= SPAN else m.start() if (m := OTHER.search(lowered, at + SPAN)) else len(lowered)
        yield RUN.findall(lowered, at, end)
        at = end


def word_of(run: str, h: int, every: int) -> str:
    """A run, without one of its letters if ``every`` divides its draw h."""
    return run if h % every else run[: (i := h % len(run))] + run[i + 1 :]


def counted(docs: DataFrame, every: int, shortest: int, rarest: int) -> DataFrame:
    """word, n: the documents' words of ``shortest`` letters or more, with at least ``rarest`` occurrences; counts are summed in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found in runs(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    for w, n in Counter(w for w in found if len(w) >= shortest).items():
                        total[word_of(w, zlib.crc32(w.encode(), start), every)] += n
                    if len(total) >= COUNTED:
                        yield passed()
        if total:
            yield passed()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = source.mapInArrow(run, "word string, n long").where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def numbered(words: DataFrame, key: str, parts: int) -> DataFrame:
    """``words`` with part, place (its number in the key's order within its part) and nodes: the numbers of the trie nodes on the way of ``key``, from the root on.

    ``key`` is distinct. Parts are ranges of its order, between some keys drawn as borders. A node whose text begins a
    border can lie in several parts and is numbered by the borders alone, from 0; any other lies in one part and is numbered there
    in order of appearance. So each text of a node has one number and each number one text. A task keeps one path of the trie and the
    borders, no matter how many words come by.
    """
    borders = sorted(r[0] for r in words.orderBy(F.xxhash64(key), key).limit(parts - 1).select(key).collect())
    shared: dict[tuple[int, str], int] = {}
    for border in borders:
        node = 0
        for c in border:
            node = shared.setdefault((node, c), len(shared) + 1)
    names = words.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(borders, k) for k in b.column(names.index(key)).to_pylist()], pa.int64())], [*names, "part"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, count, at = -1, "", [0], 0, 0
        for b in batches:
            ways, places = [], []
            for k, p in zip(b.column(names.index(key)).to_pylist(), b.column(len(names)).to_pylist()):
                if p != part:
                    part, last, path, count, at = p, "", [0], 0, 0
                same = 0
                for x, y in zip(last, k):
                    if x != y:
                        break
                    same += 1
                del path[same + 1 :]
                for c in k[same:]:
                    node = shared.get((path[-1], c))
                    if node is None:
                        count += 1
                        node = (part + 1 << BITS) + count
                    path.append(node)
                last = k
                ways.append(path.copy()), places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array(ways, pa.list_(pa.int64()))], [*names, "part", "place", "nodes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", part long"
    sorted_parts = words.mapInArrow(place, schema).repartition(parts, "part").sortWithinPartitions("part", key)
    return sorted_parts.mapInArrow(walk, schema + ", place long, nodes array<long>")


def neighbours(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) with ids in the words' order, and (id, n_near, best) of those that have near words, best being the (-n, id) of the most frequent one.

    A word with a letter left out is a pair of nodes: that of what is before the letter in the forward trie, that of what is
    behind in the reversed one. Words with the same pair differ in that letter alone. A word with nothing left out is a pair at
    each of its places; whoever leaves out a letter there has one letter more. A pair is held by as many words as there are letters,
    at most, and by one whole word; each of them is told how many the others are and which is best, so that no pairs of words are made.
    Of a run of equal letters only the first is left out towards a shorter word, which is then met once.
    """
    parts = max(1, -(-words.count() // PART))
    forward = scratch.cut(numbered(words, "word", parts).withColumn("id", F.expr(f"shiftleft(part, {BITS}) + place")).drop("part", "place"))
    backward = numbered(forward.select("id", F.reverse("word").alias("drow")), "drow", parts).select("id", F.col("nodes").alias("back"))
    both = forward.join(backward.hint("merge"), "id")
    # place i: nodes[i] is what is before letter i (from 0), back[length - i - 1] what is behind it
    pairs = F.expr(
        "concat(transform(sequence(0, length(word) - 1), i -> struct(nodes[i] as p, back[length(word) - i - 1] as s, if(i > 0 and substr(word, i, 1) = substr(word, i + 1, 1), 1, 0) as kind)), "
        "transform(sequence(0, length(word)), i -> struct(nodes[i] as p, back[length(word) - i] as s, 2 as kind)))"
    )
    held = both.select("id", "n", F.explode(pairs).alias("at")).groupBy("at.p", "at.s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id", "at.kind"))).alias("all"))
    met = held.where("size(all) > 1").select(
        F.filter("all", lambda x: x.kind < 2).alias("out"), F.filter("all", lambda x: x.kind == 0).alias("first"), F.filter("all", lambda x: x.kind == 2).alias("whole")
    )
    brief = lambda x: F.struct(x.n.alias("n"), x.id.alias("id"))
    told = lambda x, n, best: F.struct(x.id.alias("id"), n.cast("long").alias("n_near"), brief(best).alias("best"))
    among = F.when(F.size("out") > 1, F.transform("out", lambda x: told(x, F.size("out") - 1, F.when(x.id == F.get("out", F.lit(0)).id, F.get("out", F.lit(1))).otherwise(F.get("out", F.lit(0))))))
    shorter = F.when((F.size("whole") > 0) & (F.size("first") > 0), F.transform("first", lambda x: told(x, F.lit(1), F.get("whole", F.lit(0)))))
    longer = F.when((F.size("whole") > 0) & (F.size("first") > 0), F.transform("whole", lambda x: told(x, F.size("first"), F.get("first", F.lit(0)))))
    none = F.expr("cast(array() as array<struct<id: bigint, n_near: bigint, best: struct<n: bigint, id: bigint>>>)")
    news = met.select(F.explode(F.concat(*(F.coalesce(x, none) for x in (among, shorter, longer)))).alias("t"))
    return forward.select("id", "word", "n"), news.groupBy("t.id").agg(F.sum("t.n_near").alias("n_near"), F.min("t.best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of (id, form): where the forms lead to in the end. Each round doubles the steps; forms grow in number, so that there is an end."""
    now = scratch.cut(links.select("id", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        done = scratch.cut(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = done
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def group_variants(docs: DataFrame, every: int = 97, shortest: int = 5, rarest: int = 3, times: int = 2) -> DataFrame:
    """word, n, form, form_n, root, n_near for every word of ``docs`` (doc_id, text) that is long and frequent enough.

    Words are maximal runs of Latin letters, of which only A-Z are lower-cased; where ``every`` divides the crc32 of the
    document's id, a colon and the run, a letter is missing. Two words are near if one inserted, deleted or replaced letter is all that
    parts them. A word's form is its most frequent near word (ties: the first in code-point order) if that one occurs ``times``
    times as often, else null; following forms leads to its root, the word itself if it has no form.

    Null and empty texts have no words; a row without an id draws as if its id were written as nothing. Repeated rows count
    each. Runs of any length are words. Other columns are not read, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words, near = neighbours(scratch.cut(counted(docs, every, shortest, rarest)), scratch)
    found = scratch.cut(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best.id")).alias("form")))
    links = found.where("form is not null")
    ends = links.select("id", "form").join(roots(links, scratch), "id")
    named = found.select("id", F.col("word").alias("text"), F.col("n").alias("form_n"))
    ends = ends.join(named.withColumnRenamed("id", "form"), "form").select("id", "root", F.col("text").alias("form_word"), "form_n")
    ends = ends.join(named.select(F.col("id").alias("root"), F.col("text").alias("root_word")), "root").select("id", "form_word", "form_n", "root_word")
    return found.join(ends, "id", "left").select("word", "n", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"), "n_near")
