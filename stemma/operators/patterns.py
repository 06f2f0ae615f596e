"""Many patterns looked for in many texts: one automaton where the patterns are few enough, a join on their first letters beyond."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and characters of them that every task may hold as an automaton.
MOST, MOST_CHARS = 100_000, 2_000_000
#: Letters of a text by which what it holds is looked up beyond that.
GRAM = 4
#: The automaton of each list of patterns that a worker was sent.
_built: dict[str, ahocorasick.Automaton | None] = {}


def automaton(no: str, words: list[str]) -> ahocorasick.Automaton | None:
    """A worker's automaton of a list of patterns, built once; none for no patterns."""
    if no not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
        _built[no] = made if words else None
    return _built[no]


def scanned(texts: DataFrame, text: str, words: list[str], longest: bool) -> DataFrame:
    """Adds _p: the patterns in ``text``, each once; with ``longest`` only the longest and others as long."""
    names, no, sent = texts.columns, uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(no, sent.value)
        for b in batches:
            hits = []
            for t in b.column(names.index(text)).to_pylist():
                each = {w for _, w in found.iter(t)} if found and t else ()
                top = max(map(len, each), default=0) if longest else 0
                hits.append([w for w in each if len(w) >= top])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], [*names, "_p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", _p array<string>"
    return texts.mapInArrow(run, schema).withColumn("_p", F.explode("_p"))


def met_by_grams(texts: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """Adds _p: the patterns of ``words`` (_p) in ``text``. Both meet on a pattern's first letters, of which a text has one run at each place."""
    # an empty match at each place, so that a text is read once for each length
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, GRAM + 1))))
    left = texts.withColumn("_g", F.explode(grams))
    right = words.withColumn("_g", F.substring("_p", 1, GRAM))
    return left.join(right, "_g").where(F.contains(F.col(text), F.col("_p"))).drop("_g")


def holding(texts: DataFrame, text: str, parts: DataFrame, part: str, longest: bool = False, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """Pairs of rows where ``text`` of the one holds ``part`` of the other, in any case; with ``longest`` only those of each text's
    longest part, and of other parts as long.

    Up to ``most`` different parts of ``most_chars`` characters go to every task as an automaton, by which a text is read
    once, however many parts it holds; the sizes are counted before. More of them meet the texts by a join on their first letters, with the same rows.
    Null and empty texts hold nothing, null and
    empty parts are held by nothing, and repeated rows count each. Columns of both tables must have different names.
    """
    right = parts.withColumn("_p", F.lower(part)).where("_p <> ''")
    left = texts.withColumn("_t", F.lower(text))
    words = right.select("_p").distinct()
    size = words.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.length("_p")).alias("chars")).first()
    if size.n <= most and (size.chars or 0) <= most_chars:
        met = scanned(left, "_t", sorted(r[0] for r in words.collect()), longest)
    else:
        met = met_by_grams(left, "_t", words)
        if longest:
            met = met.withColumn("_r", F.rank().over(Window.partitionBy(*left.columns).orderBy(F.desc(F.length("_p"))))).where("_r = 1").drop("_r")
    return met.join(right, "_p").drop("_p", "_t")
