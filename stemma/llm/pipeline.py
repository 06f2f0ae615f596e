"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each over all that the one before kept.

Every stage takes documents (doc_id, text, lang, source, n_chars, all of which can be null; other columns are not read) and
gives rows of the same columns, but for the last. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.lines import dedup_lines
from stemma.llm.mixing import mix
from stemma.llm.packing import pack
from stemma.llm.quality_rules import judge
from stemma.llm.simhash import representatives
from stemma.session import Scratch, freed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text goes, as all under 50 words do. A text in a language without a reference, or without a language, goes
    by the base rules alone. Rows without an id, and repeated rows, are judged each for itself, so equal rows stay or go together.
    """
    return judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines in three-line windows that occur before, and with the length of what stays in n_chars.

    A null text stays null, a text whose lines all go becomes empty; no row goes. Rows without an id come first in order; equal
    rows, and rows with the same id and text, count as one and stay alike.
    """
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id.

    A null doc_id comes after all others, so that a text without an id stays if none of its group has one. Rows that repeat
    a doc_id are judged by their texts: of equal rows, and of near copies under one doc_id, one stays (the smallest row key);
    texts of different groups all stay. All texts without words, nulls included, are one group with what is near fingerprint zero.
    """
    keyed = docs.select(*COLUMNS).withColumn("rid", F.md5(F.to_json(F.struct(*COLUMNS))))
    kept = keyed.join(representatives(keyed).hint("merge"), "rid", "left_semi")
    return kept.dropDuplicates(["rid"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Texts without words, nulls included, are not taken. A null source is a source of its own. Rows without an id and repeated
    rows are taken each for itself.
    """
    mixed = mix(docs.select(*COLUMNS), keep=COLUMNS).withColumn("copies", F.expr("if(size = 0, 0, cast(taken div size as int))"))
    return mixed.where("copies > 0").withColumn("copy", F.expr("explode(sequence(1, copies))")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens.

    A null or empty text is its end id alone; rows without an id, and repeated rows, are packed each.
    """
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Fingerprints by XXH64 and packing are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next one reads them, and its own tables freed."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with freed():
            kept = scratch.cut(stage(spark, docs, sf_dir))
        if hasattr(docs, "_scratch"):
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
