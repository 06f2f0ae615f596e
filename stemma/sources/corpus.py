"""The catalogue's tables as they are stored, with declared columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that every table has once it is loaded.
SCHEMAS = {
    "authors": "id long, name string, bio string, category string, tradition string, era string, born int, died int",
    "works": "id long, author_id long, title string, section string, source_url string",
    "passages": "id long, work_id long, header string, text string, source_title string, source_url string",
}


@dataclass(frozen=True)
class Corpus:
    authors: DataFrame
    works: DataFrame
    passages: DataFrame


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns in order and type, null where the table has none, then whatever else it has."""
    declared = StructType.fromDDL(schema)
    have = {c.lower(): c for c in df.columns}
    own = [(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    return df.select(*own, *(c for c in df.columns if c.lower() not in declared.names))


def load_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The tables of a folder (authors.parquet, works.parquet, passages.parquet); columns of later versions are added where a table lacks them."""
    return Corpus(**{name: with_columns(spark.read.parquet(f"{folder}/{name}.parquet"), schema) for name, schema in SCHEMAS.items()})
