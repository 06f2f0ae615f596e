"""The embedding job: what is pending, texts, batches, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import strip_html


#: Rows that one task numbers.
SHARD_ROWS = 4096


def pending(passages: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    rest = passages.join(vectors.select(F.col("passage_id").alias("id")), "id", "left_anti").orderBy("id")
    return rest if limit is None else rest.limit(limit)


def prepare_texts(passages: DataFrame, most: int = 120_000, markup: bool = True) -> DataFrame:
    """(id, clean, tokens): plain texts cut at ``most`` characters with the estimate of their tokens; blank ones have an empty text."""
    rows = strip_html(passages, "text", "plain") if markup else passages.withColumn("plain", F.coalesce("text", F.lit("")))
    clean = F.regexp_replace(F.substring("plain", 1, most), r"(?U)^\s+|\s+$", "")
    return rows.select("id", clean.alias("clean")).withColumn("tokens", (F.floor(F.length("clean") / 3.0) + 1).cast("long"))


def pack_batches(texts: DataFrame, shards: int | None = None, most_tokens: int = 100_000, most_rows: int = 128) -> DataFrame:
    """(id, shard, batch, tokens): rows by id in batches of at most ``most_tokens`` and ``most_rows``, a blank one using a place but no
    batch, one row at least; every shard (id modulo their number) counts its own batches. Only ids and estimates travel. Without ``shards`` there are so many that one has
    about ``SHARD_ROWS`` rows at every size."""
    if shards is None:
        shards = max(1, -(-texts.count() // SHARD_ROWS))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        batch, window, used, held, out = 0, 0, 0, 0, []
        for tokens, blank in zip(g.tokens, g.blank):
            if window == most_rows or held and used + tokens > most_tokens:
                batch += held > 0
                window = used = held = 0
            window += 1
            out.append(None if blank else batch)
            if not blank:
                held += 1
                used += tokens
        return g.assign(batch=pd.array(out, "Int64"))[["id", "shard", "batch", "tokens"]].dropna()

    rows = texts.select("id", F.pmod("id", F.lit(shards).cast("long")).alias("shard"), "tokens", (F.col("clean") == "").alias("blank"))
    return rows.groupBy("shard").applyInPandas(run, "id long, shard long, batch long, tokens long")


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests: signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], vectors: DataFrame) -> DataFrame:
    """vectors (passage_id, embedding) and those of texts (id, clean) that have none yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b.clean.notna() & (b.clean != "")]  # here, as a filter before would clean every text twice
            yield pd.DataFrame({"passage_id": b.id, "embedding": list(encoder(b.clean.tolist()))})

    new = texts.join(vectors.select(F.col("passage_id").alias("id")), "id", "left_anti").select("id", "clean")
    return vectors.select("passage_id", "embedding").unionByName(new.mapInPandas(run, "passage_id long, embedding array<float>"))


def invalidate(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select(F.col("id").alias("passage_id")), "passage_id", "left_anti")
