"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import Scratch

#: Name of the public vocabulary: NAME.json for its added tokens, NAME.tiktoken for its ranks.
VOCABULARY = "byte_bpe_50k"


@lru_cache(1)
def encoder(name: str):
    """The vocabulary's byte-pair encoder with the added tokens that its file declares."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """The ids of a text, then the end id 0. An added token in the text is its own id, as the vocabulary's file says."""
    return np.array([*encoder(name).encode(text or "", allowed_special="all"), 0], "<u4")


def pieces(docs: DataFrame, size: int = 1024, name: str = VOCABULARY) -> DataFrame:
    """Documents as runs of up to ``size`` ids: all but a document's last piece are full. ``at`` numbers the rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            rows = []
            for at, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = token_ids(text.as_py(), name)
                rows += [(at, doc, s, len(p := ids[s : s + size]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), size)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    source = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "at long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken from the longest down, each into the first bin that has room.

    The bins are the leaves of a tournament tree whose inner nodes hold the largest free room below, so the first bin with
    room is found by one walk from the root.
    """
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [size] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[i]), 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        bins[i], offsets[i] = node - leaves, size - room[node]
        room[node] -= need
        while node > 1:
            node >>= 1
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, size: int = 1024, group: int = 16384, seed: int = 7, name: str = VOCABULARY) -> DataFrame:
    """All ids of ``docs`` (doc_id, text) in sequences of up to ``size``: one row per piece, with its sequence and offset.

    A document's ids are cut at multiples of ``size``. A full piece is a sequence of its own, which is what first-fit decreasing
    makes of it. What is left of a document is one shorter piece at most: documents go to random groups of about ``group`` and the
    rests of each group are packed on their own, so no task holds more than a group's lengths, however long a document is or
    however often a row repeats. sequence_id is the group's number times 2^32 plus the bin's; those of full pieces start at 2^62.

    A null or empty text is the end id alone. Repeated rows are packed each; ties in length go by doc_id and what follows.
    Other columns are not read. An empty table gives no rows.
    """
    cut = Scratch(docs.sparkSession).cut(pieces(docs, size, name))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = cut.where(F.col("length") == size).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rests = cut.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group))
    dealt = rests.withColumn("g", F.pmod(F.xxhash64("at", "doc_id", F.lit(seed)), F.lit(groups))).drop("at")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, part["offset"] = first_fit_decreasing(part["length"].to_numpy(), size)
        part["sequence_id"] = (int(key[0]) << 32) + bins
        return part[out]

    packed = dealt.groupBy("g").applyInPandas(run, "".join(f"{c} long, " for c in out)[:-2])
    return packed.unionByName(full.select(out))
