"""SimHash near-duplicates: pigeonhole blocks of the fingerprint, joined and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.components import components
from stemma.session import Scratch

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest, n, votes = xxhash.xxh64_intdigest, 0, np.zeros(BITS, np.int64)
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, *keep: str) -> DataFrame:
    """(doc_id, fp) and the columns named in ``keep``: fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *keep])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(run, f"doc_id long, fp long{kinds}")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks over every choice of ``blocks - max_bits`` blocks: two values within max_bits agree under one of them."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, blocks: int = 5, bucket: int = 64) -> DataFrame:
    """Edges (u, v) that connect every pair of different fingerprints in ``fps`` (fp) at up to ``max_bits`` (1 or 2) bits.

    A bucket holds the fingerprints that agree on a choice of blocks. Buckets of up to ``bucket`` fingerprints are joined with
    themselves and verified. Fuller buckets take another exact way: two values at one or two bits' distance share a value at
    up to one bit from both, so members meet on their own value and its single-bit flips, at most 65 of them on one, and each
    is linked to the smallest there (which is at two bits at most, so nothing needs to be verified).
    """
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(max_bits, blocks)))
    keyed = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.expr("fp & mask").alias("key"))
    # written, so that both sides of the join are dealt anew and a hot bucket can be split
    sizes = scratch.cut(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = scratch.cut(keyed.join(sizes, ["choice", "key"]))
    small = met.where(F.col("n") <= bucket).select("choice", "key", "fp")
    pairs = (
        small.select("choice", "key", F.col("fp").alias("u"))
        .join(small.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"])
        .where(f"u < v and bit_count(u ^ v) <= {max_bits}")
        .select("u", "v")
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS if max_bits == 2 else 0)))
    if max_bits == 1:
        flips = F.array(*(F.lit(signed(1 << i)) for i in range(BITS)))
    full = met.where(F.col("n") > bucket).select("fp").distinct()
    if max_bits == 1:
        star = full.select(F.col("fp").alias("u"), F.explode(flips).alias("flip")).select("u", F.expr("u ^ flip").alias("v")).join(full.select(F.col("fp").alias("v")), "v").select("u", "v")
    else:
        near = full.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("at"))
        star = near.groupBy("at").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1").select(F.expr("fps[0]").alias("u"), F.explode(F.expr("slice(fps, 2, size(fps) - 1)")).alias("v"))
    return pairs.union(star).distinct()


def rooted(classes: DataFrame, scratch: Scratch, max_bits: int, blocks: int, bucket: int) -> DataFrame:
    """(fp, least, root) of classes (fp, least): root is the smallest fingerprint that links reach."""
    roots = components(links(classes.select("fp"), scratch, max_bits, blocks, bucket), scratch)
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, width: int = 3, seed: int = 42, max_bits: int = 2, blocks: int = 5, bucket: int = 64) -> DataFrame:
    """(rid), one for each group of simhash_groups: the row key of the row with the smallest doc_id, then the smallest rid.

    ``docs`` has doc_id, text and rid, which is equal for equal rows only. Groups are told apart by their fingerprints, so one
    doc_id can stand in several; a null doc_id comes after all others.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.cut(fingerprints(docs, width, seed, "rid"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = scratch.cut(marked.groupBy("fp").agg(F.min(order).alias("least")))
    return rooted(classes, scratch, max_bits, blocks, bucket).groupBy("root").agg(F.min("least").alias("least")).select("least.rid")


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42, max_bits: int = 2, blocks: int = 5, bucket: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at up to ``max_bits`` bits are linked; component_id is the smallest doc_id that links reach. Equal
    fingerprints meet first, so copies are never expanded into pairs. A null or empty text has fingerprint zero and is
    linked like any other; rows that repeat a doc_id are all kept; a null doc_id is never the smallest unless it is alone
    in its group (component_id is null then). Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.cut(fingerprints(docs, width, seed))
    classes = scratch.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    owned = scratch.cut(rooted(classes, scratch, max_bits, blocks, bucket))
    smallest = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.cut(owned.join(smallest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
