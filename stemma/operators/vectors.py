"""Exact nearest vectors by cosine: vectors stored in clusters that a search can rule out, queries passed over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.catalog import top_k
from stemma.session import Scratch

#: Centres at most, vectors of a piece (about), queries that are passed over at once.
CENTRES, PIECE, QUERIES = 512, 2048, 16384
#: Rings around a centre per unit of distance, and what floats may be off by: of scores, and of distances, whose squares they come from.
RINGS, SLACK, OFF = 64, 1e-9, 2e-7
#: The cluster of vectors that are all zeros, which are at no distance that tells anything.
ZERO = -1


@dataclass(frozen=True)
class Vectors:
    """pieces (cluster, lo, hi, n, ids, units, authors), rings (cluster, lo, hi, n as arrays) and centres.

    A piece holds vectors of one cluster whose distances from its centre lie between lo and hi.
    """

    pieces: DataFrame
    centres: np.ndarray
    rings: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def load_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors scaled to length one; one of another length becomes zeros, a null is dropped."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    sized = vectors.where("embedding is not null").withColumn("v", F.when(F.size("embedding") == dim, v).otherwise(zeros))
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-10))
    return sized.withColumn("norm", norm).withColumn("unit", F.expr("transform(v, x -> x / norm)")).drop("v", "norm")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T))


def store_vectors(vectors: DataFrame, dim: int, scratch: Scratch) -> Vectors:
    """Vectors (passage_id, embedding, optional author) written once in the order of their clusters.

    Centres are vectors drawn by a hash of their ids, a bounded number. A vector belongs to the nearest one; rings around a centre, cut by
    a hash where they hold too many vectors, are the pieces.
    """
    author = F.lower("author") if "author" in vectors.columns else F.lit(None).cast("string")
    units = scratch.cut(load_vectors(vectors, dim).select(F.col("passage_id").cast("long").alias("id"), "unit", author.alias("author")))
    drawn = units.where(F.exists("unit", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, int(units.count() ** 0.5) + 1)).select("unit").collect()
    centres = np.array([r.unit for r in drawn], np.float64).reshape(-1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            away = distances(x, centres) if len(centres) else np.zeros((len(x), 1))
            near = away.argmin(axis=1)
            zero = ~x.any(axis=1)
            where = np.where(zero, ZERO, near).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where), pa.array(np.where(zero, 0.0, away[np.arange(len(x)), near]))], ["id", "unit", "author", "cluster", "away"])

    placed = scratch.cut(units.mapInArrow(assign, "id long, unit array<double>, author string, cluster int, away double").withColumn("ring", F.floor(F.col("away") * RINGS).cast("int")))
    shares = placed.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / PIECE).alias("shares"))
    cut = placed.join(shares, ["cluster", "ring"]).withColumn("share", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "shares"))
    listed = cut.groupBy("cluster", "ring", "share").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("id", "unit", "author")).alias("v"))
    pieces = listed.select("cluster", "lo", "hi", "n", F.col("v.id").alias("ids"), F.flatten("v.unit").alias("units"), F.col("v.author").alias("authors"))
    parts = max(scratch.spark.sparkContext.defaultParallelism, units.count() // (32 * PIECE))
    kept = scratch.cut(pieces.repartition(parts).sortWithinPartitions("cluster", "lo"))
    rings = kept.groupBy("cluster", F.floor(F.col("lo") * RINGS).alias("ring")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas()  # rings of CENTRES at most
    return Vectors(kept, centres, tuple(rings[c].to_numpy() for c in ("cluster", "lo", "hi", "n")))


class Search:
    """A block of queries that vectors come by: what is known of each query's k best so far."""

    def __init__(self, units: np.ndarray, only: list[str | None], bars: np.ndarray, centres: np.ndarray, k: int):
        self.units, self.only, self.bars, self.k = units, np.array([o or "" for o in only]), bars.copy(), k
        self.away = distances(units, centres) if len(centres) else np.zeros((len(units), 1))
        self.ids = [np.empty(0, np.int64)] * len(units)
        self.scores = [np.empty(0)] * len(units)
        self.skipped = self.met = 0

    def see(self, cluster: int, lo: float, hi: float, ids: np.ndarray, x: np.ndarray, authors: np.ndarray | None) -> None:
        """Vectors of one piece. By the triangle inequality none is nearer to a query than the ring is; if that is too far for the k best, the piece is passed over."""
        if cluster == ZERO:
            most = np.zeros(len(self.units))
        else:
            near = np.maximum(0, np.maximum(self.away[:, cluster] - hi, lo - self.away[:, cluster]) - OFF)
            most = 1 - near * near / 2
        able = np.flatnonzero(most + SLACK >= self.bars)
        self.skipped += (len(self.units) - len(able)) * len(ids)
        self.met += len(able) * len(ids)
        if not len(able):
            return
        for i, s in zip(able, np.round(self.units[able] @ x.T, 9)):
            fit = s >= self.bars[i]
            if self.only[i]:
                fit &= authors == self.only[i]
            rows = np.flatnonzero(fit)
            if len(rows):
                own, scores = np.concatenate([self.ids[i], ids[rows]]), np.concatenate([self.scores[i], s[rows]])
                if len(own) > self.k:
                    best = np.lexsort((own, -scores))[: self.k]
                    own, scores = own[best], scores[best]
                self.ids[i], self.scores[i] = own, scores
                if len(own) == self.k:
                    self.bars[i] = max(self.bars[i], scores.min())


def first_bars(units: np.ndarray, centres: np.ndarray, rings: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """A score that k vectors reach for sure, for each query: the rings' far sides, nearest first, until they hold k."""
    cluster, _, hi, n = rings
    if n.sum() < k:
        return np.full(len(units), -np.inf)
    far = distances(units, centres) if len(centres) else np.zeros((len(units), 1))
    least = np.where(cluster == ZERO, 0.0, 1 - (far[:, np.maximum(cluster, 0)] + hi + OFF) ** 2 / 2)
    order = np.argsort(-least, axis=1)
    reached = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
    return least[np.arange(len(units)), order[np.arange(len(units)), reached]] - SLACK


def nearest(queries: DataFrame, index: Vectors, dim: int, k: int, scratch: Scratch, skipped: Accumulator | None = None, met: Accumulator | None = None) -> DataFrame:
    """query_id, rank, id, score: the k nearest vectors by cosine for queries (query_id, embedding, optional author).

    The stored pieces stay where they are. Queries go over to all tasks in blocks of ``QUERIES`` at most, whose size is that times the
    length of a vector; each task keeps k a query and the k best of these are the result, so that what is shuffled grows with the
    queries and not with the vectors. A zero query finds nothing; an author limits the vectors before they are scored. ``skipped`` and ``met``
    count pairs that were ruled out and scored.
    """
    author = F.lower("author") if "author" in queries.columns else F.lit(None).cast("string")
    asked = load_vectors(queries, dim).where(F.exists("unit", lambda x: x != 0)).select(F.col("query_id").cast("long").alias("query_id"), "unit", author.alias("author"))

    centres, rings, context = index.centres, index.rings, queries.sparkSession.sparkContext

    def barred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            free = np.array([a is None for a in b.column(2).to_pylist()], bool)
            bars = np.where(free, first_bars(matrix(b.column(1), dim), centres, rings, k), -np.inf) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bars)], ["query_id", "unit", "author", "bar"])

    blocks = max(1, -(-queries.count() // QUERIES))
    ready = scratch.cut(asked.mapInArrow(barred, "query_id long, unit array<double>, author string, bar double").withColumn("block", F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(blocks))))
    found = None
    for no in range(blocks):
        block = ready.where(F.col("block") == no).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        held = context.broadcast((block.column("query_id").to_numpy(), matrix(block.column("unit").chunk(0), dim), block.column("author").to_pylist(), block.column("bar").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            query_ids, units, only, bars = held.value
            search = Search(units, only, bars, centres, k)
            for b in batches:
                for i in range(b.num_rows):
                    cluster, lo, hi = (b.column(c)[i].as_py() for c in range(3))
                    authors = np.array([a or "" for a in b.column(6).slice(i, 1).flatten().to_pylist()])
                    search.see(cluster, lo, hi, b.column(4).slice(i, 1).flatten().to_numpy(), matrix(b.column(5).slice(i, 1), dim), authors)
            if skipped is not None:
                skipped.add(search.skipped), met.add(search.met)
            out = [np.repeat(query_ids, [len(x) for x in search.ids]), np.concatenate(search.ids), np.concatenate(search.scores)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

        part = index.pieces.mapInArrow(run, "query_id long, id long, score double")
        part = scratch.cut(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("id")], k, "rank").select("query_id", "rank", "id", "score")
