"""Exact top-k by inner product: no-random-access aggregation over sorted lists, a block of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose lists are read together, so that what is summed of them stays in a processor's cache.
LISTS = 4096
#: Queries whose bounds are held at once.
TOGETHER = 256
#: Shares of the lists after whose reading the bounds are looked at.
STOPS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 31 / 32, 1)


def exact_type(q: np.ndarray, most: float) -> type:
    """The cheapest type in which sums of products of q's and a row's whole numbers are exact; Python's integers if need be."""
    bound = 4.0 * max(1, len(q)) * float(np.abs(q).max(initial=0)) * most
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def cast(a: np.ndarray, kind: type) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(a) if kind is object and a.size else a.astype(kind)


class Lists:
    """Rows as one list a component in ascending order: the values, and which row each is of."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x.T, axis=1, kind="stable")
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.low, self.high = self.values[:, :1].copy(), self.values[:, -1:].copy()
        self.most = float(np.abs(x).max(initial=0))
        self.first = 0

    def read(self, depth: int, up: bool, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """What is known of all rows once the lists have been read to a depth, from their upper ends if ``up``, else from their lower ones.

        Two tables of components by rows: both hold the values that were read; for the others the first has the value at the list's far
        end, the second the one that was read last.
        """
        n = self.order.shape[1]
        part = slice(n - depth, n) if up else slice(0, depth)
        values, places = cast(self.values[:, part], kind), self.order[:, part]
        tables = []
        for rest in (cast(self.low if up else self.high, kind), values[:, :1] if up else values[:, -1:]):
            table = np.repeat(rest, n, axis=1)
            np.put_along_axis(table, places, values, axis=1)
            tables.append(table)
        return tables[0], tables[1]


def nearest(lists: Lists, q: np.ndarray, k: int, skip: np.ndarray, bars: np.ndarray, few: int = 4) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query, a row of q: the rows that can be among its k best and reach its bar, their scores, and the depth to which the lists were read for it. Rows with the id ``skip`` take no part.

    Each list is read in order, from its upper end for the queries to which more of the component is better and from the lower one for the
    others, all to the same depth, once for all queries; nothing beyond it is looked at. A row's lower bound takes an entry that was not read for the worst
    of its list, its upper bound takes it for the one that was read last. The k-th best lower bound is a query's bar; rows with an upper
    bound below it are out, and those not met at all by the same bound. A query stops when only a few rows, one in ``few``, can still
    qualify; their scores are resolved. The others read on. Reading begins with the depth before the one at which the last queries stopped.
    """
    kind = exact_type(q, lists.most)
    q, x, n = cast(q, kind), cast(lists.x, kind), len(lists.ids)
    more, less = np.maximum(q, 0), np.minimum(q, 0)
    other = lists.ids[None, :] != skip[:, None]
    out: list[tuple[np.ndarray, np.ndarray, int]] = [(np.empty(0, np.int64), np.empty(0, kind), 0)] * len(q)
    going, depth, bars = np.arange(len(q)), 0, bars.copy()
    for at, stop in enumerate(STOPS):
        to = max(depth, int(np.ceil(n * stop)))
        if to == depth or at < lists.first:
            continue
        depth, (worst_up, last_up), (worst_down, last_down) = to, lists.read(to, True, kind), lists.read(to, False, kind)
        lower = np.where(other[going], more[going] @ worst_up + less[going] @ worst_down, -np.inf)
        if n >= k:
            bars[going] = np.maximum(bars[going], np.partition(lower, n - k, axis=1)[:, n - k])
        able = (more[going] @ last_up + less[going] @ last_down >= bars[going][:, None]) & other[going]
        done = (able.sum(axis=1) <= max(2 * k, n // few)) | (depth == n)
        for i, can in zip(going[done], able[done]):
            rows = np.flatnonzero(can)
            out[i] = rows, x[rows] @ q[i], depth
        going = going[~done]
        if not len(going):
            lists.first = max(0, at - 1)
            break
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k best rows of ``vectors`` (vec_id, embedding) with another vec_id.

    Components become floor(scale * x); the score is their inner product; ties go to the smaller vec_id. Rows are dealt once, at random,
    into blocks of ``block`` or fewer, whose sorted lists (of ``LISTS`` rows together) a task builds and keeps while all queries come by, a batch at a time; so
    only queries are copied, once a block. Each block gives its k best per query, and the k best of these are the result.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Repeated rows of
    ``vectors`` are candidates each. Equal queries are one; one id with several vectors is several queries, whose rows have the
    same query_id, and none of its id's rows is a candidate. Only vectors of equal length meet. Fewer than k others: all
    of them. Scores beyond a long are held at its ends. An empty table gives no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        z = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double"))
        ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(F.col("vec_id").cast("long"), z.alias("z"))

    x, q = usable(vectors), usable(queries).distinct()
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    n_rows = x.count()
    blocks = max(1, -(-n_rows // block), min(tasks, n_rows // 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for b in batches:
            at = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            ends = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(ends, ends[1:]):
                if start == end:
                    continue
                (dim, number, asks), part = at[:, start], b.slice(start, end - start)
                ids = part.column(3).to_numpy()
                z = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if (dim, number) != now:
                    now, held, lists = (dim, number), [], None
                if not asks:
                    held.append((ids, z))
                elif held:
                    if lists is None:
                        of, rows = (np.concatenate(h) for h in zip(*held))
                        lists = [Lists(rows[i : i + LISTS], of[i : i + LISTS]) for i in range(0, len(of), LISTS)]
                    yield answered(lists, ids, z, part.column(5).to_numpy())

    def answered(lists: list[Lists], ids: np.ndarray, z: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        found = [(np.empty(0, np.int64), np.empty(0, z.dtype))] * len(ids)
        for some in lists:  # what was found before is a bar for what comes after
            for at in range(0, len(ids), TOGETHER):
                part = slice(at, at + TOGETHER)
                bars = np.array([float(scores[-1]) if len(scores) == k else -np.inf for _, scores in found[part]])
                for i, (rows, more, _) in enumerate(nearest(some, z[part], k, ids[part], bars), at):
                    have, scores = np.concatenate([found[i][0], some.ids[rows]]), np.concatenate([found[i][1], more])
                    best = best_of(have, scores, k)
                    found[i] = have[best], scores[best]
        counts = [len(have) for have, _ in found]
        held = np.array([max(-(2**63), min(2**63 - 1, int(s))) for _, scores in found for s in scores], np.int64)
        columns = np.repeat(ids, counts), np.repeat(keys, counts), np.concatenate([have for have, _ in found]), held
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "key", "vec_id", "score"])

    row = x.select(F.size("z").alias("dim"), F.pmod(F.xxhash64("vec_id", "z", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "z", F.lit(0).cast("long").alias("key"))
    ask = q.select(F.size("z").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "z", F.xxhash64("z").alias("key"))
    dealt = row.unionByName(ask).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "dim", "asks")
    met = dealt.mapInArrow(run, "query_id long, key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
