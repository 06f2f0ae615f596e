"""Quality classifier: n-gram indicators scaled by class log-count ratios, a hinge-loss model by dual coordinate descent."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import Scratch

#: Memory of a worker for words it has met, so that frequent ones are hashed once.
MEMO = 1 << 18


def shape(word: str) -> int:
    """A code of a word's case, digits and ending."""
    core = word.rstrip(".,;:!?*#$%&|+=-_~^@/\\<>()[]{}\"'")
    tail = word[len(core) :]
    case = 0 if not core else 1 if core.isdigit() else 2 if any(c.isdigit() for c in core) else 3 if core.isupper() else 4 if core[0].isupper() else 5 if core.islower() else 6
    end = 0 if not tail else 1 if tail in (".", "!", "?") else 2 if tail in (",", ";", ":") else 3 + min(len(tail), 3) + 4 * (tail[0] in "*#$%&|") if len(set(tail)) == 1 else 11
    return case * 16 + end


class Features:
    """The set of hashed n-grams of a text: words and pairs of words; shapes with the distance to the word's last occurrence, up to three in a row."""

    def __init__(self, bits: int):
        self.mask, self.memo = np.uint64((1 << bits) - 1), {}

    def code(self, word: str) -> tuple[int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = (zlib.crc32(word.lower().encode()), shape(word))
        return got

    def mixed(self, kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h & self.mask

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32)
        codes = np.array([self.code(w) for w in words], np.uint64)
        w, s = codes[:, 0], codes[:, 1]
        order = np.argsort(w, kind="stable")
        gap = np.zeros(len(w), np.int64)
        same = w[order][1:] == w[order][:-1]
        gap[order[1:]] = np.where(same, np.diff(order), 0)
        s = s * np.uint64(16) + np.minimum(gap, 15).astype(np.uint64)
        grams = [self.mixed(1, w), self.mixed(2, w[:-1], w[1:]), self.mixed(3, s), self.mixed(4, s[:-1], s[1:]), self.mixed(5, s[:-2], s[1:-1], s[2:])]
        return np.unique(np.concatenate(grams)).astype(np.int32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, c: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights of a linear hinge-loss model with L2 penalty; the last one is the bias. Classes weigh the same in total."""
    w, alpha, rng = np.zeros(dims + 1), np.zeros(len(y)), np.random.default_rng(seed)
    most = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            margin = w[rows[i]] @ values[i] + w[-1]
            new = min(max(alpha[i] - (y[i] * margin - 1.0) / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into chances, by Newton's method on smoothed labels."""
    hi, lo = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, d = p - t, p * (1 - p) + 1e-9
        haa, hab, hbb = (d * margin * margin).sum() + 1e-6, (d * margin).sum(), d.sum() + 1e-6
        ga, gb, det = (g * margin).sum(), g.sum(), 0.0
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def scaled(idx: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[idx]
    return v / max(1e-9, float(np.sqrt(v @ v)))


def classify(docs: DataFrame, labels: DataFrame, bits: int = 18, sample: int = 6000, smoothing: float = 1.0, c: float = 1.0, epochs: int = 20, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, label 0 or 1).

    held_out is crc32(doc_id as text) mod 4 = 2; such rows teach nothing. 1. The documents of all other labelled rows are
    counted per hashed n-gram and class (grouped sums over a space of 2^bits), which gives the log-count ratios r. 2. A
    bounded sample of them (the ``sample`` smallest hashes of doc_id, a row each) trains the hinge-loss model on indicators times r, one
    quarter of it turning margins into chances. 3. Every whole text is scored; score is in [0, 1]; predicted is 1 from ``cut`` up.

    A null or empty text has no n-grams and gets the bias's score. Labels that are null are left out, several of one doc_id
    are averaged (a half counts as 1); labels of unknown documents teach nothing; without a label of each class every
    score is 0.5. A null doc_id is not held out and teaches nothing. Repeated rows score alike. Other columns are not read. No rows give no rows.
    """
    scratch, dims = Scratch(docs.sparkSession), 1 << bits
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("y"))
    known = scratch.cut(known.where(fold != 2).withColumn("h", F.xxhash64("doc_id")))
    bar = known.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    train = docs.select("doc_id", F.col("text").cast("string")).join(known.hint("merge"), "doc_id").select("text", "y", (F.col("h") <= F.lit(bar)).alias("fit"), (fold == 3).alias("tune"), "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(bits), np.zeros((2, dims), np.int64)
        names = ["kind", "idx", "n0", "n1", "h"]

        def row(kind: int, h: int | None, *lists: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([h], pa.int64())], names)

        for b in batches:
            for text, y, fit, tune, h in zip(b.column(0), *(b.column(c).to_pylist() for c in range(1, 5))):
                idx = features(text.as_py())
                sums[int(y), idx] += 1
                if fit:
                    yield row(1 + int(y) + 2 * int(tune), h, idx, idx[:0], idx[:0])
        at = np.flatnonzero(sums.any(axis=0))
        yield row(0, None, at, sums[0, at], sums[1, at])

    seen = scratch.cut(train.mapInArrow(count, "kind int, idx array<long>, n0 array<long>, n1 array<long>, h long"))
    grams = seen.where("kind = 0").select(F.explode(F.arrays_zip("idx", "n0", "n1")).alias("x")).groupBy("x.idx").agg(F.sum("x.n0").alias("n0"), F.sum("x.n1").alias("n1"))
    counts = np.full((2, dims), smoothing)
    for r in grams.toArrow().to_batches():  # at most 2^bits rows
        at = r.column(0).to_numpy()
        counts[0, at] += r.column(1).to_numpy()
        counts[1, at] += r.column(2).to_numpy()
    ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows = [], []
        for b in batches:
            kinds += b.column(0).to_pylist()
            rows += [np.asarray(x.values) for x in b.column(1)]
        order = sorted(range(len(rows)), key=lambda i: (kinds[i], rows[i].tobytes()))
        kinds, rows = np.array([kinds[i] for i in order], np.int64), [rows[i] for i in order]
        y, tune = np.where((kinds - 1) % 2 == 1, 1.0, -1.0), kinds > 2
        values, at = [scaled(r, shared.value) for r in rows], np.flatnonzero(~tune)
        weights, a, b = np.zeros(dims + 1), 0.0, 0.0
        if len(set(y[at])) == 2:
            weights = dual_descent([rows[i] for i in at], [values[i] for i in at], y[at], dims, c, epochs)
            held = np.flatnonzero(tune) if len(set(y[tune])) == 2 else at
            a, b = logistic(np.array([weights[rows[i]] @ values[i] + weights[-1] for i in held]), y[held])
        yield pa.RecordBatch.from_arrays([pa.array([np.append(weights, [a, b])], pa.list_(pa.float64()))], ["w"])

    # one task over the bounded sample: of rows with one doc_id one
    fitted = seen.where("kind > 0").groupBy("h").agg(F.min(F.struct("kind", "idx")).alias("x")).select("x.kind", "x.idx")
    weights = np.array(fitted.coalesce(1).mapInArrow(fit, "w array<double>").first()[0])
    model = docs.sparkSession.sparkContext.broadcast((weights[:-3].astype(np.float32), *map(float, weights[-3:])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratio = Features(bits), shared.value
        w, bias, a, b = model.value
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                idx = features(text.as_py())
                margins[i] = w[idx] @ scaled(idx, ratio) + bias
            scores = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return source.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
