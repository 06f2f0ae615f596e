"""Fill-in-middle: texts cut at whole units by a Fenwick tree over fixed blocks, and put together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 1024


class Units:
    """A text's units (lines with their line feed; the last may have none) in a Fenwick tree over fixed blocks of its bytes.

    Node i of the tree holds how many units end, and how many code points begin, in the blocks that it covers. A descent by
    powers of two finds the block in which a unit ends; the boundary is then looked for in that block alone.
    """

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        starts = np.arange(0, len(data), block)
        ends, begins = self.data == 10, (self.data & 0xC0) != 0x80
        self.count = int(ends.sum()) + (1 if data and data[-1:] != b"\n" else 0)
        self.size = len(starts)
        tree = np.zeros((2, self.size + 1), np.int64)
        if self.size:
            tree[0, 1:], tree[1, 1:] = np.add.reduceat(ends, starts, dtype=np.int64), np.add.reduceat(begins, starts, dtype=np.int64)
        step = 1
        while step < self.size:  # a node takes in its lower half's node
            upper = np.arange(2 * step, self.size + 1, 2 * step)
            tree[:, upper] += tree[:, upper - step]
            step *= 2
        self.units, self.points = tree.tolist()
        self.top = step

    def cut(self, n: int) -> tuple[int, int]:
        """Bytes and code points of the first n units."""
        if n >= self.count:
            return len(self.data), self._points(self.size)
        if n <= 0:
            return 0, 0
        at, left, points, step = 0, n, 0, self.top
        while step:
            if at + step <= self.size and self.units[at + step] < left:
                at += step
                left -= self.units[at]
                points += self.points[at]
            step //= 2
        part = self.data[at * self.block : (at + 1) * self.block]
        end = int(np.flatnonzero(part == 10)[left - 1]) + 1
        return at * self.block + end, points + int(np.count_nonzero((part[:end] & 0xC0) != 0x80))

    def _points(self, blocks: int) -> int:
        total = 0
        while blocks:
            total += self.points[blocks]
            blocks &= blocks - 1
        return total


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    """Four whole numbers below 2^32 for a document; one without an id draws as if its id were written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(doc_id: int | None, data: bytes, rate: int, spm: int, seed: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n units, form, code points of prefix and middle, and the text in that form."""
    tree = Units(data)
    a, b, c, d = draws(doc_id, seed)
    if not data or c % 100 >= rate or any(m.encode() in data for m in MARKS):
        return tree.count, "plain", None, None, data
    first, second = sorted((a % (tree.count + 1), b % (tree.count + 1)))
    (x, before), (y, until) = tree.cut(first), tree.cut(second)
    p, s, m = (mark.encode() for mark in MARKS)
    form = "spm" if d % 100 < spm else "psm"
    parts = (s, data[y:], p, data[:x], m, data[x:y]) if form == "spm" else (p, data[:x], s, data[y:], m, data[x:y])
    return tree.count, form, before, until - before, b"".join(parts)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: str = "7") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs`` (doc_id, text).

    The units of a text are its lines. ``rate`` percent of the documents are cut before two units, drawn by doc_id, and
    written as prefix, suffix, middle (form psm) or, ``spm`` percent of these, as suffix, prefix, middle (form spm), each behind its
    mark. Prefix and middle can be empty, as can the suffix. Any other text, an empty or null one, and one that contains a
    mark stays as it is (form plain, prefix_chars and middle_chars null). A row without an id is cut as if its id were written
    as nothing; equal ids are cut by equal draws, each on its own text. Repeated rows come back each, other columns are
    not read, and an empty table gives no rows. A task holds one batch of texts; a text costs its bytes and eight for each block.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *transform(i, t.as_buffer().to_pybytes() if t.is_valid else b"", rate, spm, seed)) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            columns = [list(c) for c in zip(*rows)] or [[]] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(columns[5], pa.binary()).cast(pa.string())], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Only the three marks are looked for, as no text that was cut has one."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
