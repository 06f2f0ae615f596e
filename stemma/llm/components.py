"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that can be reached.

    Each round hooks the parents of both ends of an edge onto the smaller grandparent and halves the paths, so the
    number of rounds follows the logarithm of a component's width. Nulls and self links are left out; no rows give no rows.
    Every round is one written table; only grouped minima and equi-joins are used, so a large component is not gathered anywhere.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = scratch.cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parent = scratch.cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("parent")))
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        state = scratch.cut(parent.select("node", "parent").join(up, "parent").select("node", "parent", "grand"))
        a = state.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = state.select(F.col("node").alias("v"), F.col("grand").alias("gv"))
        met = both.join(a, "u").join(b, "v")
        offers = met.select(F.explode(F.array(F.struct(F.col("pu").alias("node"), F.col("gv").alias("parent")), F.struct(F.col("u").alias("node"), F.col("gv").alias("parent")))).alias("o")).select("o.*")
        new = offers.union(state.select("node", F.col("grand").alias("parent"))).groupBy("node").agg(F.min("parent").alias("parent"))
        new = scratch.cut(new.join(state.select("node", F.col("parent").alias("was"), "grand"), "node"))
        moved = new.where("parent <> was or grand <> was").limit(1).count()
        scratch.drop(parent), scratch.drop(state)
        if not moved:
            scratch.drop(both)
            return new.select("node", F.col("parent").alias("root"))
        parent = new
