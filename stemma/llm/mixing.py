"""Mixing sources to target weights: whole copies, then Pareto order sampling of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.expr import n_words
from stemma.session import Scratch

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, one row each) with target: shares by weight of ``total`` times all sizes.

    Weights repeat over the sources by name, null last. No target passes ``most`` times its source's size: with the level
    lambda a source gets min(most * size, lambda * weight), and lambda is such that the shares add up. The sources sorted by
    most * size / weight fill up in that order, so lambda follows from running sums over the sources alone: it is the largest
    of the candidates that leave the source they start with unfilled.
    """
    one = Window.partitionBy(F.lit(0))
    named = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    capped = named.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    order = one.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    filled = capped.withColumn("lambda", (total * F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    return filled.withColumn("lambda", F.max(F.when(F.col("lambda") <= F.col("level"), F.col("lambda"))).over(one)).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("lambda"), "cap")).alias("target"))


def calibrated(sizes: DataFrame) -> DataFrame:
    """(source, rate) of sizes (source, size, n, left): inclusion probabilities min(1, rate * size) make ``left`` words expected.

    The largest sizes are certain as long as the rate would pass 1 for the next one, so the rate follows from running sums
    over a source's different sizes.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words = F.col("n") * F.col("size")
    sure = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    square = F.sum(words.cast("decimal(38,0)") * F.col("size").cast("decimal(19,0)")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rates = sizes.withColumn("rate", (F.col("left") - sure.cast("double")) / square.cast("double"))
    return rates.where("rate * size <= 1").groupBy("source").agg(F.max_by("rate", "size").alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: str = "mix", cells: int = 16384, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with its other columns (those in ``keep``) and size, source_size, target, taken.

    A source whose target is r times its size takes floor(r) certain copies of each document. What is left of the target is a
    Pareto order sample: a document of size z has the inclusion probability p = min(1, c * z), with c such that the expected
    words are what is left; documents are ranked by random odds divided by inclusion odds, u / (1 - u) over p / (1 - p), and
    the first ones are taken once more. The sample's fixed size is in words: the ranking is cut where the next document
    would pass the limit, and one document behind the cut, the one nearest to the words still missing, closes the gap.

    The cut is found by sums over ``cells`` parts of the ranking's logarithm, then over as many parts of the part where the limit
    falls, so only a few rows of each source are ever put in order; then each row is judged alone, against its source's
    cut. No text is shuffled and no source is gathered in a task.

    size is the number of words (null text: 0); documents of size 0 take nothing. Randomness is md5 of the seed and doc_id, so reruns
    agree; rows with one doc_id and size tie and go by their text, and equal rows are taken one by one: as many of them as fit.
    A null source is a source of its own, the last; a null doc_id is one more value, after all others. Input columns with the
    names of results are replaced. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    added = ("size", "source_size", "target", "taken")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.expr(n_words("text")).alias("size"), F.xxhash64("text").alias("text"))
    rows = docs.select(*(F.col(c).alias(f"in_{c}") for c in names), F.col("source").cast("string").alias("source"), ((digits + 0.5) / float(16**13)).alias("u"), place.alias("place"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.cut(rows).withColumn("size", F.col("place.size"))
    sizes = scratch.cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    aims = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, most)
    aims = aims.withColumn("whole", F.floor(F.expr("if(source_size = 0, 0d, target / source_size)"))).withColumn("left", F.expr("target - whole * source_size"))
    aims = scratch.cut(aims.withColumnRenamed("source", "s1"))
    rates = calibrated(sizes.where("size > 0").join(aims.where("left > 0").select("s1", "left"), F.expr("source <=> s1")).drop("s1"))
    aims = scratch.cut(aims.join(rates, F.expr("s1 <=> source"), "left").drop("source"))

    chance = F.col("rate") * F.col("size")
    odds = F.when(chance < 1, F.round(F.log("u") - F.log1p(-F.col("u")) - F.log(chance) + F.log1p(-chance), 9)).otherwise(F.lit(-1000.0))
    spot = (F.least(F.greatest(F.col("rank"), F.lit(-32.0)), F.lit(31.999)) + 32.0) * (cells / 64.0)

    def ranked(some: DataFrame) -> DataFrame:
        met = some.join(aims, F.expr("source <=> s1"), "left").drop("s1").withColumn("rank", F.when((F.col("size") > 0) & F.col("rate").isNotNull(), odds))
        return met.withColumn("cell", F.floor(spot)).withColumn("part", F.floor((spot - F.floor(spot)) * cells))

    def crossed(some: DataFrame, keys: list[str]) -> DataFrame:
        """Of each source the group of rows, in the order of ``keys``, in which its limit falls, with the words before it."""
        sums = some.groupBy("source", *keys).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("left").alias("left"), F.first("start").alias("start"))
        upto = Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        return scratch.cut(sums.where("before <= left and before + words > left").select(F.col("source").alias("s2"), *(F.col(k).alias(f"at_{k}") for k in keys), "before", "left", "n"))

    def inside(some: DataFrame, edge: DataFrame, keys: list[str]) -> DataFrame:
        same = " and ".join(f"{k} <=> at_{k}" for k in keys)
        return some.drop("start").join(edge.drop("left", "n").withColumnRenamed("before", "start"), F.expr(f"source <=> s2 and {same}")).drop("s2", *(f"at_{k}" for k in keys))

    taking = ranked(rows.select("source", "u", "place", "row", "size")).where("rank is not null").withColumn("start", F.lit(0).cast("long"))
    taking = taking.select("source", "rank", "place", "row", "size", "left", "cell", "part", "start")
    cell = crossed(taking, ["cell"])
    part = crossed(inside(taking, cell, ["cell"]), ["cell", "part"])
    edge = crossed(inside(taking, part, ["cell", "part"]), ["rank", "place"])
    # of n equal rows at the cut the first m are taken: found by counts over the written table's parts, then inside one of them
    edge = edge.withColumn("m", F.floor((F.col("left") - F.col("before")) / F.col("at_place.size"))).withColumn("gap", F.expr("left - before - m * at_place.size"))
    equal = taking.join(edge.where("m > 0").drop("left"), F.expr("source <=> s2 and rank = at_rank and place = at_place")).select("source", "row", "m", F.shiftright("row", 33).alias("block"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = equal.groupBy("source", "block").agg(F.count("*").alias("n"), F.first("m").alias("m")).withColumn("seen", F.coalesce(F.sum("n").over(by_block), F.lit(0))).where("seen < m and seen + n >= m")
    inner = equal.drop("m").alias("e").join(blocks.alias("b"), F.expr("e.source <=> b.source and e.block = b.block")).select("e.source", "row", "m", "seen")
    last = inner.withColumn("no", F.row_number().over(Window.partitionBy("source").orderBy("row"))).where("seen + no = m").select(F.col("source").alias("s3"), F.col("row").alias("last_row"))
    cut = scratch.cut(edge.join(last, F.expr("s2 <=> s3"), "left").select("s2", "at_rank", "at_place", "last_row", "gap"))

    def chosen(some: DataFrame) -> DataFrame:
        """Whether a row is in the sample: before its source's cut, or one of the equal rows there that still fit; all are without a cut."""
        ahead = F.struct("rank", "place") < F.struct(F.col("at_rank").alias("rank"), F.col("at_place").alias("place"))
        equal = (F.col("rank") == F.col("at_rank")) & (F.col("place") == F.col("at_place")) & (F.col("row") <= F.col("last_row"))
        return some.withColumn("in", F.col("rank").isNotNull() & (F.col("at_rank").isNull() | ahead | F.coalesce(equal, F.lit(False))))

    out_of = chosen(taking.join(cut, F.expr("source <=> s2"))).where("not in").withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where("miss < gap")
    closing = out_of.groupBy("source").agg(F.min(F.struct("miss", "rank", "place", "row")).alias("b")).select(F.col("source").alias("s3"), F.col("b.row").alias("closing"))
    cut = scratch.cut(cut.join(closing, F.expr("s2 <=> s3"), "left").drop("s3", "gap"))
    judged = chosen(ranked(rows).join(cut, F.expr("source <=> s2"), "left"))
    taken = F.expr("cast(size * (whole + if(in or row <=> closing, 1, 0)) as bigint)")
    return judged.withColumn("taken", taken).select(*(F.col(f"in_{c}").alias(c) for c in names), *added)
