"""Running values along an order, for keys that may hold any share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import Scratch


def running(rows: DataFrame, keys: list[str], order: list[str], scratch: Scratch, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds running sums of columns, and their last values that are not null, within each key from its first row in ``order`` up to each row.

    Rows are dealt into ranges of keys and order, so that a large key is spread over many; values run within each range, and what the
    ranges before it hold of its key is added. So a task sorts a range, and one more step orders a row for each key and range it is in. Rows that are equal in
    keys and order get what all of them come to. Null keys are a key, nulls in ``order`` come first.
    """
    sums, lasts = sums or {}, lasts or {}
    made = rows.withColumns({f"_{c}": v for c, v in (sums | lasts).items()})
    ranges = ranges or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    # written, as the borders of ranges are drawn anew each time
    dealt = scratch.cut(made.repartitionByRange(ranges, *keys, *order).withColumn("_part", F.spark_partition_id()))
    last_of = lambda c: F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.struct(*order)))
    per = dealt.groupBy(*keys, "_part").agg(*(F.sum(f"_{c}").alias(c) for c in sums), *(last_of(c).alias(c) for c in lasts), F.lit(True).alias("_some"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_kpart"), *(F.sum(c).over(before).alias(f"_b_{c}") for c in sums), *(F.last(c, ignorenulls=True).over(before).alias(f"_b_{c}") for c in lasts))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_kpart"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    met = dealt.join(carried, same)
    met = met.withColumns({c: F.coalesce(F.col(f"_b_{c}") + F.sum(f"_{c}").over(inside), F.sum(f"_{c}").over(inside), F.col(f"_b_{c}")) for c in sums})
    met = met.withColumns({c: F.coalesce(F.last(f"_{c}", ignorenulls=True).over(inside), F.col(f"_b_{c}")) for c in lasts})
    return met.select(*rows.columns, *sums, *lasts)
