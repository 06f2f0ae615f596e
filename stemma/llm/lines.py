"""Line dedup: windows of three consecutive lines, found again anywhere, are removed where they occur later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.expr import let
from stemma.session import Scratch


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Every row of ``docs`` with its other columns, text replaced by the kept lines, and n_lines, n_removed added.

    Lines are what \\n separates; a blank line (white space only) is in no window and always stays. A window is ``width``
    consecutive non-blank lines of one text, compared by two 64-bit hashes of the whole lines. The first occurrence over all rows is that with the
    smallest (doc_id, line number); the lines that a later occurrence covers are removed, overlaps merged, also where windows
    of one text repeat themselves. Kept lines are joined by \\n. A null or empty text has no windows and stays
    as it is. Equal rows (same doc_id and text) count as one and all stay alike. A row with a null doc_id counts as the first.
    Columns named n_lines or n_removed in the input are replaced. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    hashes = ", ".join(f"x[k + {i}].line" for i in range(width))
    solid = "filter(transform(split(text, '\\n', -1), (l, i) -> named_struct('line', l, 'at', i)), x -> x.line rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    windows = let("x", solid, f"if(size(x) < {width}, null, transform(sequence(0, size(x) - {width}), k -> named_struct('at', transform(sequence(k, k + {width - 1}), j -> x[j].at), 'h', xxhash64({hashes}), 'g', xxhash64('window', {hashes}))))")
    rid = F.expr("xxhash64(text)")
    placed = scratch.cut(docs.where("text is not null").select("doc_id", rid.alias("rid"), F.expr(f"explode({windows})").alias("w")).select("doc_id", "rid", "w.at", "w.h", "w.g"))
    place = F.struct("doc_id", F.col("at")[0].alias("line"))
    # written, so that both sides of the join are dealt anew and a hot window can be split
    first = scratch.cut(placed.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first"))
    later = placed.join(first, ["h", "g"]).where(F.struct("doc_id", F.col("at")[0].alias("line")) != F.col("first"))
    gone = later.groupBy("doc_id", "rid").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    gone = scratch.cut(gone).withColumnRenamed("doc_id", "gone_doc").withColumnRenamed("rid", "gone_rid")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*(F.col(c).alias(f"in_{c}") for c in names), rid.alias("rid"))
    both = own.join(gone.hint("merge"), F.expr("in_doc_id <=> gone_doc and rid = gone_rid"), "left")
    lines = "split(in_text, '\\n', -1)"
    runs = "transform(array_append(g, size(l)), (to, k) -> slice(l, coalesce(get(g, k - 1) + 1, 0) + 1, to - coalesce(get(g, k - 1) + 1, 0)))"
    keep = let("g", "array_sort(gone)", let("l", lines, f"array_join(flatten({runs}), '\\n')"))
    out = both.withColumn("n_lines", F.expr(f"if(in_text is null, 0L, cast(size({lines}) as bigint))")).withColumn("n_removed", F.expr("if(gone is null, 0L, cast(size(gone) as bigint))"))
    return out.withColumn("in_text", F.expr(f"if(gone is null, in_text, {keep})")).select(*(F.col(f"in_{c}").alias(c) for c in names), "n_lines", "n_removed")
