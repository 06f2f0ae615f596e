"""Incremental ingest: versions and deletions of passages merged batch by batch into tables that equal a rebuild."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: table -> (its column of passage ids, function of passages).
Derived = dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]

MANIFEST = "name string, bucket int, parts array<string>, count_ long, length_ long"


class MergeLog:
    """Passages (id, version, optional deleted, ...) and tables derived from them, in buckets by a hash of the id.

    A batch adds a part to the buckets it changes: ``folder/table/part/bucket=k``. ``folder/manifest/batch`` lists, as of that batch, the parts of
    each bucket in order, with the count and the summed length of its passages; that is as many rows as there are tables and buckets.
    A passage's newest version counts, whatever the order of arrival: an older or equal one that comes later changes
    nothing, and a deletion is a version that stays known, so that nothing older brings the passage back. Derived rows carry the batch
    that made them and count as long as their passage stands as of that batch.

    A bucket of ``most`` parts is written anew as one: the newest version of each passage, as of this batch, and what is derived from those that
    stand. So a bucket of one part holds only what counts. A batch starts from the manifest before it and overwrites what it wrote itself, so
    doing it again gives the same. Rows go over once, by bucket and a slice of it, when versions are compared; nothing derived does.
    """

    #: Columns of the stored passages besides their own: a passage's length, and how count and length change by this version.
    KEPT = ("deleted", "batch", "_length", "_count_more", "_length_more")

    def __init__(self, spark: SparkSession, folder: str, derive: Derived, buckets: int = 64, length: Column | None = None, most: int = 4):
        self.spark, self.folder, self.derive, self.buckets, self.most = spark, folder, derive, buckets, most
        self.schemas: dict = {}
        # of all buckets together several a core, so that a task sorts a part of a bucket
        self.slices = max(1, -(-8 * spark.sparkContext.defaultParallelism // buckets))
        self.length = F.lit(0).cast("long") if length is None else F.coalesce(length.cast("long"), F.lit(0))

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self, batch: int) -> dict[tuple[str, int], tuple[list[str], int, int]]:
        """(table, bucket) -> parts, count, length."""
        if batch < 0:
            return {}
        return {(r.name, r.bucket): (list(r.parts), r.count_, r.length_) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{batch}").collect()}

    def parts(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """All rows of a table's parts, of some buckets or all."""
        paths = [f"{self.folder}/{name}/{p}/bucket={b}" for (n, b), (ps, _, _) in sorted(manifest.items()) if n == name and (buckets is None or b in buckets) for p in ps]
        if not paths:
            return None
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def newest(self, manifest: dict, buckets: set[int] | None = None, arrived: DataFrame | None = None) -> DataFrame | None:
        """Each passage's newest version, deletions included, with its bucket; or, where rows arrive, the newest of them of each
        passage if it is newer than what is stored, with the stored version, deletion and length (_had, _gone, _had_length)."""
        rows = self.parts("passages", manifest, buckets)
        each = Window.partitionBy("bucket", "slice", "id")
        dealt = {"bucket": self.bucket("id"), "slice": F.pmod(F.hash("id"), F.lit(self.slices))}
        if arrived is None:
            if rows is None:
                return None
            ranked = rows.withColumns(dealt).repartition(*dealt).withColumn("_r", F.row_number().over(each.orderBy(F.desc("version"))))
            return ranked.where("_r = 1").drop("_r", "slice")
        met = arrived.selectExpr("*", "cast(null as bigint) as _had", "cast(null as boolean) as _gone", "cast(null as bigint) as _had_length")
        if rows is not None:
            met = met.unionByName(rows.selectExpr("id", "cast(version as bigint) as _had", "deleted as _gone", "_length as _had_length"), allowMissingColumns=True)
        # what is stored comes first; of equal versions that arrive a deletion wins, and else the same row each time
        order = each.orderBy(F.desc_nulls_last("_had"), F.desc_nulls_last("version"), F.desc("deleted"), F.xxhash64(*arrived.columns))
        top = {c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("_had", "_gone", "_had_length")}
        found = met.withColumns(dealt).repartition(*dealt).withColumns({**top, "_over": F.lag("version").over(order)})
        return found.where("version is not null and _over is null and (_had is null or version > _had)").drop("_over", "slice")

    def table(self, name: str, batch: int, buckets: set[int] | None = None, manifest: dict | None = None, columns: bool = False) -> DataFrame | None:
        """A table as it stands after a batch; with ``columns`` as it is stored."""
        manifest = self.manifest(batch) if manifest is None else manifest
        parts = {b: len(ps) for (n, b), (ps, _, _) in manifest.items() if n == "passages" and ps and (buckets is None or b in buckets)}
        many = {b for b, n in parts.items() if n > 1}
        # one part holds a passage once, and nothing derived from what doesn't stand
        found = [self.parts(name, manifest, set(parts) - many)]
        if many:
            now, rows = self.newest(manifest, many), self.parts(name, manifest, many)
            found.append(now.drop("bucket") if name == "passages" else None if rows is None else self.counted(name, rows, now))
        found = [t for t in found if t is not None]
        if not found:
            return None
        whole = reduce(DataFrame.unionByName, found)
        if columns:
            return whole
        return self.standing(whole) if name == "passages" else whole.drop("batch")

    def standing(self, rows: DataFrame) -> DataFrame:
        """Passages that aren't deleted, as they came."""
        return rows.where("not deleted").drop(*self.KEPT, "bucket")

    def counted(self, name: str, rows: DataFrame, now: DataFrame) -> DataFrame:
        """The derived rows whose passage stands among the newest versions as the batch that made them left it."""
        key = self.derive[name][0]
        standing = now.where("not deleted").select(F.col("id").alias(key), F.col("batch").alias("_at"))
        # no batch after the newest version's made any; so the newest versions stay where they are and only the rows go over
        return rows.join(standing, key).where("batch >= _at").select(rows.columns)

    def totals(self, batch: int) -> tuple[int, float]:
        """How many passages stand after a batch, and their mean length."""
        sums = [(n, size) for (name, _), (_, n, size) in self.manifest(batch).items() if name == "passages"]
        count = sum(n for n, _ in sums)
        return count, sum(size for _, size in sums) / count if count else 0.0

    def at(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def listed(self, path: str) -> list:
        fs, place = self.at(path)
        return list(fs.listStatus(place)) if fs.exists(place) else []

    def write(self, rows: DataFrame, key: str, name: str, part: str) -> set[int]:
        """Writes a part and gives the buckets that got rows."""
        spark, setting = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
        before = spark.conf.get(setting)
        spark.conf.set(setting, self.buckets)  # else every task sorts its rows by bucket
        try:
            dealt = rows if "bucket" in rows.columns else rows.withColumn("bucket", self.bucket(key))
            dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}/{part}")
        finally:
            spark.conf.set(setting, before)
        return {int(s.getPath().getName().split("=")[1]) for s in self.listed(f"{name}/{part}") if s.getPath().getName().startswith("bucket=")}

    def apply(self, rows: DataFrame, batch: int) -> None:
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        rows = rows.where("id is not null and version is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        manifest = self.manifest(batch - 1)
        reached = {r[0] for r in rows.select(self.bucket("id")).distinct().collect()}  # a number of buckets at most
        new = self.newest(manifest, reached, rows)
        there = F.col("_had").isNotNull() & ~F.col("_gone")
        sums = {"_length": F.when(F.col("deleted"), 0).otherwise(self.length), "batch": F.lit(batch)}
        more = {"_count_more": F.when(F.col("deleted"), 0).otherwise(1) - F.when(there, 1).otherwise(0), "_length_more": F.col("_length") - F.when(there, F.col("_had_length")).otherwise(0)}
        accepted = new.withColumns(sums).withColumns(more).select(*rows.columns, "batch", "_length", *more, "bucket")
        self.write(accepted, "id", "passages", f"{batch}")
        part = self.spark.read.schema(accepted.schema).parquet(f"{self.folder}/passages/{batch}")
        changes = {r.bucket: (r.n, r.size) for r in part.groupBy("bucket").agg(F.sum("_count_more").alias("n"), F.sum("_length_more").alias("size")).collect()}  # as many
        for b, (n, size) in changes.items():
            for name in ("passages", *self.derive):
                parts, count, length = manifest.get((name, b), ([], 0, 0))
                manifest[name, b] = ([*parts, f"{batch}"] if name == "passages" else parts, count + n, length + size)
        full = {b for b in changes if len(manifest["passages", b][0]) >= self.most}
        if set(changes) - full:
            self.derived(part.where(~F.col("bucket").isin(*full)) if full else part, batch, f"{batch}", manifest)
        if full:
            label = f"{batch}-all"
            filled = self.write(self.newest(manifest, full).withColumn("batch", F.lit(batch)).drop("_count_more", "_length_more"), "id", "passages", label)
            for name, b in ((n, b) for n in ("passages", *self.derive) for b in full):
                manifest[name, b] = ([label] if name == "passages" and b in filled else [], *manifest[name, b][1:])
            self.derived(self.parts("passages", manifest, full), batch, label, manifest)
        listed = [(name, b, parts, n, size) for (name, b), (parts, n, size) in sorted(manifest.items())]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch}")

    def derived(self, passages: DataFrame, batch: int, part: str, manifest: dict) -> None:
        """Writes what is derived from stored passages, where they are read, and lists it."""
        standing = self.standing(passages)
        for name, (key, f) in self.derive.items():
            for b in self.write(f(standing).withColumn("batch", F.lit(batch)), key, name, part):
                parts, *sums = manifest[name, b]
                manifest[name, b] = ([*parts, part], *sums)

    def vacuum(self, batch: int) -> None:
        """Deletes what no batch from this one on reads: parts that its manifest doesn't list, and the manifests before it."""
        listed = {(name, p) for (name, _), (parts, _, _) in self.manifest(batch).items() for p in parts}
        for name in ("passages", *self.derive, "manifest"):
            for s in self.listed(name):
                part = s.getPath().getName()
                no = int(part.split("-")[0])
                if no <= batch and (name, part) not in listed and not (name == "manifest" and no == batch):
                    self.at(name)[0].delete(s.getPath(), True)


def ingest_stream(source: DataFrame, log: MergeLog, checkpoint: str):
    """Starts the ingest of new, changed and deleted passages into a merge log.

    A batch's work follows the batch: it reads the ids, versions and lengths of its own buckets and writes a part to each that it changes.
    """
    return source.writeStream.foreachBatch(log.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
