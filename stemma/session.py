"""Session and table helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders opened inside each open ``freed`` block, innermost last.
_open: list[list["Scratch"]] = []


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names, so that lost executors cost no lineage.

    A written table is read back with its true size, which lets the planner choose a broadcast only where it is small. Where the
    setting is missing, a local master gets a temporary folder; a cluster must name one that its machines share. What is
    not freed before goes when the driver's JVM ends.
    """

    #: The temporary folder of this process, if it needed one.
    local: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            # the setting can't be changed in a running session
            base = Scratch.local = Scratch.local or tempfile.mkdtemp(prefix="stemma-")
        self.root = f"{base.rstrip('/')}/stemma-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = self._file(self.root)
        fs.mkdirs(path), fs.deleteOnExit(path)  # only what exists is marked
        if _open:
            _open[-1].append(self)

    def _file(self, name: str) -> tuple:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def cut(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """The rows of ``df`` as a written table, in folders by some columns if they are named."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Free a table of this folder that nothing reads any more."""
        fs, path = self._file(df._scratch)
        fs.delete(path, True)

    def exists(self) -> bool:
        """Whether the tables of this folder are still there."""
        fs, path = self._file(self.root)
        return fs.exists(path)

    def clear(self) -> None:
        """Free all tables of this folder."""
        fs, path = self._file(self.root)
        fs.delete(path, True)


@contextmanager
def freed() -> Iterator[None]:
    """Frees at its end the tables of every Scratch opened inside; for callers that have written their result by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.clear()
