"""Session helpers shared by all operators: lineage cuts and table access."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session without that setting (a local test) gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files, so that a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Compressed files in the shared folder for the steps of one call; what is left of them goes when the call ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and continue from the files; the shuffles that led to it are removed from the disks."""
        conf = self.spark.conf
        before = conf.get(CLEANUP_CONF, None)
        conf.set(CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            conf.unset(CLEANUP_CONF) if before is None else conf.set(CLEANUP_CONF, before)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # frees what other queries have left, once the driver has collected their plans
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{name}" for name in names))

    def drop(self, name: str = "") -> None:
        jvm, path = self.spark.sparkContext._jvm, f"{self.root}/{name}".rstrip("/")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; Parquet file or folder of Parquet files."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def width(spark: SparkSession) -> int:
    """Number of tasks that a repartition aims at: what the session configures for shuffles, two per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def text_slices(batch, column: int, rows: int = 1000, size: int = 4_000_000):
    """Slices of an Arrow batch of at most ``rows`` rows and, unless a single row is larger, ``size`` bytes of text."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (held + n > size or k - start >= rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start, len(lengths) - start)


def ship(spark: SparkSession, path: str) -> str:
    """Send a driver's file (a vocabulary, a model) along with the job; the name to open it by on an executor."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Path of a file sent by :func:`ship`, on whatever machine this runs."""
    return SparkFiles.get(name)
