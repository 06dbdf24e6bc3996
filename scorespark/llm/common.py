"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorespark.session import scratch_path, stage

SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this operator wrote and nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def refuse_columns(df: DataFrame, *names: str) -> None:
    """A ``ValueError`` for columns of ``df`` that an operator would add itself."""
    taken = [c for c in df.columns if c.lower() in names]
    if taken:
        raise ValueError(f"rename these columns first, the result has its own: {', '.join(taken)}")


_HEAP_SHARE = 1 / 3


def relieve_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage once a third of its heap is in use.

    Spark drops the broadcasts and shuffles of a finished job only when the
    driver's garbage collector meets their owners, so a job of hundreds of
    short ones else fills the heap with what nobody reads any more.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() >= _HEAP_SHARE * heap.maxMemory():
        gc.collect()
        spark._jvm.java.lang.System.gc()


class Staged:
    """Parquet copies of intermediate frames; ``drop`` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{what}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[what] = path
        relieve_driver(self.spark)
        return out

    def drop(self, *what: str) -> None:
        for x in what:
            if x in self.paths:
                drop_path(self.spark, self.paths.pop(x))


_HELD: list = [None, None]


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the C library's where it is glibc."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def claim(owner: str, release=None) -> None:
    """Say that this Python worker now works for ``owner``: what the last one left in the process is released.

    Spark hands one worker to one operator after another, and stores that help
    between the tasks of one would else fill the memory of the next.
    """
    if _HELD[0] != owner:
        if _HELD[1]:
            _HELD[1]()
        if _HELD[0]:
            give_back()
        _HELD[:] = owner, release


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer
    change. Each step is a minimum per node (combined map-side) and a join;
    no component is ever gathered in one task. Self-loops are ignored;
    without edges the result is empty.
    """
    spark = edges.sparkSession
    keep = Staged(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "0")
    seen, k = None, 0
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("n")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        k += 1
        e = keep(small, str(k))
        keep.drop(str(k - 1))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # at the fixpoint every node but the smallest of a component points at that smallest one
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


__all__ = ["SPACE", "table", "shuffle_partitions", "drop_path", "refuse_columns", "Staged", "claim", "mix64", "components", "stage", "scratch_path"]
