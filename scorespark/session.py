"""Session settings, the shared scratch folder and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "scorespark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="scorespark-")
        spark.sparkContext.setCheckpointDir(root)
    if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must be a folder every executor can reach, not a file: path")
    return f"{root.rstrip('/')}/scorespark-{spark.sparkContext.applicationId}"


_OPENED: ContextVar[tuple[list[str], ...]] = ContextVar("opened", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared scratch folder."""
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for paths in _OPENED.get():
        paths.append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, what was staged inside it: write or collect a result before.

    ``with staging(spark): query(spark, path).write.parquet(target)`` leaves ``target`` and nothing else.
    """
    paths: list[str] = []
    token = _OPENED.set((*_OPENED.get(), paths))
    try:
        yield
    finally:
        _OPENED.reset(token)
        for path in paths:
            delete_path(spark, path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For frames that several passes read: it cuts the lineage, survives lost
    executors and keeps column pruning and filter pushdown for the later passes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Path and file system as the cluster's own configuration sees them."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _hadoop(spark, path)
    if fs.exists(hadoop_path):
        fs.delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is absent."""
    hadoop_path, fs = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return None
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old text or the new one, never a part."""
    new, fs = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, options)


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of a file, or of a folder's files but hidden ones, in order."""
    hadoop_path, fs = _hadoop(spark, path)
    found = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hadoop_path) if s.isFile()]
    return sorted(f for f in found if not f[0].rpartition("/")[2].startswith(("_", ".")))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, unpacked where its name says it is packed."""
    hadoop_path, fs = _hadoop(spark, path)
    jvm = spark._jvm
    stream = fs.open(hadoop_path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hadoop_path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        stream if codec is None else codec.createInputStream(stream), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def release_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; call when no frame reads them any more."""
    delete_path(spark, scratch_dir(spark))
