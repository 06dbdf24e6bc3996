"""Files that tasks write into, and read from, the folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def shared_folder(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that names, for tasks too, the file system Spark's own configuration takes it for.

    A path without a scheme lies on Spark's default file system, which on a
    cluster need not be the task's own disk. A scheme that tasks have no way to
    write is a ``ValueError``, before any work is done.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme() is None:
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    scheme, _, rest = path.toUri().toString().partition(":")
    if scheme not in _SCHEMES:
        raise ValueError(f"tasks cannot write files to {scheme}: paths ({folder}); use one of {', '.join(_SCHEMES)}")
    return f"{_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def create(folder: str, suffix: str):
    """A new file that no other attempt of a task can hit: its path and an output stream.

    A file counts only once its path stands in a manifest that Spark has
    committed; what a lost attempt leaves behind is never read.
    """
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, place = open_fs(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(place, compression=None)


def open_input(path: str):
    system, place = open_fs(path)
    return system.open_input_file(place)
