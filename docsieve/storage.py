"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_INNER = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    All folders of an application lie in one, which goes when the driver's JVM ends, or by clean_up(). Where the session names no
    folder, one of this machine serves a local master; with any other, executors couldn't read what they didn't write.
    """
    if homes := getattr(_INNER, "homes", []):
        return f"{homes[-1]}/{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "/tmp/docsieve-shared"
        home = f"{base.rstrip('/')}/docsieve-{sc.applicationId}-{uuid.uuid4().hex}"
        at, fs = _file_system(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _FOLDERS[sc.applicationId] = home
    return f"{_FOLDERS[sc.applicationId]}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them can't be used after that."""
    if home := _FOLDERS.pop(spark.sparkContext.applicationId, None):
        at, fs = _file_system(spark, home)
        fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside, by this thread, are deleted at the end, on failure too; for work that repeats, as a stream's."""
    home = shared_dir(spark)
    _INNER.homes = [*getattr(_INNER, "homes", []), home]
    try:
        yield
    finally:
        _INNER.homes = _INNER.homes[:-1]
        at, fs = _file_system(spark, home)
        fs.delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_for_files(spark: SparkSession) -> tuple[str, str]:
    """(path, address for write_file) of a new empty folder of the shared one."""
    path = shared_dir(spark)
    at, fs = _file_system(spark, path)
    fs.mkdirs(at)
    return path, re.sub(r"^file:/+", "file:///", fs.makeQualified(at).toString())


def write_file(uri: str, name: str, content: bytes) -> None:
    """One file, from a task; it is replaced where a task runs again."""
    files, folder = FileSystem.from_uri(uri)
    with files.open_output_stream(f"{folder}/{name}") as out:
        out.write(content)
