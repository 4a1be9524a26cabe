"""Single files on any file system that Spark knows, and manifests of folders."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file or folder was changed last; null if there is none."""
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None


def length(spark: SparkSession, path: str) -> int | None:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) else None


def remove(spark: SparkSession, path: str) -> None:
    """The file or folder, if there is one."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def opened(spark: SparkSession, path: str):
    """A stream that replaces the file; what is written to it is bytes."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        yield lambda data: out.write(bytearray(data))
    finally:
        out.close()


def put(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    with opened(spark, path) as write:
        for part in parts:
            write(part)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes and digest (SHA-256) of each file; the files of a build are of bounded size."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.element_at(F.split("path", F.lit(folder.rstrip("/").rpartition("/")[2] + "/"), 2), 2)
    return rows.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def write_manifest(spark: SparkSession, folder: str, path: str) -> None:
    manifest(spark, folder).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, bytes long, digest string").json(path)
