"""Tables written to the folder that every executor shares, to cut lineage and to read a costly result more than once;
broadcasts; and the release of both."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FALLBACK: dict[str, str] = {}
_SCOPES: list[list[object]] = []
#: tables up to so many bytes are broadcast, larger ones are joined by a shuffle
BROADCAST_BYTES = 16 << 20
#: bytes of the batches that Python workers get; Spark's own bound is a number of rows, whose texts may be long
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.  Only where it is unset (a local session, as in tests) a temporary folder is taken."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and an executor that dies takes nothing with it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by `written` once nothing reads it any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, f)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a value whose size is bounded."""
    out = spark.sparkContext.broadcast(value)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[list[object]]:
    """Collects what `written` and `shared` make inside, for `release` once the result has been written."""
    held: list[object] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)


def release(spark: SparkSession, held: list[object]) -> None:
    for x in held:
        if isinstance(x, str):
            _delete(spark, x)
        else:
            x.unpersist()
    held.clear()


def _width(f: T.StructField) -> Column:
    """Bytes of a column's value, 8 at least; an array's are those of as many fixed elements."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.lit(8) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(f.dataType, T.ArrayType):
        return F.lit(8) + F.greatest(F.size(c), F.lit(0)) * (8 * (1 + len(getattr(f.dataType.elementType, "fields", [0]))))
    return F.lit(8 * max(1, len(getattr(f.dataType, "fields", [0]))))


def few(df: DataFrame) -> DataFrame:
    """The written table marked for a broadcast if its bytes, counted here, are at most BROADCAST_BYTES; else as it is."""
    width = F.lit(24)
    for f in df.schema.fields:
        width = width + _width(f)
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def identity(*columns: Column) -> Column:
    """Two 64-bit hashes of the columns, chained in opposite orders."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("h2"))


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session hand batches of at most BATCH_BYTES to Python workers; a smaller bound that it has stays."""
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
