"""Writers: partitioned Parquet, packed posting lists, aligned column arrays, id sets, run metadata, freshness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codec, roaring
from tidemark.sources import files
from tidemark.storage import written

#: rows of a file, so that a large month or shard is many files
FILE_ROWS = 5_000_000


def _partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Rows of a folder are brought together, so files are few; adaptive execution splits a folder that is too large for a task."""
    out = rows.hint("rebalance", *by).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    out.option("parquet.block.row.count.limit", "1000000").partitionBy(*by).parquet(path)


def write_posts(posts: DataFrame, path: str) -> None:
    """Partitioned by rating, year and month."""
    _partitioned(posts, path, "rating", "year", "month")


def write_post_tags(post_tags: DataFrame, path: str, shards: int = 256) -> None:
    _partitioned(post_tags.withColumn("tag_shard", F.pmod(F.col("tag_id"), F.lit(shards)).cast("int")), path, "tag_shard")


def write_pool_posts(long: DataFrame, path: str, shard_size: int = 1000) -> None:
    _partitioned(long.withColumn("pool_shard", F.floor(F.col("pool_id") / shard_size).cast("bigint")), path, "pool_shard")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


_PACK = "shard int, tag_id int, offset long, length int, blob binary"
#: how a list becomes a blob and comes back
CODINGS = {"delta": (codec.encode, codec.decode), "roaring": (roaring.dump, roaring.load)}


def packed_lists(lists: DataFrame, shards: int = 256, coding: str = "delta") -> DataFrame:
    """shard, tag_id, offset, length, blob of ascending id lists (tag_id, post_ids): where each blob stands in its shard's pack.

    One partition holds whole shards, in the order of tags; a row is one list, so memory is bounded by the longest list."""
    encode = CODINGS[coding][0]
    sharded = lists.withColumn("shard", F.pmod(F.col("tag_id"), F.lit(shards)).cast("int")).select("shard", F.col("tag_id").cast("int").alias("tag_id"), "post_ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset = None, 0
        for batch in batches:
            rows = []
            for s, tag, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, offset = s, 0
                blob = encode(ids)
                rows.append((s, tag, offset, len(blob), blob))
                offset += len(blob)
            if rows:
                s, t, o, n, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(o, pa.int64()), pa.array(n, pa.int32()), pa.array(b, pa.binary())], names=[x.split()[0] for x in _PACK.split(", ")])

    return sharded.repartition(shards, "shard").sortWithinPartitions("shard", "tag_id").mapInArrow(pack, _PACK)


def export_packs(packs: DataFrame, folder: str) -> int:
    """A pack and an index file for each shard; the driver passes on one row at a time.  Returns the number of lists."""
    spark, n, shard = packs.sparkSession, 0, None
    with ExitStack() as open_:
        for r in packs.orderBy("shard", "tag_id").toLocalIterator(prefetchPartitions=True):
            if r["shard"] != shard:
                open_.pop_all().close()
                shard = r["shard"]
                blob, index = (open_.enter_context(files.opened(spark, f"{folder}/{name}")) for name in (f"shard_{shard:04d}.pack", f"index_{shard:04d}.bin"))
            blob(r["blob"])
            index(codec.INDEX_RECORD.pack(r["tag_id"], r["offset"], r["length"]))
            n += 1
    return n


_INDEX = np.dtype([("tag_id", "<i4"), ("offset", "<i8"), ("length", "<i4")])


def read_packs(spark: SparkSession, folder: str, coding: str = "delta") -> DataFrame:
    """shard, tag_id, offset, length, gap, post_ids of exported packs; gap: bytes between a blob and the one before (0 in a
    sound pack).  A shard's two files are one task's; a blob beyond its pack or one that can't be decoded is an error."""
    decode = CODINGS[coding][1]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*_*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    shard = F.regexp_extract(name, r"_([0-9]+)\.", 1).cast("int").alias("shard")
    index = raw.where(F.startswith(name, F.lit("index_"))).select(shard, F.col("content").alias("records"))
    pack = raw.where(F.startswith(name, F.lit("shard_"))).select(shard, "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, records, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(records, _INDEX)
                end = found["offset"] + found["length"]
                if len(found) and (end.max() > len(content) or found["offset"].min() < 0):
                    raise ValueError(f"a record of shard {s} points beyond its pack")
                ids = [decode(content[a:b]) for a, b in zip(found["offset"].tolist(), end.tolist(), strict=True)]
                gap = found["offset"] - np.concatenate([[0], end[:-1]]) if len(found) else found["offset"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), s, np.int32)), *(pa.array(np.ascontiguousarray(found[c])) for c in ("tag_id", "offset", "length")), pa.array(gap.astype(np.int64)), pa.array(ids, pa.list_(pa.int64()))], names=["shard", "tag_id", "offset", "length", "gap", "post_ids"])

    both = index.join(pack, "shard", "left").select("shard", "records", F.coalesce("content", F.lit(b"")).alias("content"))  # an empty pack isn't listed
    return both.mapInArrow(unpack, "shard int, tag_id int, offset long, length int, gap long, post_ids array<long>")


def export_roaring(ids: DataFrame, id_col: str, path: str) -> int:
    """One portable roaring file of a set of 32-bit ids; containers are made in the executors and pass one at a time."""
    spark = ids.sparkSession
    made = written(roaring.containers(ids, id_col, []), "containers")
    found = made.select("key", "cardinality").orderBy("key").collect()  # 65,536 at most
    bodies = (bytes(r["body"]) for r in made.select("key", "body").orderBy("key").toLocalIterator(prefetchPartitions=True))
    files.put(spark, path, (x for part in ([roaring.header([r["key"] for r in found], [r["cardinality"] for r in found])], bodies) for x in part))
    return sum(r["cardinality"] for r in found)


def read_roaring(spark: SparkSession, path: str) -> DataFrame:
    """id of a roaring file."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(roaring.load(content.as_py()), pa.int64())], names=["id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "id long")


#: rows of an array that reach the driver at once
ARRAY_PART = 1 << 19
#: values that a task hands on at once
ARRAY_BATCH = 1 << 16


def export_arrays(columns: DataFrame, folder: str, types: dict[str, str]) -> int:
    """A raw little-endian file of each column, aligned on the rows in the order of the first column; null is 0.

    Executors turn their rows into bytes, the driver passes whole batches on; it holds two parts of about ARRAY_PART rows at
    most.  Returns the number of rows."""
    names = list(types)
    filled = columns.select(*(F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in names))
    filled = filled.repartitionByRange(max(1, -(-filled.count() // ARRAY_PART)), names[0]).sortWithinPartitions(names[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = [pa.array([batch.column(i).to_numpy().astype(types[c]).tobytes()], pa.binary()) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *bytes_], names=["rows", *names])

    packed = filled.mapInArrow(pack, "rows long, " + ", ".join(f"`{c}` binary" for c in names))
    n = 0
    with ExitStack() as open_:
        write = [open_.enter_context(files.opened(columns.sparkSession, f"{folder}/{c}.bin")) for c in names]
        for r in packed.toLocalIterator(prefetchPartitions=True):
            n += r["rows"]
            for c, put in zip(names, write, strict=True):
                put(r[c])
    return n


def read_array(spark: SparkSession, folder: str, column: str, type_: str) -> DataFrame:
    """row, value of one exported array, read as records of fixed length.

    Rows are many times the bytes of a narrow array, so what Spark expects of the file's size says nothing about them: joins
    are told to merge, never to broadcast."""
    size = np.dtype(type_).itemsize
    raw = spark.read.format("binaryFile").load(f"{folder}/{column}.bin").select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if len(data) % size:
                    raise ValueError(f"{column} doesn't hold whole numbers of {size} bytes")
                values = np.frombuffer(data, type_)
                for i in range(0, len(values), ARRAY_BATCH):
                    part = values[i : i + ARRAY_BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part.astype(np.int64))], names=["row", "value"])

    return raw.mapInArrow(unpack, "row long, value long").hint("merge")


def row_map(df: DataFrame, id_col: str, first: int = 0) -> DataFrame:
    """row, id: consecutive rows from `first` in the order of the id, from a range-partitioned sort and the partitions' counts."""
    placed = df.select(F.col(id_col)).repartitionByRange(id_col).sortWithinPartitions(id_col)
    placed = written(placed.select(id_col, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n")), "rows")
    before = placed.groupBy("part").agg(F.count("*").alias("count"))  # a row for each partition
    before = before.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select((F.lit(first).cast("long") + F.col("before") + F.col("n")).alias("row"), id_col)


def append_vectors(found: DataFrame, path: str, rows_path: str, id_col: str = "post_id") -> int:
    """Adds the vectors (id, vec) of ids that the table at `path` lacks, and their rows after the last one of the row map.

    Vectors that are stored already keep their values and rows.  Returns the number of vectors added."""
    spark = found.sparkSession
    known = files.modified(spark, f"{path}/_SUCCESS") is not None
    new = written(found.join(spark.read.parquet(path).select(id_col), id_col, "left_anti") if known else found, "new-vectors")
    first = (spark.read.parquet(rows_path).agg(F.max("row")).first()[0] if known else None)
    rows = row_map(new, id_col, 0 if first is None else first + 1)
    for df, to in ((new, path), (rows, rows_path)):
        df.write.mode("append" if known else "overwrite").option("compression", "zstd").parquet(to)
    return new.count()


def write_metadata(spark: SparkSession, path: str, **found: object) -> None:
    """A JSON file of what a run did."""
    files.put(spark, path, [json.dumps(found, indent=1, default=float).encode()])


def read_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def fresh(spark: SparkSession, output: str, inputs: list[str], force: bool = False) -> bool:
    """Whether a step may be skipped: its _SUCCESS is there and no input is newer."""
    made = None if force else files.modified(spark, f"{output}/_SUCCESS")
    return made is not None and all((t := files.modified(spark, i)) is None or t <= made for i in inputs)
