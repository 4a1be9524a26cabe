"""Incremental ingestion: new dump files are normalised and folded into the item-tag relation and its counts as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.relation import post_tags
from tidemark.sources.tables import POSTS, normalize_posts


def post_stream(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """A stream of normalised items from CSV files that appear in a folder; all cells are text there, in the fixed columns."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n, _, _ in POSTS])
    raw = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", max_files).csv(folder)
    return normalize_posts(raw)


def ingest(posts: DataFrame, tags: DataFrame, aliases: DataFrame, out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch's pairs go to a folder of their own, which a repeated batch overwrites: exactly once in effect."""

    def fold(batch: DataFrame, epoch: int) -> None:
        pairs = post_tags(batch, tags, aliases)
        pairs.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if after:
            after(pairs, epoch)

    return posts.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The relation over all batches; a pair that came twice counts once."""
    return spark.read.option("basePath", out).parquet(out).select("post_id", "tag_id").distinct()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and key; rows later than the watermark are left out when this is a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
