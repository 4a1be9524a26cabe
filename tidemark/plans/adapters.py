"""The driver tables in the roles of the domain: orders as posts, part names as tags, customers' orders as collections.

Each role exists twice, as a DataFrame and as a CTE of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "P", "s").when(status == "F", "q").otherwise("e").alias("rating"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("fav_count"),
        (F.col("o_custkey") % 100).cast("int").alias("score"),
        F.lit(False).alias("is_deleted"),
        (status == "P").alias("is_pending"),
        F.lit(None).cast("int").alias("image_width"),
        F.lit(None).cast("int").alias("image_height"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("tag")).agg(F.count("*").alias("post_count"))
    place = (F.row_number().over(Window.orderBy("tag")) - 1).cast("bigint")  # a few dozen names
    return names.select(place.alias("tag_id"), "tag", F.lit(0).alias("category"), "post_count")


def post_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tags(spark, sf_dir).select(F.col("tag").alias("p_name"), F.col("tag_id").cast("int").alias("tag_id"))
    of_part = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(F.broadcast(names), "p_name").select("p_partkey", "tag_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("p_partkey"))
    return lines.join(of_part, "p_partkey").select("post_id", "tag_id").distinct()


def fine_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag_id"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("tag"), F.lit(0).alias("category"), F.col("p_size").cast("bigint").alias("post_count"))


def fine_post_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("tag_id")).distinct()


def pool_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = pools_meta(spark, sf_dir).select("pool_id")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pool_id"), F.col("o_orderkey").alias("post_id")).join(meta, "pool_id", "left_semi")


def pools_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pool_id")).agg(F.count("*").cast("int").alias("size")).where(F.col("size").between(3, 200))
    series = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pool_id"), F.when(series, "series").otherwise("collection").alias("category"), F.col("c_nationkey").cast("bigint").alias("creator_id"))
    return sizes.join(who, "pool_id").select("pool_id", "size", "category", "creator_id")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.vector import normalised

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tag_id"), normalised(F.col("embedding")).alias("vec"))


POSTS = """posts AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 's' WHEN 'F' THEN 'q' ELSE 'e' END AS rating,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS fav_count, CAST(o_custkey % 100 AS INTEGER) AS score, o_orderstatus = 'P' AS is_pending FROM orders)"""
TAGS = "tags AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS tag_id, p_name AS tag, count(*) AS post_count FROM part GROUP BY p_name)"
PAIRS = f"{TAGS}, pairs AS (SELECT DISTINCT l_orderkey AS post_id, tag_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tags ON tag = p_name)"
FINE = """tags AS (SELECT p_partkey AS tag_id, CAST(p_size AS BIGINT) AS post_count FROM part),
pairs AS (SELECT DISTINCT l_orderkey AS post_id, l_partkey AS tag_id FROM lineitem)"""
POOLS = """meta AS (SELECT s.pool_id, s.size, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'series' ELSE 'collection' END AS category
  FROM (SELECT o_custkey AS pool_id, count(*) AS size FROM orders GROUP BY 1 HAVING count(*) BETWEEN 3 AND 200) s JOIN customer ON c_custkey = s.pool_id),
members AS (SELECT o_custkey AS pool_id, o_orderkey AS post_id FROM orders JOIN meta ON pool_id = o_custkey)"""
