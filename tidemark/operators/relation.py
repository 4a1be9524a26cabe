"""The item-tag relation and what is stored of it: dictionary, inverted index, aligned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aliases import canonical


def reliable(posts: DataFrame) -> DataFrame:
    """Posts that are neither deleted nor pending; an unknown flag drops the post."""
    return posts.where(~F.col("is_deleted") & ~F.col("is_pending"))


def post_tags(posts: DataFrame, tags: DataFrame, aliases: DataFrame, reliable_only: bool = True) -> DataFrame:
    """post_id, tag_id: distinct pairs of the known tags in tag_string, by canonical name.

    Names are split at single blanks.  Pairs are deduplicated over the whole table."""
    rows = reliable(posts) if reliable_only else posts
    named = rows.select(F.col("id").alias("post_id"), F.explode(F.split("tag_string", " ", -1)).alias("tag")).where("tag is not null")
    named = canonical(named, "tag", aliases)
    known = tags.select("tag", F.col("tag_id").cast("int").alias("tag_id"))
    return named.join(known, "tag").select("post_id", "tag_id").distinct()


def tags_dict(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """The tags that some post has."""
    used = pairs.select(F.col("tag_id").cast("bigint").alias("tag_id")).distinct()
    return tags.join(used, "tag_id", "left_semi").select("tag_id", "tag", "category", "post_count")


def inverted_index(pairs: DataFrame) -> DataFrame:
    """tag_id, post_ids (distinct, ascending), as packed exports need them.  A list is as long as its tag is frequent; the
    stored index is bitmap_index, whose rows are bounded."""
    return pairs.groupBy("tag_id").agg(F.array_sort(F.collect_set("post_id")).alias("post_ids"))


def bitmap_index(pairs: DataFrame) -> DataFrame:
    """tag_id, bucket, bits: posts of a tag as bitmaps of 32,768 ids each, whatever the tag's frequency."""
    bucket = F.bitmap_bucket_number("post_id").alias("bucket")
    return pairs.groupBy("tag_id", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("post_id")).alias("bits"))


def index_sizes(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("tag_id").agg(F.sum(F.bitmap_count("bits")).alias("posts"))


def post_columns(posts: DataFrame) -> DataFrame:
    """The narrow columns of all posts; an unknown number stays null.  Exporters order them by id."""
    return posts.select(
        F.col("id").cast("bigint").alias("post_id"),
        F.unix_date(F.to_date("created_at")).alias("epoch_day"),
        F.col("image_width").cast("int").alias("w"),
        F.col("image_height").cast("int").alias("h"),
        F.col("score").cast("int").alias("score"),
        F.col("fav_count").cast("int").alias("fav_count"),
        F.col("is_deleted").cast("tinyint").alias("is_deleted"),
        F.col("is_pending").cast("tinyint").alias("is_pending"),
    )


def rating_sets(posts: DataFrame) -> DataFrame:
    """rating, bucket, bits of the ratings s, q and e."""
    bucket = F.bitmap_bucket_number("id").alias("bucket")
    return posts.where(F.col("rating").isin("s", "q", "e")).groupBy("rating", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
