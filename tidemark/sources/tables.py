"""Readers of the raw tables.  Every cell is read as text and cast to a fixed list of columns; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the dumps, their types and defaults are fixed values of the input format.
#: column, type, value where the input has no such column; flags hold 't' or 'f', optional ones may be empty
POSTS = (
    ("id", "bigint", None),
    ("uploader_id", "bigint", None),
    ("created_at", "timestamp", None),
    ("md5", "string", None),
    ("source", "string", None),
    ("rating", "string", None),
    ("image_width", "int", None),
    ("image_height", "int", None),
    ("tag_string", "string", ""),
    ("locked_tags", "string", ""),
    ("fav_count", "int", 0),
    ("file_ext", "string", None),
    ("parent_id", "optional bigint", None),
    ("change_seq", "bigint", None),
    ("approver_id", "optional bigint", None),
    ("file_size", "bigint", None),
    ("comment_count", "int", 0),
    ("description", "string", ""),
    ("duration", "optional string", None),
    ("updated_at", "timestamp", None),
    ("is_deleted", "flag", False),
    ("is_pending", "flag", False),
    ("is_flagged", "flag", False),
    ("score", "int", 0),
    ("up_score", "int", 0),
    ("down_score", "int", 0),
    ("is_rating_locked", "flag", False),
    ("is_status_locked", "flag", False),
    ("is_note_locked", "flag", False),
)
#: the types of the columns of stored posts; the keys of their folders are among them
POST_KEYS = ("rating", "year", "month")
POST_TYPES = {n: {"flag": "boolean"}.get(k, k.removeprefix("optional ")) for n, k, _ in POSTS} | {"year": "string", "month": "string"}
POOLS = ("id", "name", "created_at", "updated_at", "creator_id", "description", "is_active", "category", "post_ids")


def read_text_csv(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """A CSV file with a header, every cell as text (empty ones null); names are stripped.

    Cells may hold line breaks and doubled quotes; without `multiline` large files are split between tasks."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE")
    return df.toDF(*(c.strip() for c in df.columns))


def _cast(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "flag":
        return c == "t"
    if kind.startswith("optional "):
        return F.nullif(c, F.lit("")).cast(kind.removeprefix("optional "))
    return c.cast(kind)


def normalize_posts(raw: DataFrame) -> DataFrame:
    """The fixed columns of items, strictly cast, with year and month as text.  A missing column gets its default."""
    have = set(raw.columns)
    plain = {"flag": "boolean"}
    columns = [(_cast(n, k) if n in have else F.lit(d).cast(plain.get(k, k.removeprefix("optional ")))).alias(n) for n, k, d in POSTS]
    return raw.select(*columns).withColumns({"year": F.date_format("created_at", "yyyy"), "month": F.date_format("created_at", "MM")})


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return normalize_posts(read_text_csv(spark, path))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """tag_id, tag, category, post_count; lenient casts, a missing column is null, a missing count 0."""
    raw = read_text_csv(spark, path, multiline=False)
    text = {c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string") for c in ("id", "name", "category", "post_count")}
    return raw.select(text["id"].try_cast("bigint").alias("tag_id"), text["name"].alias("tag"), text["category"].try_cast("int").alias("category"), F.coalesce(text["post_count"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("post_count"))


def read_name_pairs(spark: SparkSession, path: str | None) -> DataFrame:
    """antecedent_name, consequent_name, status, line of aliases or implications; headers in any case; no file, no rows.

    `line` grows along the file, so that a later row can win."""
    names = ("antecedent_name", "consequent_name", "status")
    if path is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names) + ", line bigint")
    raw = read_text_csv(spark, path)
    low = {c.lower(): c for c in raw.columns}
    return raw.select(*((F.col(f"`{low[n]}`") if n in low else F.lit(None).cast("string")).alias(n) for n in names), F.monotonically_increasing_id().alias("line"))


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_csv(spark, path)
    if missing := [c for c in POOLS if c not in raw.columns]:
        raise ValueError(f"the collections lack the columns {missing}")
    return raw.select(*POOLS)


def read_stored_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts from their partitioned folder; the given types keep month '01' text whether or not the session infers types."""
    return spark.read.schema(", ".join(f"`{n}` {t}" for n, t in POST_TYPES.items())).parquet(path)


def read_post_tags(spark: SparkSession, path: str) -> DataFrame:
    """post_id and tag_id of either layout: tag_shard folders, or one folder for each tag_id."""
    df = spark.read.parquet(path)
    return df.select(F.col("post_id").cast("bigint").alias("post_id"), F.col("tag_id").cast("int").alias("tag_id"))


def of_tag(post_tags: DataFrame, tag_id: int, shards: int = 256) -> DataFrame:
    """Rows of one tag; on the sharded layout only its shard's files are read."""
    rows = post_tags.where(F.col("tag_id") == tag_id)
    return rows.where(F.col("tag_shard") == tag_id % shards) if "tag_shard" in post_tags.columns else rows
