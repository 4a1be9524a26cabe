"""Validation of a build's folder: what each dataset must look like, as rows of check, status and detail.

A dataset that isn't there is a WARN, since not every build has all of them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checks, pools, stats, vectors
from tidemark.settings import Settings
from tidemark.sources import files, sinks, tables

Check = Callable[[SparkSession, Settings], list[DataFrame]]
#: name: datasets that must be there, what makes the rows
CHECKS: dict[str, tuple[list[str], Check]] = {}
#: vectors that are looked at one by one
SAMPLE = 64
ARRAYS = {"post_id": "<i8", "epoch_day": "<i4", "w": "<i4", "h": "<i4", "score": "<i4", "fav_count": "<i4", "is_deleted": "|i1", "is_pending": "|i1"}


def check(name: str, *needs: str) -> Callable[[Check], Check]:
    def put(f: Check) -> Check:
        CHECKS[name] = list(needs), f
        return f

    return put


def _read(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    own = {"post_tags": tables.read_post_tags, "posts_parquet": tables.read_stored_posts}
    return own[name](spark, s.at(name)) if name in own else spark.read.parquet(s.at(name))


@check("posts schema", "posts_parquet")
def _posts(spark: SparkSession, s: Settings) -> list[DataFrame]:
    return [checks.posts_schema_check(spark, s.at("posts_parquet"))]


@check("post_tags", "post_tags")
def _post_tags(spark: SparkSession, s: Settings) -> list[DataFrame]:
    pairs = _read(spark, s, "post_tags")
    return [checks.schema_check(pairs, "post_tags schema", checks.POST_TAGS), checks.verdict(checks.duplicate_pairs(pairs), "post_tags has no pair twice", F.count("*"))]


@check("tags_dict schema", "tags_dict")
def _tags_dict(spark: SparkSession, s: Settings) -> list[DataFrame]:
    return [checks.schema_check(_read(spark, s, "tags_dict"), "tags_dict schema", checks.TAGS_DICT)]


@check("columns", "post_columns", "rating_sets", "posts_parquet")
def _columns(spark: SparkSession, s: Settings) -> list[DataFrame]:
    posts, columns = _read(spark, s, "posts_parquet"), _read(spark, s, "post_columns")
    rated = posts.where(F.col("rating").isin("s", "q", "e")).select("id").distinct().count()
    sets = checks.rating_faults(_read(spark, s, "rating_sets"))
    return [
        checks.verdict(checks.ascending_faults(columns), "post columns ascend by id", F.count("*")),
        checks.verdict(sets, "rating sets share nothing", F.sum("shared")),
        checks.verdict(sets, "rating sets hold all rated posts", F.abs(F.coalesce(F.sum("all"), F.lit(0)) - F.lit(rated))),
    ]


@check("arrays", "post_columns", "features/post_id.bin")
def _arrays(spark: SparkSession, s: Settings) -> list[DataFrame]:
    posts = _read(spark, s, "post_columns").count()
    sizes = [(c, files.length(spark, s.at(f"features/{c}.bin")), posts * int(t[-1])) for c, t in ARRAYS.items()]
    wrong = [c for c, have, want in sizes if have != want]
    ids = sinks.read_array(spark, s.at("features"), "post_id", ARRAYS["post_id"])
    stored = ids.join(ids.select((F.col("row") + 1).alias("row"), F.col("value").alias("before")), "row").where("value <= before")
    return [spark.createDataFrame([("arrays are equally long", "FAIL" if wrong else "PASS", ", ".join(wrong))], checks.REPORT), checks.verdict(stored, "array of ids ascends", F.count("*"))]


@check("index", "tag_bitmaps", "post_tags")
def _index(spark: SparkSession, s: Settings) -> list[DataFrame]:
    return [checks.verdict(checks.bitmap_faults(_read(spark, s, "tag_bitmaps"), _read(spark, s, "post_tags")), "index equals relation", F.count("*"))]


@check("packs", "packs", "post_tags")
def _packs(spark: SparkSession, s: Settings) -> list[DataFrame]:
    packs = sinks.read_packs(spark, s.at("packs"))
    faults = checks.index_faults(packs.select("tag_id", "post_ids"), _read(spark, s, "post_tags"))
    return [checks.verdict(checks.pack_faults(packs), "packs have no gaps and ascend", F.count("*")), checks.verdict(faults, "packs equal relation", F.count("*"))]


@check("topk", "tag_topk", "post_tags", "posts_parquet")
def _topk(spark: SparkSession, s: Settings) -> list[DataFrame]:
    ranked = stats.topk_posts(_read(spark, s, "post_tags"), _read(spark, s, "posts_parquet"), **s.of("ranking"))
    return [checks.verdict(checks.topk_faults(stats.stored_topk(_read(spark, s, "tag_topk")), ranked), "stored lists equal ranked ones", F.count("*"), "WARN")]


@check("pools", "pool_entropy", "pool_edges", "tag_co")
def _pools(spark: SparkSession, s: Settings) -> list[DataFrame]:
    return [checks.pool_checks(*(_read(spark, s, x) for x in ("pool_entropy", "pool_edges", "tag_co")))]


@check("dump", "db.csv", "posts_parquet")
def _dump(spark: SparkSession, s: Settings) -> list[DataFrame]:
    facts = checks.reconcile(tables.read_posts(spark, s.at("db.csv")), _read(spark, s, "posts_parquet"), "id", []).drop("side")
    return [checks.verdict(facts.distinct(), "posts equal their dump", F.count("*") - 1)]


@check("manifest", "manifest")
def _manifest(spark: SparkSession, s: Settings) -> list[DataFrame]:
    faults = checks.manifest_diff(files.read_manifest(spark, s.at("manifest")), files.manifest(spark, s.at("posts_parquet")))
    return [checks.verdict(faults, "files equal their manifest", F.count("*"), "WARN")]


@check("vectors", "post2vec", "post2vec_rows", "post_tags", "posts_parquet", "tag2vec")
def _vectors(spark: SparkSession, s: Settings) -> list[DataFrame]:
    found, rows, dims = _read(spark, s, "post2vec"), _read(spark, s, "post2vec_rows"), int(s.of("embedding")["dim"])
    sample = found.orderBy(F.xxhash64("post_id")).limit(SAMPLE)
    known = _read(spark, s, "tags_stats") if files.modified(spark, s.at("tags_stats/_SUCCESS")) is not None else None
    its = _read(spark, s, "post_tags").join(F.broadcast(sample.select("post_id")), "post_id", "left_semi")
    posts = _read(spark, s, "posts_parquet").join(F.broadcast(sample.select(F.col("post_id").alias("id"))), "id", "left_semi")
    again = vectors.post2vec(its, posts, _read(spark, s, "tag2vec"), dims, known, s.reliable_only)
    return [
        checks.verdict(checks.vector_faults(found, "post_id", "vec", dims), "vectors are unit or zero", F.count("*")),
        checks.verdict(checks.row_map_faults(rows), "rows are 0 to n - 1", F.count("*")),
        checks.equal_fingerprints(found, rows, "post_id", "rows and vectors have the same ids"),
        checks.verdict(checks.recomputed_faults(sample, again, "post_id", "vec"), "vectors can be computed again", F.count("*")),
        checks.verdict(checks.self_faults(found, sample, "post_id", "vec"), "vectors are nearest to themselves", F.count("*")),
    ]


@check("neighbours", "tag2vec_knn")
def _neighbours(spark: SparkSession, s: Settings) -> list[DataFrame]:
    return [checks.verdict(checks.neighbour_faults(_read(spark, s, "tag2vec_knn")), "neighbours are others", F.count("*"))]


@check("speed", "posts_parquet", "post_tags")
def _speed(spark: SparkSession, s: Settings) -> list[DataFrame]:
    """Seconds of three reads; it always passes."""
    took = []
    for what, read in (("count", lambda: _read(spark, s, "post_tags").count()), ("one tag", lambda: tables.of_tag(spark.read.parquet(s.at("post_tags")), 1, int(s.of("shards")["shards"])).count()), ("ids", lambda: _read(spark, s, "posts_parquet").agg(F.max("id")).first())):
        began = time.time()
        read()
        took.append(f"{what} {time.time() - began:.2f} s")
    return [spark.createDataFrame([("speed", "PASS", ", ".join(took))], checks.REPORT)]


def validate(spark: SparkSession, settings: Settings) -> DataFrame:
    """check, status, detail of all checks of what is in the settings' folder."""
    out = []
    for name, (needs, make) in CHECKS.items():
        missing = [x for x in needs if files.modified(spark, settings.at(x)) is None]
        out += make(spark, settings) if not missing else [spark.createDataFrame([(name, "WARN", f"no {', '.join(missing)}")], checks.REPORT)]
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found
