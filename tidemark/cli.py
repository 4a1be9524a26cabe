"""python -m tidemark.cli --root DATA --do STEP,...: builds the datasets of a folder of dumps, skipping what is up to date.

Steps run in the order of their dependencies; `pools` stands for its five steps; `validate` checks what is there and ends with
exit code 1 if a check fails.  Unknown names are an error.  --set GROUP.NAME=VALUE changes a setting (tidemark.settings).
--resolve NAME, --similar-tags NAME and --similar-posts ID look things up in what was built."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aliases, checks, graph, pools, relation, stats, vectors
from tidemark.session import session
from tidemark.settings import Settings
from tidemark.sources import files, sinks, tables
from tidemark.storage import written
from tidemark.validate import ARRAYS, validate

Build = Callable[[SparkSession, Settings], None]
#: name: inputs, output, what makes it
STEPS: dict[str, tuple[list[str], str, Build]] = {}
POOLS = ["pools_parse", "pools_entropy", "pools_edges", "pools_counts", "pools_tag_co"]


def step(name: str, inputs: list[str], output: str) -> Callable[[Build], Build]:
    def put(f: Build) -> Build:
        STEPS[name] = inputs, output, f
        return f

    return put


def _read(spark: SparkSession, c: Settings, name: str) -> DataFrame:
    return tables.read_stored_posts(spark, c.at(name)) if name == "posts_parquet" else spark.read.parquet(c.at(name))


def _put(c: Settings, name: str, df: DataFrame) -> None:
    sinks.write_table(df, c.at(name))


def _aliases(spark: SparkSession, c: Settings) -> DataFrame:
    path = c.at("tag_aliases.csv")
    return tables.read_name_pairs(spark, path if files.modified(spark, path) is not None else None)


def _alias_map(spark: SparkSession, c: Settings) -> DataFrame:
    return aliases.alias_map(tables.read_tags(spark, c.at("tags.csv")), _aliases(spark, c))


@step("parquet", ["db.csv"], "posts_parquet")
def parquet(spark: SparkSession, c: Settings) -> None:
    sinks.write_posts(tables.read_posts(spark, c.at("db.csv")), c.at("posts_parquet"))


@step("tags", ["posts_parquet", "tags.csv", "tag_aliases.csv"], "post_tags")
def tags(spark: SparkSession, c: Settings) -> None:
    known = tables.read_tags(spark, c.at("tags.csv"))
    sinks.write_post_tags(relation.post_tags(_read(spark, c, "posts_parquet"), known, _alias_map(spark, c), **c.of("relation")), c.at("post_tags"), **c.of("shards"))
    _put(c, "tags_dict", relation.tags_dict(known, tables.read_post_tags(spark, c.at("post_tags"))))


@step("implications", ["tags.csv", "tag_implications.csv", "tag_aliases.csv"], "tag_implications")
def implications(spark: SparkSession, c: Settings) -> None:
    known = tables.read_tags(spark, c.at("tags.csv"))
    path = c.at("tag_implications.csv")
    rows = tables.read_name_pairs(spark, path if files.modified(spark, path) is not None else None)
    _put(c, "tag_implications", graph.implication_dag(rows, known, _alias_map(spark, c)))
    _put(c, "tag_ancestors", graph.ancestor_cache(_read(spark, c, "tag_implications"), known, **c.of("ancestors")))


@step("bitmaps", ["post_tags"], "tag_bitmaps")
def bitmaps(spark: SparkSession, c: Settings) -> None:
    _put(c, "tag_bitmaps", relation.bitmap_index(tables.read_post_tags(spark, c.at("post_tags"))))


@step("columns", ["posts_parquet"], "post_columns")
def columns(spark: SparkSession, c: Settings) -> None:
    posts = _read(spark, c, "posts_parquet")
    _put(c, "rating_sets", relation.rating_sets(posts))
    _put(c, "post_columns", relation.post_columns(posts).sort("post_id"))


@step("stats", ["post_tags", "posts_parquet", "tags_dict"], "tags_stats")
def tag_statistics(spark: SparkSession, c: Settings) -> None:
    _put(c, "tags_stats", stats.tag_stats(_read(spark, c, "tags_dict"), tables.read_post_tags(spark, c.at("post_tags")), _read(spark, c, "posts_parquet"), **c.of("idf")))


@step("pmi", ["post_tags", "tags_dict"], "tag_pmi")
def pmi(spark: SparkSession, c: Settings) -> None:
    found = stats.tag_pmi(tables.read_post_tags(spark, c.at("post_tags")), _read(spark, c, "tags_dict"), **c.of("pairs"))
    _put(c, "tag_pmi", found.withColumn("pmi", F.col("pmi").cast("float")))


@step("topk", ["post_tags", "posts_parquet"], "tag_topk")
def topk(spark: SparkSession, c: Settings) -> None:
    _put(c, "tag_topk", stats.topk_posts(tables.read_post_tags(spark, c.at("post_tags")), _read(spark, c, "posts_parquet"), **c.of("ranking")))


@step("pools_parse", ["pools.csv"], "pool_posts")
def pools_parse(spark: SparkSession, c: Settings) -> None:
    meta, long = pools.parse_pools(tables.read_pools(spark, c.at("pools.csv")), **c.of("collections"))
    _put(c, "pools_meta", meta)
    sinks.write_pool_posts(long, c.at("pool_posts"), **c.of("collection-shards"))


def _stats_if_any(spark: SparkSession, c: Settings) -> DataFrame | None:
    return _read(spark, c, "tags_stats") if files.modified(spark, c.at("tags_stats/_SUCCESS")) is not None else None


def _long(spark: SparkSession, c: Settings) -> DataFrame:
    return _read(spark, c, "pool_posts").select("pool_id", "post_id")


def _eligible(spark: SparkSession, c: Settings) -> DataFrame:
    return pools.eligible_pools(_read(spark, c, "pool_entropy"), **c.of("eligible"))


@step("pools_entropy", ["pool_posts", "post_tags", "tags_stats"], "pool_entropy")
def pools_entropy(spark: SparkSession, c: Settings) -> None:
    _put(c, "pool_entropy", pools.pool_entropy(_read(spark, c, "pools_meta"), _long(spark, c), tables.read_post_tags(spark, c.at("post_tags")), _stats_if_any(spark, c)))


@step("pools_edges", ["pool_posts", "pool_entropy"], "pool_edges")
def pools_edges(spark: SparkSession, c: Settings) -> None:
    _put(c, "pool_edges", pools.pool_edges(_long(spark, c), _eligible(spark, c)))


@step("pools_counts", ["pool_posts", "pool_entropy", "posts_parquet"], "post_pool_counts")
def pools_counts(spark: SparkSession, c: Settings) -> None:
    _put(c, "post_pool_counts", pools.post_pool_counts(_read(spark, c, "posts_parquet"), _long(spark, c), _eligible(spark, c)))


@step("pools_tag_co", ["pool_posts", "pool_entropy", "post_tags", "tags_stats"], "tag_co")
def pools_tag_co(spark: SparkSession, c: Settings) -> None:
    _put(c, "tag_co", pools.pool_tag_co(_long(spark, c), tables.read_post_tags(spark, c.at("post_tags")), _eligible(spark, c), _stats_if_any(spark, c), **c.of("together")))


@step("packs", ["post_tags"], "packs")
def packs(spark: SparkSession, c: Settings) -> None:
    lists = relation.inverted_index(tables.read_post_tags(spark, c.at("post_tags")))
    sinks.export_packs(sinks.packed_lists(lists, **c.of("shards")), c.at("packs"))
    files.put(spark, c.at("packs/_SUCCESS"), [])


@step("arrays", ["post_columns", "posts_parquet"], "features")
def arrays(spark: SparkSession, c: Settings) -> None:
    sinks.export_arrays(_read(spark, c, "post_columns"), c.at("features"), ARRAYS)
    for rating in "sqe":
        sinks.export_roaring(_read(spark, c, "posts_parquet").where(F.col("rating") == rating), "id", c.at(f"features/rating_{rating}.roar"))
    files.put(spark, c.at("features/_SUCCESS"), [])


@step("tag2vec", ["tag_pmi", "tag_co", "tags_stats", "tags_dict"], "tag2vec")
def tag2vec(spark: SparkSession, c: Settings) -> None:
    began, found = time.time(), _stats_if_any(spark, c)
    universe = vectors.tag_universe(found if found is not None else _read(spark, c, "tags_dict"), **c.of("universe"))
    how = c.of("edges")
    need = {"pmi": ["tag_pmi"], "pools": ["tag_co"], "merge": ["tag_pmi", "tag_co"]}[how["source"]]
    parts = {n: _read(spark, c, n) for n in need}
    edges = written(vectors.tag_graph(universe, parts.get("tag_pmi"), parts.get("tag_co"), **how), "edges")
    vecs, sigma = vectors.tag2vec(vectors.ppmi(edges, **c.of("weights")), universe, **c.of("embedding"))
    _put(c, "tag2vec", vecs)
    _put(c, "tag2vec_knn", vectors.knn(_read(spark, c, "tag2vec"), c.of("neighbours")["k"]))
    facts = {"tags": universe.count(), "edges": edges.count(), "singular_values": sigma[:16], "seconds": round(time.time() - began, 1)}
    sinks.write_metadata(spark, c.at("tag2vec_meta.json"), **facts, settings={g: c.of(g) for g in ("universe", "edges", "weights", "embedding", "neighbours")})


@step("post2vec", ["tag2vec", "post_tags", "posts_parquet", "tags_stats"], "post2vec")
def post2vec(spark: SparkSession, c: Settings) -> None:
    """Vectors of new posts are added; where the tags' vectors are newer than the table, all are made again."""
    if not sinks.fresh(spark, c.at("post2vec"), [c.at("tag2vec"), c.at("tags_stats")], c.force):
        files.remove(spark, c.at("post2vec"))
        files.remove(spark, c.at("post2vec_rows"))
    found = vectors.post2vec(tables.read_post_tags(spark, c.at("post_tags")), _read(spark, c, "posts_parquet"), _read(spark, c, "tag2vec"), c.of("embedding")["dim"], _stats_if_any(spark, c), c.reliable_only)
    added = sinks.append_vectors(found.withColumn("vec", F.col("vec").cast("array<float>")), c.at("post2vec"), c.at("post2vec_rows"))
    sinks.write_metadata(spark, c.at("post2vec_meta.json"), added=added, dim=c.of("embedding")["dim"])


@step("manifest", ["posts_parquet"], "manifest")
def manifest(spark: SparkSession, c: Settings) -> None:
    files.write_manifest(spark, c.at("posts_parquet"), c.at("manifest"))


def _ids(spark: SparkSession, c: Settings, name: str) -> tuple[list[int], list[str]]:
    return aliases.resolve_tag(tables.read_tags(spark, c.at("tags.csv")), _aliases(spark, c), name)


def resolve(spark: SparkSession, c: Settings, name: str) -> list[str]:
    """Lines that say which tags a name stands for, or what it may mean."""
    found, near = _ids(spark, c, name)
    return [f"tag {i}" for i in found] or [f"maybe {x}" for x in near] or [f"nothing is like {name!r}"]


def similar_tags(spark: SparkSession, c: Settings, name: str, k: int = 10) -> list[str]:
    """Lines of similarity, id and name of the tags most like the first that a name stands for."""
    found, near = _ids(spark, c, name)
    if not found:
        return [f"maybe {x}" for x in near] or [f"nothing is like {name!r}"]
    rows = vectors.similar_tags(_read(spark, c, "tag2vec"), found[0], k, _read(spark, c, "tag2vec_knn"))
    rows = rows.join(tables.read_tags(spark, c.at("tags.csv")).select(F.col("tag_id").alias("id"), "tag"), "id", "left")
    return [f"{r['sim']:.4f} {r['id']} {r['tag']}" for r in rows.where("sim is not null").orderBy(F.desc("sim"), "id").collect()]


def similar_posts(spark: SparkSession, c: Settings, post_id: int, k: int = 10) -> list[str]:
    """Lines of similarity and id; a post without a vector is like nothing."""
    return [f"{r['sim']:.4f} {r['id']}" for r in vectors.similar_posts(_read(spark, c, "post2vec"), post_id, k).where("sim is not null").collect()]


def run(spark: SparkSession, settings: Settings, names: list[str]) -> dict[str, str]:
    """What became of each step: `fresh` or the seconds it took."""
    wanted = {x for n in names for x in (POOLS if n == "pools" else [n])}
    if unknown := wanted - set(STEPS):
        raise ValueError(f"no steps {sorted(unknown)}; there are {list(STEPS)}, pools and validate")
    out = {}
    for name in (n for n in STEPS if n in wanted):
        inputs, output, build = STEPS[name]
        if sinks.fresh(spark, settings.at(output), [settings.at(i) for i in inputs], settings.force):
            out[name] = "fresh"
            continue
        began = time.time()
        build(spark, settings)
        out[name] = f"{time.time() - began:.1f} s"
    return out


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--root", default="data", type=lambda x: x if "://" in x else str(PurePosixPath(x)))
    parser.add_argument("--do", default="")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--with-unreliable", action="store_true", help="keep deleted and pending posts")
    parser.add_argument("--set", action="append", default=[], metavar="GROUP.NAME=VALUE")
    parser.add_argument("--resolve", metavar="NAME")
    parser.add_argument("--similar-tags", metavar="NAME")
    parser.add_argument("--similar-posts", metavar="ID", type=int)
    given = parser.parse_args(arguments)
    settings = Settings(given.root, given.force, not given.with_unreliable, dict(x.split("=", 1) for x in given.set))
    names = [x for x in given.do.split(",") if x]
    spark = session(given.master)
    for name, took in run(spark, settings, [x for x in names if x != "validate"]).items():
        print(name, took)
    for wanted, look in ((given.resolve, resolve), (given.similar_tags, similar_tags), (given.similar_posts, similar_posts)):
        if wanted is not None:
            print("\n".join(look(spark, settings, wanted)))
    if "validate" not in names:
        return 0
    text, code = checks.report(validate(spark, settings))
    print(text)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
