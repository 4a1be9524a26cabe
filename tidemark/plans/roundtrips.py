"""Registered queries that write the driver tables in each layout, read them back, and validate what was written."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vector import norm
from tidemark.operators import checks, pools, relation, vectors
from tidemark.plans import adapters as a
from tidemark.plans import catalog
from tidemark.plans.registry import register
from tidemark.sources import files, sinks, tables
from tidemark.storage import new_path, written


def _csv(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


# dumps


@register("tags_csv", "SELECT p_partkey AS tag_id, 't' || p_partkey AS tag, CAST(NULL AS INTEGER) AS category, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS BIGINT) AS post_count FROM part")
def tags_csv(spark: SparkSession, d: str) -> DataFrame:
    """Counts that are no numbers become 0, a column that the file lacks is null."""
    count = F.when(F.col("p_partkey") % 7 == 0, "many").otherwise(F.col("p_size").cast("string"))
    raw = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias(" name"), count.alias("post_count"))
    return tables.read_tags(spark, _csv(raw, "tags-csv"))


@register("aliases_csv", """SELECT lower(n_name) AS antecedent_name, n_name || ', the "old" one' AS consequent_name, CASE WHEN n_regionkey = 0 THEN 'deleted' ELSE 'active' END AS status FROM nation""")
def aliases_csv(spark: SparkSession, d: str) -> DataFrame:
    """Headers in any case; cells with commas and quotes."""
    status = F.when(F.col("n_regionkey") == 0, "deleted").otherwise("active")
    raw = a.table(spark, d, "nation").select(F.col("n_nationkey").alias("ID"), F.lower("n_name").alias("Antecedent_Name"), F.concat("n_name", F.lit(', the "old" one')).alias("CONSEQUENT_NAME"), status.alias("Status"))
    return tables.read_name_pairs(spark, _csv(raw, "aliases-csv")).drop("line")


@register("implications_csv", "SELECT 'there' AS file, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS targets FROM nation UNION ALL SELECT 'missing', 0, 0")
def implications_csv(spark: SparkSession, d: str) -> DataFrame:
    raw = a.table(spark, d, "nation").select(F.col("n_name").alias("antecedent_name"), F.col("n_regionkey").alias("consequent_name"))
    count = lambda df, file: df.agg(F.count("*").alias("rows"), F.countDistinct("consequent_name").alias("targets")).select(F.lit(file).alias("file"), "rows", "targets")
    return count(tables.read_name_pairs(spark, _csv(raw, "implications-csv")), "there").unionByName(count(tables.read_name_pairs(spark, None), "missing"))


@register("pools_csv_sharded", """SELECT CAST(p // 100 AS BIGINT) AS pool_shard, CAST(count(*) AS BIGINT) AS posts, CAST(min(p) AS BIGINT) AS least, CAST(sum(o_orderkey) AS BIGINT) AS ids
FROM (SELECT o_custkey AS p, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n BETWEEN 3 AND 200 GROUP BY 1""")
def pools_csv_sharded(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat(F.lit("{"), F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ","), F.lit("}"))
    own = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(ids.alias("post_ids"))
    raw = own.select("id", F.lit('a "name",\nin two lines').alias("name"), F.lit("").alias("created_at"), F.lit("").alias("updated_at"), F.lit("1").alias("creator_id"), F.lit("").alias("description"), F.lit("t").alias("is_active"), F.lit("Series").alias("category"), "post_ids")
    long = pools.parse_pools(tables.read_pools(spark, _csv(raw, "pools-csv")))[1]
    path = new_path(spark, "pool-posts")
    sinks.write_pool_posts(long, path, 100)
    return spark.read.parquet(path).groupBy(F.col("pool_shard").cast("bigint").alias("pool_shard")).agg(F.count("*").alias("posts"), F.min("pool_id").alias("least"), F.sum("post_id").alias("ids"))


# stored tables


def _stored_posts(spark: SparkSession, d: str) -> str:
    text = lambda c: F.col(c).cast("string")
    status = F.col("o_orderstatus")
    raw = a.table(spark, d, "orders").select(
        text("o_orderkey").alias("id"),
        text("o_orderdate").alias("created_at"),
        F.when(status == "P", "s").when(status == "F", "q").otherwise("e").alias("rating"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(text("o_custkey")).alias("parent_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("12.5").alias("duration"),
        F.when(status == "P", "t").otherwise("f").alias("is_flagged"),
        F.floor("o_totalprice").cast("string").alias("score"),
    )
    path = new_path(spark, "posts")
    sinks.write_posts(tables.normalize_posts(raw), path)
    return path


@register("posts_stored", """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderstatus WHEN 'P' THEN 's' WHEN 'F' THEN 'q' ELSE 'e' END AS rating, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS parent_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '12.5' END AS duration, o_orderstatus = 'P' AS is_flagged, FALSE AS is_deleted,
  CAST(floor(o_totalprice) AS INTEGER) AS score, CAST(0 AS INTEGER) AS comment_count, '' AS locked_tags, CAST(NULL AS VARCHAR) AS md5, CAST(NULL AS BIGINT) AS approver_id FROM orders""")
def posts_stored(spark: SparkSession, d: str) -> DataFrame:
    """Partitioned by rating, year and month, and back; empty text of optional columns is null."""
    return tables.read_stored_posts(spark, _stored_posts(spark, d)).select("id", "rating", "year", "month", "parent_id", "duration", "is_flagged", "is_deleted", "score", "comment_count", "locked_tags", "md5", "approver_id")


@register("post_tags_sharded", f"WITH {a.PAIRS} SELECT CAST(tag_id % 16 AS INTEGER) AS tag_shard, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT tag_id) AS BIGINT) AS tags, CAST(sum(post_id) AS BIGINT) AS ids FROM pairs GROUP BY 1")
def post_tags_sharded(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "post-tags")
    sinks.write_post_tags(a.post_tags(spark, d), path, 16)
    return spark.read.parquet(path).groupBy(F.col("tag_shard").cast("int").alias("tag_shard")).agg(F.count("*").alias("pairs"), F.countDistinct("tag_id").alias("tags"), F.sum("post_id").alias("ids"))


@register("post_tags_by_tag_folder", f"WITH {a.PAIRS} SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(post_id AS BIGINT) AS post_id FROM pairs")
def post_tags_by_tag_folder(spark: SparkSession, d: str) -> DataFrame:
    """The older layout, a folder for each tag."""
    path = new_path(spark, "post-tags")
    a.post_tags(spark, d).hint("rebalance", "tag_id").write.partitionBy("tag_id").parquet(path)
    return tables.read_post_tags(spark, path)


@register("tags_dict_stored", f"WITH {a.PAIRS} SELECT CAST(tag_id AS BIGINT) AS tag_id, tag, CAST(0 AS INTEGER) AS category, CAST(post_count AS BIGINT) AS post_count FROM tags WHERE tag_id IN (SELECT tag_id FROM pairs)")
def tags_dict_stored(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "tags-dict")
    sinks.write_table(relation.tags_dict(a.tags(spark, d), a.post_tags(spark, d)), path)
    return spark.read.parquet(path)


# exports

_PACKS = f"""WITH {a.PAIRS} SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(tag_id % 16 AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS posts, CAST(min(post_id) AS BIGINT) AS least, CAST(max(post_id) AS BIGINT) AS most, CAST(sum(post_id) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS gap
FROM pairs GROUP BY tag_id"""


def _packs(spark: SparkSession, d: str, coding: str) -> DataFrame:
    folder, ids = new_path(spark, "packs"), F.col("post_ids")
    sinks.export_packs(sinks.packed_lists(relation.inverted_index(a.post_tags(spark, d)), 16, coding), folder)
    total = F.aggregate(ids, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return sinks.read_packs(spark, folder, coding).select("tag_id", "shard", F.size(ids).cast("bigint").alias("posts"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"), total.alias("ids"), "gap")


@register("packs_read_back", _PACKS)
def packs_read_back(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d, "delta")


@register("roaring_packs_read_back", _PACKS)
def roaring_packs_read_back(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d, "roaring")


@register("roaring_files", f"WITH {a.POSTS} SELECT rating, CAST(count(*) AS BIGINT) AS posts, CAST(min(id) AS BIGINT) AS least, CAST(max(id) AS BIGINT) AS most, CAST(sum(id) AS BIGINT) AS ids FROM posts GROUP BY rating")
def roaring_files(spark: SparkSession, d: str) -> DataFrame:
    """One file for each rating."""
    posts, out = a.posts(spark, d).select("id", "rating"), None
    for rating in "sqe":
        path = f"{new_path(spark, 'rating')}.roar"
        sinks.export_roaring(posts.where(F.col("rating") == rating), "id", path)
        facts = sinks.read_roaring(spark, path).agg(F.count("*").alias("posts"), F.min("id").alias("least"), F.max("id").alias("most"), F.sum("id").alias("ids")).withColumn("rating", F.lit(rating)).where("posts > 0")
        out = facts if out is None else out.unionByName(facts)
    return out


@register("arrays_read_back", f"""WITH {a.POSTS} SELECT row_number() OVER (ORDER BY id) - 1 AS row, CAST(id AS BIGINT) AS post_id, CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS BIGINT) AS epoch_day, CAST(score AS BIGINT) AS score, CAST(is_pending AS BIGINT) AS is_pending FROM posts""")
def arrays_read_back(spark: SparkSession, d: str) -> DataFrame:
    types, folder = {"post_id": "<i8", "epoch_day": "<i4", "score": "<i4", "is_pending": "|i1"}, new_path(spark, "arrays")
    sinks.export_arrays(relation.post_columns(a.posts(spark, d)), folder, types)
    out = None
    for c, t in types.items():
        its = sinks.read_array(spark, folder, c, t).withColumnRenamed("value", c)
        out = its if out is None else out.join(its, "row")
    return out


@register("row_map_appended", "SELECT row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS row, CAST(vec_id AS BIGINT) AS vec_id FROM embeddings")
def row_map_appended(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that come in two runs; those of the first keep their rows."""
    own, path, rows = a.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), new_path(spark, "vectors"), new_path(spark, "vector-rows")
    sinks.append_vectors(own.where("vec_id % 2 = 0"), path, rows, "vec_id")
    sinks.append_vectors(own, path, rows, "vec_id")
    return spark.read.parquet(rows).join(spark.read.parquet(path).select("vec_id"), "vec_id").select("row", "vec_id")


@register("run_metadata", "SELECT 'vectors' AS name, CAST(count(*) AS DOUBLE) AS value FROM embeddings UNION ALL SELECT 'dim', 64 UNION ALL SELECT 'largest', 2.5")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'meta')}.json"
    sinks.write_metadata(spark, path, vectors=a.table(spark, d, "embeddings").count(), settings={"dim": 64}, singular_values=[2.5, 1.0])
    found = sinks.read_metadata(spark, path)
    return spark.createDataFrame([("vectors", float(found["vectors"])), ("dim", float(found["settings"]["dim"])), ("largest", found["singular_values"][0])], "name string, value double")


@register("freshness", "SELECT * FROM (VALUES ('not made', FALSE), ('made', TRUE), ('forced', FALSE), ('input is newer', FALSE), ('input is gone', TRUE)) v(state, fresh)")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    source, output = new_path(spark, "input"), new_path(spark, "output")
    files.put(spark, source, [b"1"])
    rows = [("not made", sinks.fresh(spark, output, [source]))]
    time.sleep(0.01)
    sinks.write_table(a.table(spark, d, "region"), output)
    rows += [("made", sinks.fresh(spark, output, [source])), ("forced", sinks.fresh(spark, output, [source], force=True))]
    time.sleep(1.1)  # some file systems keep whole seconds
    files.put(spark, source, [b"2"])
    rows.append(("input is newer", sinks.fresh(spark, output, [source])))
    files.remove(spark, source)
    rows.append(("input is gone", sinks.fresh(spark, output, [source])))
    return spark.createDataFrame(rows, "state string, fresh boolean")


@register("manifest_changes", "SELECT * FROM (VALUES ('in/b', 'changed', sha256('two!')), ('c', 'removed', NULL), ('d', 'added', sha256('four'))) v(path, change, digest)")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    folder, path = new_path(spark, "files"), new_path(spark, "manifest")
    for name, text in (("a", b"one"), ("in/b", b"two"), ("c", b"three")):
        files.put(spark, f"{folder}/{name}", [text[:1], text[1:]])
    files.write_manifest(spark, folder, path)
    files.put(spark, f"{folder}/in/b", [b"two!"])
    files.put(spark, f"{folder}/d", [b"four"])
    files.remove(spark, f"{folder}/c")
    now = files.manifest(spark, folder)
    return checks.manifest_diff(files.read_manifest(spark, path), now).join(now.select("path", "digest"), "path", "left").select("path", "change", "digest")


# validation


@register("schema_checks", "SELECT * FROM (VALUES ('posts schema', 'PASS', ''), ('post_tags schema', 'PASS', ''), ('tags_dict schema', 'PASS', ''), ('lacking', 'FAIL', 'tag: missing, not string; post_count: int, not bigint')) v(\"check\", status, detail)")
def schema_checks(spark: SparkSession, d: str) -> DataFrame:
    pairs, known = a.post_tags(spark, d), a.tags(spark, d)
    out = checks.posts_schema_check(spark, _stored_posts(spark, d))
    for df, name, types in ((pairs, "post_tags schema", checks.POST_TAGS), (known, "tags_dict schema", checks.TAGS_DICT), (known.drop("tag").withColumn("post_count", F.lit(1)), "lacking", checks.TAGS_DICT)):
        out = out.unionByName(checks.schema_check(df, name, types))
    return out


@register("column_and_hash_checks", f"""WITH {a.POSTS} SELECT * FROM (VALUES ('ids ascend', 'PASS', '0'), ('an id comes twice', 'FAIL', '1'), ('same ids', 'PASS', '0'), ('other ids', 'FAIL', '1'), ('index equals relation', 'PASS', '0')) v("check", status, detail)""")
def column_and_hash_checks(spark: SparkSession, d: str) -> DataFrame:
    columns = written(relation.post_columns(a.posts(spark, d)), "columns")
    one = columns.orderBy("post_id").limit(1)
    pairs = written(a.post_tags(spark, d), "pairs")
    out = checks.verdict(checks.ascending_faults(columns), "ids ascend", F.count("*"))
    out = out.unionByName(checks.verdict(checks.ascending_faults(columns.unionByName(one)), "an id comes twice", F.count("*")))
    out = out.unionByName(checks.equal_fingerprints(columns, columns.orderBy(F.desc("score")), "post_id", "same ids"))
    out = out.unionByName(checks.equal_fingerprints(columns, columns.unionByName(one), "post_id", "other ids"))
    return out.unionByName(checks.verdict(checks.bitmap_faults(relation.bitmap_index(pairs), pairs), "index equals relation", F.count("*")))


@register("vector_checks", """SELECT * FROM (VALUES ('rows are 0 to n - 1', 'PASS', '0'), ('rows from 1', 'FAIL', '1'), ('nearest to themselves', 'PASS', '0'), ('another is nearer', 'FAIL', '8'), ('computed again', 'PASS', '0'), ('computed otherwise', 'FAIL', '8')) v("check", status, detail)""")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    vecs = written(a.unit_vectors(spark, d), "unit")
    sample = vecs.orderBy("tag_id").limit(8)
    turned = sample.withColumn("vec", F.transform("vec", lambda x: -x))
    rows = sinks.row_map(vecs, "tag_id")
    out = checks.verdict(checks.row_map_faults(rows), "rows are 0 to n - 1", F.count("*"))
    for found, name in (
        (checks.row_map_faults(rows.withColumn("row", F.col("row") + 1)), "rows from 1"),
        (checks.self_faults(vecs, sample, "tag_id", "vec"), "nearest to themselves"),
        (checks.self_faults(vecs, turned, "tag_id", "vec"), "another is nearer"),
        (checks.recomputed_faults(sample, vecs.join(sample.select("tag_id"), "tag_id"), "tag_id", "vec"), "computed again"),
        (checks.recomputed_faults(sample, turned, "tag_id", "vec"), "computed otherwise"),
    ):
        out = out.unionByName(checks.verdict(found, name, F.count("*")))
    return out


@register("tag2vec_checks", """SELECT * FROM (VALUES ('vectors are unit or zero', 'PASS', '0'), ('every tag has a vector', 'PASS', '0'), ('singular values descend', 'PASS', '0'), ('the largest is between the longest row and the whole matrix', 'PASS', '0')) v("check", status, detail)""")
def tag2vec_checks(spark: SparkSession, d: str) -> DataFrame:
    weights, universe = written(vectors.ppmi(catalog._graph(spark, d)), "ppmi"), written(catalog._universe(spark, d), "universe")
    vecs, sigma = vectors.tag2vec(weights, universe, 16)
    out = checks.verdict(checks.vector_faults(vecs, "tag_id", "vec", 16), "vectors are unit or zero", F.count("*"))
    out = out.unionByName(checks.verdict(universe.select("tag_id").exceptAll(vecs.select("tag_id")), "every tag has a vector", F.count("*")))
    rows = weights.groupBy("a").agg(F.sum(F.col("x") * F.col("x")).alias("s")).agg(F.sqrt(F.max("s")).alias("row"), F.sqrt(F.sum("s")).alias("whole")).first()
    falls = all(x >= y >= 0 for x, y in zip(sigma, sigma[1:], strict=False))
    between = not sigma or rows["row"] - 1e-6 <= sigma[0] <= rows["whole"] + 1e-6
    verdicts = [(name, "PASS" if ok else "FAIL", str(int(not ok))) for name, ok in (("singular values descend", falls), ("the largest is between the longest row and the whole matrix", between))]
    return out.unionByName(spark.createDataFrame(verdicts, checks.REPORT))


@register("post2vec_unweighted", f"""WITH {a.POSTS}, {a.PAIRS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
c AS (SELECT vec_id, unnest(e) / l AS x, unnest(range(1, 65)) AS i FROM u),
s AS (SELECT post_id, i, sum(x) AS x FROM pairs JOIN c ON vec_id = pairs.tag_id GROUP BY 1, 2),
n AS (SELECT post_id, sqrt(sum(x * x)) AS l, max(CASE WHEN i = 2 THEN x END) AS second_ FROM s GROUP BY post_id)
SELECT CAST(id AS BIGINT) AS post_id, CAST(CASE WHEN l > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length, round(coalesce(second_ / l, 0.0), 6) AS second_component FROM posts LEFT JOIN n ON post_id = id""")
def post2vec_unweighted(spark: SparkSession, d: str) -> DataFrame:
    """Without statistics every tag weighs 1; pending posts count as well."""
    found = vectors.post2vec(a.post_tags(spark, d), a.posts(spark, d), a.unit_vectors(spark, d), 64, None, reliable_only=False)
    return found.select("post_id", F.round(norm(F.col("vec")), 6).alias("length"), F.round(F.col("vec")[1], 6).alias("second_component"))
