"""Registered queries over the driver tables, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.vector import norm
from tidemark.operators import aliases, checks, graph, pools, relation, stats, vectors
from tidemark.plans import adapters as a
from tidemark.plans.registry import ORACLE, QUERIES, register
from tidemark.sources import tables
from tidemark.storage import new_path, written
from tidemark.streaming.incremental import windowed_counts

# sources and the relation


@register(
    "posts_normalize",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS uploader_id, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%m') AS month,
  o_orderstatus = 'P' AS is_pending, FALSE AS is_deleted, o_orderpriority AS source, CAST(0 AS INTEGER) AS fav_count, '' AS tag_string FROM orders""",
)
def posts_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    raw = a.table(spark, d, "orders").select(text("o_orderkey").alias("id"), text("o_custkey").alias("uploader_id"), text("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "t").otherwise("f").alias("is_pending"), F.col("o_orderpriority").alias("source"))
    return tables.normalize_posts(raw).select("id", "uploader_id", "year", "month", "is_pending", "is_deleted", "source", "fav_count", "tag_string")


@register("posts_partition_counts", f"WITH {a.POSTS} SELECT rating, strftime(created_at, '%Y') AS year, strftime(created_at, '%m') AS month, CAST(count(*) AS BIGINT) AS posts FROM posts GROUP BY ALL")
def posts_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = a.posts(spark, d).select("rating", F.date_format("created_at", "yyyy").alias("year"), F.date_format("created_at", "MM").alias("month"))
    return rows.groupBy("rating", "year", "month").agg(F.count("*").alias("posts"))


@register("text_explode_dedup", "SELECT doc_id, CAST(count(DISTINCT t) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY doc_id")
def text_explode_dedup(spark: SparkSession, d: str) -> DataFrame:
    words = a.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("t")).distinct()
    return words.groupBy("doc_id").agg(F.count("t").alias("tokens"))


@register("post_tags", f"WITH {a.PAIRS} SELECT CAST(post_id AS BIGINT) AS post_id, CAST(tag_id AS INTEGER) AS tag_id FROM pairs")
def post_tags(spark: SparkSession, d: str) -> DataFrame:
    return a.post_tags(spark, d)


@register("post_tags_from_text", f"WITH {a.POSTS}, {a.PAIRS} SELECT CAST(post_id AS BIGINT) AS post_id, CAST(tag_id AS INTEGER) AS tag_id FROM pairs JOIN posts ON id = post_id WHERE NOT is_pending")
def post_tags_from_text(spark: SparkSession, d: str) -> DataFrame:
    """The text path: names are written into tag strings, and come back through split, aliases and the dictionary."""
    known = a.tags(spark, d)
    names = F.broadcast(known.select(F.col("tag_id").cast("int").alias("tag_id"), F.translate("tag", " ", "_").alias("name")))
    strings = a.post_tags(spark, d).join(names, "tag_id").groupBy(F.col("post_id").alias("id")).agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("old_"), "name")), F.lit("unknown"), F.lit("")).alias("tag_string"))
    flags = a.posts(spark, d).select("id", "is_deleted", "is_pending")
    renamed = known.withColumn("tag", F.translate("tag", " ", "_"))
    mapping = renamed.select(F.concat(F.lit("old_"), "tag").alias("tag"), F.col("tag").alias("canon"))
    return relation.post_tags(strings.join(flags, "id"), renamed, mapping)


@register("tags_dict_used", f"WITH {a.PAIRS} SELECT CAST(tag_id AS BIGINT) AS tag_id, tag, CAST(0 AS INTEGER) AS category, CAST(post_count AS BIGINT) AS post_count FROM tags WHERE tag_id IN (SELECT tag_id FROM pairs)")
def tags_dict_used(spark: SparkSession, d: str) -> DataFrame:
    return relation.tags_dict(a.tags(spark, d), a.post_tags(spark, d))


# names and graphs

_WALK = """names AS (SELECT p_partkey AS x, CAST(p_size AS BIGINT) AS n FROM part),
step AS (SELECT x, ((x % 97) * (x % 97) + 1) % 97 AS y FROM names WHERE x <> ((x % 97) * (x % 97) + 1) % 97),
walk(x, at_, i) AS (SELECT x, y, 1 FROM step UNION ALL SELECT w.x, s.y, i + 1 FROM walk w JOIN step s ON s.x = w.at_ WHERE i < 128),
stop AS (SELECT w.x, w.at_ FROM walk w LEFT JOIN step s ON s.x = w.at_ WHERE s.x IS NULL),
land AS (SELECT x, at_ FROM walk WHERE i = 128),
orbit(l, at_, i) AS (SELECT DISTINCT at_, at_, 0 FROM land UNION ALL SELECT l, s.y, i + 1 FROM orbit o JOIN step s ON s.x = o.at_ WHERE i < 97),
best AS (SELECT l, at_ AS b FROM (SELECT l, o.at_, row_number() OVER (PARTITION BY l ORDER BY coalesce(n, -1) DESC, 't' || o.at_) AS r FROM (SELECT DISTINCT l, at_ FROM orbit) o LEFT JOIN names ON names.x = o.at_) WHERE r = 1)"""


def _pairs(names: DataFrame, to: F.Column) -> DataFrame:
    return names.select(F.col("tag").alias("antecedent_name"), F.concat(F.lit("t"), to.cast("string")).alias("consequent_name"), F.lit("active").alias("status"))


@register(
    "alias_functional_graph",
    f"WITH RECURSIVE {_WALK} SELECT 't' || x AS tag, 't' || at_ AS canon FROM stop UNION ALL SELECT 't' || x, 't' || b FROM land JOIN best ON l = at_",
)
def alias_functional_graph(spark: SparkSession, d: str) -> DataFrame:
    names = a.fine_tags(spark, d)
    x = F.col("tag_id").cast("long") % 97  # the square of an id may not fit
    return aliases.alias_map(names, _pairs(names, (x * x + 1) % 97))


@register(
    "alias_canonical_cycle",
    """WITH n AS (SELECT p_partkey AS x, p_size AS n, p_partkey // 7 AS b FROM part),
full_ AS (SELECT b FROM n GROUP BY b HAVING count(*) = 7),
best AS (SELECT b, x AS best FROM (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY n DESC, 't' || x) AS r FROM n) WHERE r = 1)
SELECT 't' || x AS tag, 't' || best AS canon FROM n JOIN best USING (b) JOIN full_ USING (b)""",
)
def alias_canonical_cycle(spark: SparkSession, d: str) -> DataFrame:
    names = a.fine_tags(spark, d)
    block = F.floor(F.col("tag_id") / 7)
    whole = names.groupBy(block.alias("b")).agg(F.count("*").alias("n")).where("n = 7").select("b")
    names = names.withColumn("b", block).join(whole, "b").drop("b")
    return aliases.alias_map(names, _pairs(names, F.floor(F.col("tag_id") / 7) * 7 + (F.col("tag_id") + 1) % 7))


_CYCLIC = """x AS (SELECT p_partkey AS x FROM part WHERE p_partkey >= 1),
e AS (SELECT x AS a, x // 2 AS b FROM x UNION SELECT x // 2, x FROM x WHERE x % 10 = 0 AND x > 1),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
nodes AS (SELECT a AS v FROM e UNION SELECT b FROM e),
comp AS (SELECT v, coalesce((SELECT max(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = v), v) AS c FROM nodes)"""


def _cyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    x = a.table(spark, d, "part").select(F.col("p_partkey").alias("x")).where("x >= 1")  # the edge of 0 leads to itself
    up = x.select(F.col("x").alias("a"), F.floor(F.col("x") / 2).alias("b"))
    down = x.where("x % 10 = 0").select(F.floor(F.col("x") / 2).alias("a"), F.col("x").alias("b"))
    return up.unionByName(down).distinct()


@register("scc", f"WITH RECURSIVE {_CYCLIC} SELECT CAST(v AS BIGINT) AS node, CAST(greatest(c, v) AS BIGINT) AS comp FROM comp")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.scc(_cyclic_edges(spark, d))


@register("implication_dag", f"WITH RECURSIVE {_CYCLIC} SELECT CAST(a AS BIGINT) AS a_id, CAST(b AS BIGINT) AS b_id FROM e JOIN comp p ON p.v = a JOIN comp q ON q.v = b WHERE greatest(p.c, p.v) <> greatest(q.c, q.v)")
def implication_dag(spark: SparkSession, d: str) -> DataFrame:
    edges = _cyclic_edges(spark, d)
    name = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    rows = edges.select(name("a").alias("antecedent_name"), name("b").alias("consequent_name"), F.lit("active").alias("status"))
    return graph.implication_dag(rows, a.fine_tags(spark, d), spark.createDataFrame([], "tag string, canon string"))


@register(
    "ancestor_cache",
    """WITH n AS (SELECT p_partkey AS x, p_size FROM part), e AS (SELECT x FROM n WHERE x > 0),
top AS (SELECT x FROM n ORDER BY p_size DESC, x LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM n)),
r AS (SELECT x, x >> d AS y, d FROM top, (SELECT unnest([1, 2, 3]) AS d) WHERE (x >> (d - 1)) > 0)
SELECT CAST(x AS BIGINT) AS tag_id, CAST(y AS BIGINT) AS ancestor_id, CAST(min(d) AS TINYINT) AS depth FROM r WHERE x <> y GROUP BY x, y""",
)
def ancestor_cache(spark: SparkSession, d: str) -> DataFrame:
    dag = a.table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a_id"), F.floor(F.col("p_partkey") / 2).alias("b_id"))
    return graph.ancestor_cache(dag, a.fine_tags(spark, d), 3, 0.05)


@register("resolve_tag", f"""WITH {a.TAGS}
SELECT q, CAST(tag_id AS BIGINT) AS tag_id, CAST(NULL AS VARCHAR) AS suggestion FROM (VALUES ('5', 5)) v(q, tag_id)
UNION ALL SELECT 'RED WIDGET', tag_id, NULL FROM tags WHERE tag = 'red widget'
UNION ALL SELECT 'scarlet', tag_id, NULL FROM tags WHERE tag = 'red widget'
UNION ALL SELECT 'bolt', NULL, tag FROM (SELECT tag FROM tags WHERE contains(tag, 'bolt') ORDER BY tag LIMIT 20)""")
def resolve_tag(spark: SparkSession, d: str) -> DataFrame:
    known = a.tags(spark, d)
    alias = spark.createDataFrame([("Scarlet", "crimson", "active", 0), ("crimson", "red widget", "active", 1)], "antecedent_name string, consequent_name string, status string, line bigint")
    rows = []
    for q in ("5", "RED WIDGET", "scarlet", "bolt"):
        ids, near = aliases.resolve_tag(known, alias, q)
        rows += [(q, i, None) for i in ids] + [(q, None, s) for s in near]
    return spark.createDataFrame(rows, "q string, tag_id bigint, suggestion string")


# index and columns

_SIZES = f"WITH {a.PAIRS} SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(count(*) AS BIGINT) AS posts FROM pairs GROUP BY tag_id"


@register("inverted_index_sizes", _SIZES)
def inverted_index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return relation.inverted_index(a.post_tags(spark, d)).select("tag_id", F.size("post_ids").cast("bigint").alias("posts"))


@register("inverted_index_bitmap_count", _SIZES)
def inverted_index_bitmap_count(spark: SparkSession, d: str) -> DataFrame:
    return relation.index_sizes(relation.bitmap_index(a.post_tags(spark, d)))


@register("bitmap_union_intersection", f"""WITH {a.PAIRS}, p AS (SELECT DISTINCT tag_id, post_id FROM pairs WHERE tag_id IN (0, 1)), c AS (SELECT post_id, count(*) AS n FROM p GROUP BY post_id)
SELECT CAST(count(*) AS BIGINT) AS either, CAST(coalesce(sum(CASE WHEN n = 2 THEN 1 END), 0) AS BIGINT) AS both FROM c""")
def bitmap_union_intersection(spark: SparkSession, d: str) -> DataFrame:
    bits = relation.bitmap_index(a.post_tags(spark, d).where("tag_id in (0, 1)"))
    by = bits.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("u"), F.sum(F.bitmap_count("bits")).alias("s"))
    return by.agg(F.coalesce(F.sum("u"), F.lit(0)).cast("bigint").alias("either"), F.coalesce(F.sum(F.col("s") - F.col("u")), F.lit(0)).cast("bigint").alias("both"))


@register("post_columns_epoch_day", f"""WITH {a.POSTS} SELECT CAST(id AS BIGINT) AS post_id, CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS INTEGER) AS epoch_day, score, fav_count,
  CAST(0 AS TINYINT) AS is_deleted, CAST(is_pending AS TINYINT) AS is_pending FROM posts""")
def post_columns_epoch_day(spark: SparkSession, d: str) -> DataFrame:
    return relation.post_columns(a.posts(spark, d)).drop("w", "h")


@register("rating_set_disjoint", f"""WITH {a.POSTS} SELECT CAST(CASE WHEN id > 0 THEN 1 + (id - 1) // 32768 ELSE id // 32768 END AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS shared, CAST(count(*) AS BIGINT) AS "all" FROM posts GROUP BY 1""")
def rating_set_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return checks.rating_faults(relation.rating_sets(a.posts(spark, d)))


# statistics

_STATS = f"""WITH {a.POSTS}, {a.PAIRS}, ok AS (SELECT * FROM posts WHERE NOT is_pending),
s AS (SELECT tag_id, avg(score) AS avg_score, avg(fav_count) AS avg_fav, count(*) AS df_local FROM pairs JOIN ok ON id = post_id GROUP BY tag_id)"""


def _idf(count: str) -> str:
    return f"{_STATS} SELECT CAST(t.tag_id AS BIGINT) AS tag_id, round(ln(((SELECT count(*) FROM ok) + 10.0) / (coalesce({count}, 0) + 10.0)), 6) AS idf FROM tags t LEFT JOIN s USING (tag_id) WHERE t.tag_id IN (SELECT tag_id FROM pairs)"


def _stats(spark: SparkSession, d: str, source: str) -> DataFrame:
    pairs = a.post_tags(spark, d)
    return stats.tag_stats(relation.tags_dict(a.tags(spark, d), pairs), pairs, a.posts(spark, d), 10.0, source)


@register("tag_stats", f"{_STATS} SELECT CAST(t.tag_id AS BIGINT) AS tag_id, tag, round(avg_score, 6) AS avg_score, round(avg_fav, 6) AS avg_fav, CAST(coalesce(df_local, 0) AS BIGINT) AS df_local FROM tags t LEFT JOIN s USING (tag_id) WHERE t.tag_id IN (SELECT tag_id FROM pairs)")
def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "local").select("tag_id", "tag", F.round("avg_score", 6).alias("avg_score"), F.round("avg_fav", 6).alias("avg_fav"), "df_local")


@register("idf_tags", _idf("post_count"))
def idf_tags(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "tags").select("tag_id", F.round("idf", 6).alias("idf"))


@register("idf_local", _idf("df_local"))
def idf_local(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "local").select("tag_id", F.round("idf", 6).alias("idf"))


@register("idf_auto", f"""WITH {a.POSTS}, {a.FINE}, ok AS (SELECT * FROM posts WHERE NOT is_pending),
dict AS (SELECT * FROM tags WHERE tag_id IN (SELECT tag_id FROM pairs)),
s AS (SELECT tag_id, count(*) AS df_local FROM pairs JOIN ok ON id = post_id GROUP BY tag_id),
j AS (SELECT d.tag_id, post_count, coalesce(df_local, 0) AS df_local FROM dict d LEFT JOIN s USING (tag_id)),
top AS (SELECT * FROM j ORDER BY post_count DESC, tag_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM j)),
c AS (SELECT CASE WHEN count(*) < 2 OR sum(post_count) = 0 OR sum(df_local) = 0 THEN 1.0 ELSE CASE WHEN stddev_pop(ln(1 + post_count)) = 0 OR stddev_pop(ln(1 + df_local)) = 0 THEN NULL
  ELSE covar_pop(ln(1 + post_count), ln(1 + df_local)) / (stddev_pop(ln(1 + post_count)) * stddev_pop(ln(1 + df_local))) END END AS r FROM top)
SELECT CAST(tag_id AS BIGINT) AS tag_id, round(ln(((SELECT count(*) FROM ok) + 1000.0) / ((CASE WHEN coalesce((SELECT r FROM c) < 0.9, FALSE) THEN df_local ELSE post_count END) + 1000.0)), 6) AS idf FROM j""")
def idf_auto(spark: SparkSession, d: str) -> DataFrame:
    pairs = a.fine_post_tags(spark, d)
    return stats.tag_stats(relation.tags_dict(a.fine_tags(spark, d), pairs), pairs, a.posts(spark, d)).select("tag_id", F.round("idf", 6).alias("idf"))


_PMI = """r AS (SELECT post_id, tag_id FROM (SELECT post_id, tag_id, row_number() OVER (PARTITION BY post_id ORDER BY post_count, tag_id) AS n FROM pairs JOIN tags USING (tag_id)) WHERE n <= 4),
one AS (SELECT tag_id, count(*) AS n FROM r GROUP BY tag_id),
two AS (SELECT x.tag_id AS a, y.tag_id AS b, count(*) AS s FROM r x JOIN r y ON x.post_id = y.post_id AND x.tag_id < y.tag_id GROUP BY 1, 2 HAVING count(*) >= 20),
pmi AS (SELECT a, b, s, ln((s / N.n + 1e-12) / ((p.n / N.n) * (q.n / N.n) + 1e-12)) AS pmi
  FROM two JOIN one p ON p.tag_id = a JOIN one q ON q.tag_id = b, (SELECT CAST(count(DISTINCT post_id) AS DOUBLE) AS n FROM r) N)"""


def _pmi(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_pmi(a.post_tags(spark, d), a.tags(spark, d), 20, 4)


@register("pmi_pairs", f"WITH {a.PAIRS}, {_PMI} SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(s AS BIGINT) AS support, round(pmi, 6) AS pmi FROM pmi")
def pmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pmi(spark, d).select("a", "b", "support", F.round("pmi", 6).alias("pmi"))


_RANKED = f"""WITH {a.POSTS}, {a.PAIRS},
ranked AS (SELECT tag_id, post_id, row_number() OVER (PARTITION BY tag_id ORDER BY fav_count DESC NULLS FIRST, score DESC NULLS FIRST, post_id DESC) AS rank FROM pairs JOIN posts ON id = post_id WHERE NOT is_pending)"""


@register("topk_static", f"{_RANKED} SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(post_id AS BIGINT) AS post_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def topk_static(spark: SparkSession, d: str) -> DataFrame:
    return stats.topk_posts(a.post_tags(spark, d), a.posts(spark, d), k=5)


@register("topk_adaptive", f"""{_RANKED}, l AS (SELECT tag_id, least(greatest(ceil(sqrt(count(*)) * 0.5), 3), 12) AS k FROM pairs GROUP BY tag_id)
SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(post_id AS BIGINT) AS post_id, CAST(rank AS INTEGER) AS rank FROM ranked JOIN l USING (tag_id) WHERE rank <= k""")
def topk_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return stats.topk_posts(a.post_tags(spark, d), a.posts(spark, d), "sqrt_df", k_min=3, k_max=12, beta=0.5)


@register("topk_delta_encode", f"""{_RANKED} SELECT CAST(tag_id AS INTEGER) AS tag_id, CAST(i - 1 AS INTEGER) AS place, CAST(post_id - coalesce(before, 0) AS BIGINT) AS step
FROM (SELECT tag_id, post_id, row_number() OVER w AS i, lag(post_id) OVER w AS before FROM ranked WHERE rank <= 5 WINDOW w AS (PARTITION BY tag_id ORDER BY post_id))""")
def topk_delta_encode(spark: SparkSession, d: str) -> DataFrame:
    stored = stats.stored_topk(stats.topk_posts(a.post_tags(spark, d), a.posts(spark, d), k=5))
    back = stored.select("tag_id", codec.decode_ids(codec.encode_ids("post_ids")).alias("post_ids"))
    return back.select("tag_id", F.posexplode(codec.deltas(F.col("post_ids"))).alias("place", "step"))


# collections

_H = f"""WITH {a.POSTS}, {a.PAIRS}, {a.POOLS},
cnt AS (SELECT pool_id, tag_id, count(*) AS c FROM members JOIN pairs USING (post_id) GROUP BY 1, 2),
h AS (SELECT pool_id, sum(-p * ln(p)) AS "H_tags" FROM (SELECT pool_id, c / sum(c) OVER (PARTITION BY pool_id) AS p FROM cnt) GROUP BY pool_id),
ok AS (SELECT * FROM posts WHERE NOT is_pending),
idf AS (SELECT t.tag_id, ln(((SELECT count(*) FROM ok) + 10.0) / (post_count + 10.0)) AS idf FROM tags t),
hi AS (SELECT pool_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE CAST('nan' AS DOUBLE) END) AS "H_idf" FROM (SELECT pool_id, w / sum(w) OVER (PARTITION BY pool_id) AS p FROM (SELECT pool_id, c * idf AS w FROM cnt JOIN idf USING (tag_id))) GROUP BY pool_id)"""


@register("pools_parse", f"WITH {a.POOLS} SELECT CAST(pool_id AS BIGINT) AS pool_id, CAST(post_id AS BIGINT) AS post_id FROM members")
def pools_parse(spark: SparkSession, d: str) -> DataFrame:
    """Collections as text: ids twice, in no order, with what is no number among them."""
    ids = F.concat(F.lit("{"), F.array_join(F.concat(F.collect_list(F.col("o_orderkey").cast("string")), F.array(F.lit(" x "), F.lit("")), F.collect_list(F.col("o_orderkey").cast("string"))), ","), F.lit("}"))
    text = a.table(spark, d, "orders").groupBy("o_custkey").agg(ids.alias("post_ids"))
    blank = {c: F.lit(None).cast("string") for c in ("name", "created_at", "updated_at", "creator_id", "description")}
    raw = text.select(F.col("o_custkey").cast("string").alias("id"), F.lit("t").alias("is_active"), F.lit("Series").alias("category"), "post_ids", *(v.alias(k) for k, v in blank.items()))
    return pools.parse_pools(raw)[1]


def _entropy(spark: SparkSession, d: str, idf: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    weights = _stats(spark, d, "tags") if idf else None
    return pools.pool_entropy(a.pools_meta(spark, d), a.pool_posts(spark, d), a.post_tags(spark, d) if pairs is None else pairs, weights)


@register("pool_entropy", f"""{_H} SELECT CAST(pool_id AS BIGINT) AS pool_id, CAST(size AS INTEGER) AS size, category, round("H_tags", 6) AS "H_tags" FROM meta LEFT JOIN h USING (pool_id)""")
def pool_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d).select("pool_id", "size", "category", F.round("H_tags", 6).alias("H_tags"))


@register("pool_entropy_idf", f"""{_H} SELECT CAST(pool_id AS BIGINT) AS pool_id, round("H_tags", 6) AS "H_tags", round("H_idf", 6) AS "H_idf" FROM meta LEFT JOIN h USING (pool_id) LEFT JOIN hi USING (pool_id)""")
def pool_entropy_idf(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d, True).select("pool_id", F.round("H_tags", 6).alias("H_tags"), F.round("H_idf", 6).alias("H_idf"))


_ELIGIBLE = """eligible AS (SELECT pool_id, size, category FROM meta LEFT JOIN h USING (pool_id) WHERE category = 'series' OR (category = 'collection' AND "H_tags" <= 3.3))"""


def _eligible(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    return pools.eligible_pools(_entropy(spark, d, pairs=pairs), max_h=3.3)


@register("eligible_pools", f"{_H}, {_ELIGIBLE} SELECT CAST(pool_id AS BIGINT) AS pool_id, category FROM eligible")
def eligible_pools(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d).select("pool_id", "category")


@register("pool_edges", f"""{_H}, {_ELIGIBLE} SELECT CAST(x.post_id AS BIGINT) AS a_post_id, CAST(y.post_id AS BIGINT) AS b_post_id, round(sum(1 / sqrt(size)), 6) AS weight, CAST(count(*) AS INTEGER) AS pools
FROM members x JOIN members y ON x.pool_id = y.pool_id AND x.post_id < y.post_id JOIN eligible e ON e.pool_id = x.pool_id GROUP BY 1, 2""")
def pool_edges(spark: SparkSession, d: str) -> DataFrame:
    return pools.pool_edges(a.pool_posts(spark, d), _eligible(spark, d)).withColumn("weight", F.round("weight", 6))


@register("post_in_pools_count", f"{_H}, {_ELIGIBLE}, c AS (SELECT post_id, count(*) AS n FROM members WHERE pool_id IN (SELECT pool_id FROM eligible) GROUP BY 1) SELECT CAST(id AS BIGINT) AS post_id, CAST(coalesce(n, 0) AS INTEGER) AS pools FROM posts LEFT JOIN c ON post_id = id")
def post_in_pools_count(spark: SparkSession, d: str) -> DataFrame:
    return pools.post_pool_counts(a.posts(spark, d), a.pool_posts(spark, d), _eligible(spark, d))


_CO = """top AS (SELECT pool_id, tag_id FROM (SELECT pool_id, tag_id, row_number() OVER (PARTITION BY pool_id ORDER BY c DESC, tag_id) AS n FROM cnt WHERE pool_id IN (SELECT pool_id FROM eligible)) WHERE n <= 4),
co AS (SELECT x.tag_id AS a, y.tag_id AS b, sum(1 / sqrt(size)) AS w, count(*) AS n FROM top x JOIN top y ON x.pool_id = y.pool_id AND x.tag_id < y.tag_id JOIN eligible e ON e.pool_id = x.pool_id GROUP BY 1, 2)"""


def _co(spark: SparkSession, d: str, pairs: DataFrame | None = None, ok: DataFrame | None = None) -> DataFrame:
    pairs = written(a.post_tags(spark, d), "pairs") if pairs is None else pairs
    return pools.pool_tag_co(a.pool_posts(spark, d), pairs, _eligible(spark, d, pairs) if ok is None else ok, top_m=4)


@register("pool_tag_cooccurrence", f"{_H}, {_ELIGIBLE}, {_CO} SELECT CAST(a AS INTEGER) AS a_tag_id, CAST(b AS INTEGER) AS b_tag_id, round(w, 6) AS weight, CAST(n AS INTEGER) AS pools FROM co")
def pool_tag_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _co(spark, d).withColumn("weight", F.round("weight", 6))


# vectors

_GRAPH = f"""{_H}, {_ELIGIBLE}, {_CO}, {_PMI},
df AS (SELECT tag_id, count(*) AS df FROM pairs JOIN ok ON id = post_id GROUP BY tag_id),
universe AS (SELECT tag_id, df FROM df WHERE df >= 20 ORDER BY df DESC, tag_id LIMIT 50),
g AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, pmi AS w FROM pmi WHERE pmi > 0 UNION ALL SELECT a, b, 0.5 * w FROM co WHERE w > 0)
  WHERE a IN (SELECT tag_id FROM universe) AND b IN (SELECT tag_id FROM universe) GROUP BY a, b)"""


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return vectors.tag_universe(_stats(spark, d, "tags"), 20, 50)


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return written(vectors.tag_graph(_universe(spark, d), _pmi(spark, d), _co(spark, d)), "tag-graph")


@register("tag_universe", f"{_GRAPH} SELECT CAST(tag_id AS BIGINT) AS tag_id, CAST(df AS BIGINT) AS df FROM universe")
def tag_universe(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d)


@register("tag_graph_merge", f"{_GRAPH} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(w, 6) AS w FROM g")
def tag_graph_merge(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).withColumn("w", F.round("w", 6))


@register("tag_ppmi", f"""{_GRAPH}, s AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g), dg AS (SELECT a, sum(w) AS d FROM s GROUP BY a),
x AS (SELECT s.a, s.b, ln(w * (SELECT sum(w) FROM g) / (p.d * q.d)) AS x FROM s JOIN dg p ON p.a = s.a JOIN dg q ON q.a = s.b)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(x, 6) AS x FROM x WHERE x > 0""")
def tag_ppmi(spark: SparkSession, d: str) -> DataFrame:
    return vectors.ppmi(_graph(spark, d)).withColumn("x", F.round("x", 6))


@register("tag2vec_singular_values")
def tag2vec_singular_values(spark: SparkSession, d: str) -> DataFrame:
    _, sigma = vectors.tag2vec(vectors.ppmi(_graph(spark, d)), _universe(spark, d), 16)
    return spark.createDataFrame(list(enumerate(sigma)), "rank int, sigma double")


@register("tag_knn", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT p.vec_id AS id, q.vec_id AS nn_id, list_cosine_similarity(p.e, q.e) AS sim FROM v p JOIN v q ON p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nn_id) AS rank FROM s)
SELECT CAST(id AS BIGINT) AS id, CAST(nn_id AS BIGINT) AS nn_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def tag_knn(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(a.unit_vectors(spark, d), 10).withColumn("sim", F.round("sim", 6))


@register("post2vec_norms", f"""WITH {a.POSTS}, {a.PAIRS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 64),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
c AS (SELECT vec_id, unnest(e) / l AS x, unnest(range(1, 65)) AS i FROM u),
w AS (SELECT t.tag_id, ln(((SELECT count(*) FROM posts WHERE NOT is_pending) + 10.0) / (post_count + 10.0)) AS idf FROM tags t),
s AS (SELECT post_id, i, sum(x * idf) AS x FROM pairs JOIN w USING (tag_id) JOIN c ON vec_id = pairs.tag_id GROUP BY 1, 2),
n AS (SELECT post_id, sqrt(sum(x * x)) AS l, max(CASE WHEN i = 1 THEN x END) AS first_, max(CASE WHEN i = 64 THEN x END) AS last_ FROM s GROUP BY post_id)
SELECT CAST(id AS BIGINT) AS post_id, CAST(CASE WHEN l > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length, round(coalesce(first_ / l, 0.0), 6) AS first_component, round(coalesce(last_ / l, 0.0), 6) AS last_component
FROM posts LEFT JOIN n ON post_id = id WHERE NOT is_pending""")
def post2vec_norms(spark: SparkSession, d: str) -> DataFrame:
    vecs = a.unit_vectors(spark, d).where("tag_id < 64")
    found = vectors.post2vec(a.post_tags(spark, d), a.posts(spark, d), vecs, 64, _stats(spark, d, "tags"))
    return found.select("post_id", F.round(norm(F.col("vec")), 6).alias("length"), F.round(F.col("vec")[0], 6).alias("first_component"), F.round(F.col("vec")[63], 6).alias("last_component"))


def _similar(id_: int) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT CAST(p.vec_id AS BIGINT) AS id, round(list_cosine_similarity(p.e, q.e), 6) AS sim FROM v p, (SELECT e FROM v WHERE vec_id = {id_}) q WHERE p.vec_id <> {id_} ORDER BY list_cosine_similarity(p.e, q.e) DESC, id LIMIT 10"""


@register("similar_posts", _similar(0))
def similar_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").alias("vec"))
    return vectors.similar_posts(rows, 0).withColumn("sim", F.round("sim", 6))


@register("similar_tags", _similar(1))
def similar_tags(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_tags(a.unit_vectors(spark, d), 1).withColumn("sim", F.round("sim", 6))


# validation


@register("duplicate_pair_check", """SELECT CAST(l_orderkey AS BIGINT) AS post_id, CAST(l_suppkey AS BIGINT) AS tag_id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_pair_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_pairs(a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("tag_id")))


@register("id_fingerprint", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS ids FROM lineitem")
def id_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return checks.fingerprint(a.table(spark, d, "lineitem"), "l_orderkey").select("rows", "ids")


@register("csv_parquet_reconcile", """SELECT side, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_id, CAST(min(o_orderkey) AS BIGINT) AS min_id, CAST(max(o_orderkey) AS BIGINT) AS max_id
FROM orders, (VALUES ('a'), ('b')) s(side) GROUP BY side""")
def csv_parquet_reconcile(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "orders-csv")
    rows = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = tables.read_text_csv(spark, path).select(F.col("id").cast("bigint").alias("id"))
    return checks.reconcile(back, rows.select("id"), "id", []).select("side", "rows", "sum_id", "min_id", "max_id")


@register("index_and_topk_checks", """SELECT * FROM (VALUES ('index equals relation', 'PASS', '0'), ('stored lists equal ranked ones', 'PASS', '0'), ('largest entropy is positive', 'PASS', '0'),
('edge weights are positive', 'PASS', '0'), ('tag pair weights are positive', 'PASS', '0'), ('vectors are unit or zero', 'PASS', '0'), ('neighbours are others', 'PASS', '0')) v("check", status, detail)""")
def index_and_topk_checks(spark: SparkSession, d: str) -> DataFrame:
    pairs = written(a.post_tags(spark, d), "pairs")
    ranked = written(stats.topk_posts(pairs, a.posts(spark, d), k=5), "ranked")
    vecs = written(a.unit_vectors(spark, d), "vectors")
    entropy = written(_entropy(spark, d, pairs=pairs), "entropy")
    long, ok = a.pool_posts(spark, d), pools.eligible_pools(entropy, max_h=3.3)
    n = F.count("*")
    out = checks.verdict(checks.index_faults(relation.inverted_index(pairs), pairs), "index equals relation", n)
    out = out.unionByName(checks.verdict(checks.topk_faults(stats.stored_topk(ranked), ranked), "stored lists equal ranked ones", n))
    out = out.unionByName(checks.pool_checks(entropy, pools.pool_edges(long, ok), _co(spark, d, pairs, ok)))
    out = out.unionByName(checks.verdict(checks.vector_faults(vecs, "tag_id", "vec", 64), "vectors are unit or zero", n))
    return out.unionByName(checks.verdict(checks.neighbour_faults(vectors.knn(vecs, 5)), "neighbours are others", n))


@register("events_windowed", "SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def events_windowed(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(a.table(spark, d, "events"), "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")
