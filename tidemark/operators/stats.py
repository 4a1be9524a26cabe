"""Tag statistics: smoothed IDF, pairwise mutual information, ranked posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relation import reliable
from tidemark.storage import written


def local_stats(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """tag_id, avg_score, avg_fav, df_local over the given posts."""
    narrow = posts.select(F.col("id").alias("post_id"), "score", "fav_count")
    return pairs.join(narrow, "post_id").groupBy("tag_id").agg(F.avg("score").alias("avg_score"), F.avg("fav_count").alias("avg_fav"), F.count("*").alias("df_local"))


def agreement(stats: DataFrame) -> float:
    """Correlation of the logarithms of global and local counts over the top hundredth of tags; 1 where it is undefined."""
    n = stats.count()
    top = stats.orderBy(F.desc("post_count"), "tag_id").limit(max(1, int(n * 0.01)))
    logs = top.select(F.log1p("post_count").alias("a"), F.log1p("df_local").alias("b"), "post_count", "df_local")
    row = logs.agg(F.count("*").alias("n"), F.sum("post_count").alias("x"), F.sum("df_local").alias("y"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("cov")).first()
    if row["n"] < 2 or not row["x"] or not row["y"]:
        return 1.0
    return row["cov"] / (row["sa"] * row["sb"]) if row["sa"] and row["sb"] else float("nan")


def tag_stats(dictionary: DataFrame, pairs: DataFrame, posts: DataFrame, alpha: float = 1000.0, source: str = "auto", threshold: float = 0.90, reliable_only: bool = True) -> DataFrame:
    """The dictionary with avg_score, avg_fav, df_local and idf = ln((N + alpha) / (count + alpha)).

    source says which count: `tags` post_count, `local` df_local, `auto` the local one if the two agree badly."""
    rows = reliable(posts) if reliable_only else posts
    stats = dictionary.join(local_stats(pairs, rows), "tag_id", "left").withColumn("df_local", F.coalesce("df_local", F.lit(0)).cast("bigint"))
    if source == "auto":
        source = "local" if agreement(stats) < threshold else "tags"
    n = rows.count()
    count = F.col("df_local" if source == "local" else "post_count")
    return stats.withColumn("idf", F.ln((F.lit(float(n)) + alpha) / (count + F.lit(alpha))))


def rarest(pairs: DataFrame, dictionary: DataFrame, top_m: int) -> DataFrame:
    """The top_m tags of fewest posts of each post; ties by id."""
    counts = dictionary.select("tag_id", "post_count")
    order = Window.partitionBy("post_id").orderBy(F.col("post_count").asc_nulls_first(), "tag_id")
    return pairs.join(counts, "tag_id", "left").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_m).select("post_id", "tag_id")


def pairs_of(sorted_ids: F.Column) -> F.Column:
    """All pairs (a, b) with a before b of an array: at most m * (m - 1) / 2 of a bounded array, without a join."""
    return F.flatten(F.transform(sorted_ids, lambda x, i: F.transform(F.slice(sorted_ids, i + 2, F.size(sorted_ids)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def tag_pmi(pairs: DataFrame, dictionary: DataFrame, support: int = 50, top_m: int = 16) -> DataFrame:
    """a, b (a < b), support, pmi of tags that occur together; counts are those of the posts' top_m rarest tags."""
    lists = rarest(pairs, dictionary, top_m).groupBy("post_id").agg(F.array_sort(F.collect_list("tag_id")).alias("tags"))
    # one aggregate counts pairs, tags (b is null) and posts (both are)
    none = F.lit(None).cast(pairs.schema["tag_id"].dataType)
    marks = F.concat(pairs_of(F.col("tags")), F.transform("tags", lambda t: F.struct(t.alias("a"), none.alias("b"))), F.array(F.struct(none.alias("a"), none.alias("b"))))
    counts = lists.select(F.explode(marks).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("support"))
    counts = written(counts.where(F.col("b").isNull() | (F.col("support") >= support)), "pair-counts")
    posts = counts.where("a is null").first()
    total = F.lit(float(posts["support"] if posts else 0))
    single = counts.where("a is not null and b is null").select(F.col("a").alias("tag_id"), F.col("support").alias("n"))
    both = counts.where("b is not null")
    both = both.join(single.select(F.col("tag_id").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("tag_id").alias("b"), F.col("n").alias("nb")), "b")
    pmi = F.ln((F.col("support") / total + F.lit(1e-12)) / ((F.col("na") / total) * (F.col("nb") / total) + F.lit(1e-12)))
    return both.select("a", "b", "support", pmi.alias("pmi"))


def topk_posts(pairs: DataFrame, posts: DataFrame, mode: str = "static", k: int = 5000, k_min: int = 100, k_max: int = 5000, beta: float = 10.0, reliable_only: bool = True) -> DataFrame:
    """tag_id, post_id, rank by favourites, score and id, all descending.

    static: k posts of each tag; sqrt_df: ceil(sqrt(df) * beta) of them, between k_min and k_max, df over all pairs."""
    rows = (reliable(posts) if reliable_only else posts).select(F.col("id").alias("post_id"), "fav_count", "score")
    order = Window.partitionBy("tag_id").orderBy(F.desc_nulls_first("fav_count"), F.desc_nulls_first("score"), F.desc("post_id"))
    most = k if mode == "static" else k_max
    ranked = pairs.join(rows, "post_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if mode == "static":
        return ranked.select("tag_id", "post_id", "rank")
    if mode != "sqrt_df":
        raise ValueError(f"no mode {mode!r}")
    limits = pairs.groupBy("tag_id").agg(F.count("*").alias("df"))
    limits = limits.select("tag_id", F.least(F.greatest(F.ceil(F.sqrt("df") * F.lit(beta)), F.lit(k_min)), F.lit(k_max)).alias("k"))
    return ranked.join(limits, "tag_id").where("rank <= k").select("tag_id", "post_id", "rank")


def stored_topk(ranked: DataFrame) -> DataFrame:
    """tag_id, post_ids: the lists as they are stored, ascending by id."""
    return ranked.groupBy("tag_id").agg(F.array_sort(F.collect_list("post_id")).alias("post_ids"))
