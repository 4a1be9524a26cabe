"""URL filter: explicit host and path rules first, else association rules mined from labelled URLs.

Mining: Spark's FP-growth finds combinations of URL tokens (host labels, path segments, query keys) that go with a label.
Tokens that occur in the same labelled URLs are one item, any of which stands for all: a combination of them says no more than
one alone, and fourteen of them would have 16,000 combinations.

Pruning is by support and by confidence against the label's own share: a rule needs `min_count` URLs, however large the table,
and the odds of its label among them must be `min_lift` times its odds among all labelled URLs (half a URL is added on either
side, so that a few URLs without exception don't count as certainty).  A label that is rare thus has rules of lower confidence
than a common one.  Rules are pruned that are implied by a rule of the same label, one item shorter and of at least the same
lift, which also decides wherever they would.  What remains is the model, without a limit.

Matching: each rule is listed under its rarest item; a URL is joined with the rules of its own items only, and a rule fits if
all its items are there.  The fitting rule of the largest lift decides; without one, `default` does.

Defined results: a null URL, or one without `://`, has empty host and path, fits no explicit rule and gets the default; a
null label is no label; without labelled rows there are no mined rules, nor where all have one label, which is no news then;
rules of equal lift go by support, then fewer items, then the items and the label in order; repeated rows are judged alike, and
count as often as they are labelled; URLs of any length are read whole; extra columns are not read; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import few, written

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "label="
MIN_COUNT = 10
MIN_LIFT = 3.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null without one.  Ties go to the earlier rule."""
    name = verdict = F.lit(None).cast("string")
    for what, its_host, its_path in sorted(reversed(list(rules)), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == its_host) | F.endswith(host, F.lit("." + its_host))) & F.startswith(path, F.lit(its_path))
        name, verdict = F.when(fits, F.lit(its_host + its_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels, path segments (numbers as one token) and query keys."""
    low = F.translate(path, UPPER, LOWER)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.filter(F.split(low, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, segments, keys))


def _odds(own: Column, all_: Column) -> Column:
    return (own + F.lit(0.5)) / (all_ - own + F.lit(0.5))


def mine(labelled: DataFrame, *, min_count: int, min_lift: float) -> tuple[DataFrame, DataFrame] | None:
    """token, item of the tokens in `min_count` URLs or more; and a, label, confidence, lift, freq of the pruned rules, a: their
    items.

    labelled: tokens array, label string."""
    known = written(labelled.where("label is not null").select("tokens", "label", F.monotonically_increasing_id().alias("row")), "labelled")
    each = known.select("row", "label", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(f"m{i}") for i in (1, 2)]  # of the set of URLs a token is in
    often = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= min_count)
    members = written(often.select("token", F.min("token").over(Window.partitionBy("n", "m1", "m2")).alias("item")), "members")
    baskets = each.join(few(members), "token").groupBy("row", "label").agg(F.collect_set("item").alias("items"))
    baskets = written(baskets.select(F.array_append("items", F.concat(F.lit(LABEL), "label")).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return None
    shares = known.groupBy("label").agg(F.count("*").alias("own")).withColumn("base", _odds(F.col("own"), F.lit(known.count())))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_count - 0.5, 0.5) / n)).fit(baskets)  # rounds up to min_count
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    is_label = lambda x: F.startswith(x, F.lit(LABEL))
    alone = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("a"), F.col("freq").alias("all"))
    both = sets.where(F.exists("items", is_label)).select(F.filter("items", lambda x: ~is_label(x)).alias("a"), F.filter("items", is_label)[0].alias("label"), "freq")
    both = both.withColumn("label", F.substring("label", len(LABEL) + 1, 1 << 20)).join(few(written(shares, "shares")), "label")
    lift = (_odds(F.col("freq"), F.col("all")) / F.col("base")).alias("lift")
    rules = both.join(alone, "a").select("a", "label", (F.col("freq") / F.col("all")).alias("confidence"), lift, "freq")
    rules = written(rules.where(F.col("lift") >= min_lift), "rules")
    shorter = rules.select("a", "label", "lift", F.explode("a").alias("x")).select(F.col("a").alias("whole"), F.array_remove("a", F.col("x")).alias("a"), "label", F.col("lift").alias("its"))
    implied = shorter.join(rules, ["a", "label"]).where("lift >= its").select(F.col("whole").alias("a"), "label")
    return members, written(rules.join(implied, ["a", "label"], "left_anti"), "model")


def judged_by(sets: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, mined of the distinct token arrays of `sets` that a rule fits: the verdict of the first that does."""
    items = rules.select("a", "label", F.explode("a").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("n"))
    rarest = items.join(often, "item").groupBy("a", "label").agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    first = F.struct((-F.col("lift")).alias("l"), (-F.col("freq")).alias("f"), F.size("a").alias("n"), "a", "label").alias("first")
    listed = written(rules.join(rarest, ["a", "label"]).select("item", "a", first), "index")
    have = sets.distinct().select("tokens", F.explode("tokens").alias("token")).join(few(members), "token").groupBy("tokens").agg(F.collect_set("item").alias("have"))
    fits = have.select("tokens", "have", F.explode("have").alias("item")).join(listed, "item").where(F.size(F.array_except("a", "have")) == 0)
    return fits.groupBy("tokens").agg(F.min("first")["label"].alias("mined"))


def filter_urls(
    urls: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_count: int = MIN_COUNT,
    min_lift: float = MIN_LIFT,
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict of every URL.  labels: the id column and `label`, a verdict."""
    url = F.col("url")
    own = urls.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    parts = own.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    parts = parts.withColumn("tokens", F.coalesce(tokens(url, F.col("host"), F.col("path")), F.array().cast("array<string>")))
    known = labels.select(F.col(f"`{id_col}`").alias("its"), "label")
    model = mine(parts.join(known, F.col("id") == F.col("its")).select("tokens", "label"), min_count=min_count, min_lift=min_lift)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", name).withColumn("by_rule", verdict)
    judged = judged.join(judged_by(parts.select("tokens"), *model), "tokens", "left") if model else judged.withColumn("mined", F.lit(None).cast("string"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", "mined", F.lit(default)).alias("verdict"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label: block if the document of the same number is labelled toxic or of low quality, else allow."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.when(bad, "block").when(~bad, "allow").alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_labels(spark, sf_dir))


#: host, path and rule can be written in SQL; so can the verdicts of the explicit rules
PARTS_SQL = r"""
WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS i, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, CASE WHEN i = 0 THEN '' ELSE regexp_extract(substr(url, i + 3), '^[^/?#]*') END AS raw, CASE WHEN i = 0 THEN '' ELSE substr(url, i + 3) END AS rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(host_, path_, verdict_) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, host_ || path_ AS rule, verdict_, row_number() OVER (PARTITION BY page_id ORDER BY length(host_) + length(path_) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_))
SELECT page_id, host, path, rule, verdict_ AS verdict_by_rule FROM f WHERE n = 1
"""


def parts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict_by_rule"))
