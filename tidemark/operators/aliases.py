"""Alias resolution: a functional graph of names, followed to its ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def active_pairs(aliases: DataFrame) -> DataFrame:
    """tag, to: the last active alias of each name that is not empty and not its own alias.

    `line` says which row is later; without it the largest consequent wins."""
    rows = aliases if "line" in aliases.columns else aliases.withColumn("line", F.lit(0))
    ok = (F.col("status") == "active") & (F.col("antecedent_name") != "") & (F.col("consequent_name") != "") & (F.col("antecedent_name") != F.col("consequent_name"))
    return rows.where(ok).groupBy(F.col("antecedent_name").alias("tag")).agg(F.max_by("consequent_name", F.struct("line", "consequent_name")).alias("to"))


def landing(pairs: DataFrame) -> DataFrame:
    """tag, land, low, cyclic of every name: where it ends after as many steps as there are aliases, by pointer doubling.

    An end that has no alias of its own is a terminal; any other is on a cycle, and `low` is that cycle's least name (low
    is the least name from the start on, so it means this for names on a cycle only)."""
    names = pairs.select(F.col("to").alias("tag")).join(pairs, "tag", "left_anti").distinct()
    step = written(pairs.select("tag", F.col("to").alias("land"), F.least("tag", "to").alias("low"), F.lit(False).alias("end")).unionByName(names.select("tag", F.col("tag").alias("land"), F.col("tag").alias("low"), F.lit(True).alias("end"))), "aliases")
    ends = step.where("end").select("tag")
    for _ in range(max(1, step.count().bit_length())):
        far = step.select(F.col("tag").alias("land"), F.col("land").alias("next"), F.col("low").alias("next_low"))
        after = written(step.join(far, "land").select("tag", F.col("next").alias("land"), F.least("low", "next_low").alias("low"), "end"), "aliases")
        step = after
    terminal = ends.select(F.col("tag").alias("land"), F.lit(False).alias("not_cyclic"))
    return step.join(terminal, "land", "left").select("tag", "land", "low", F.col("not_cyclic").isNull().alias("cyclic"))


def alias_map(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """tag, canon of each aliased name: its chain's end, or the name of most posts (unknown: -1; then the least) of the cycle
    that its chain runs into."""
    pairs = active_pairs(aliases)
    ends = written(landing(pairs), "landing")
    counts = tags.groupBy("tag").agg(F.max("post_count").alias("post_count"))
    on_cycle = ends.where("cyclic").select(F.col("land").alias("tag")).distinct()
    cycle = on_cycle.join(ends.select("tag", "low"), "tag").join(counts, "tag", "left")
    best = cycle.withColumn("n", F.row_number().over(Window.partitionBy("low").orderBy(F.coalesce("post_count", F.lit(-1)).desc(), "tag"))).where("n = 1").select("low", F.col("tag").alias("best"))
    of_land = cycle.select(F.col("tag").alias("land"), "low").join(best, "low").select("land", "best")
    out = ends.join(pairs.select("tag"), "tag", "left_semi").join(of_land, "land", "left")
    return out.select("tag", F.coalesce("best", "land").alias("canon"))


def canonical(names: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """`names` with `column` replaced by its canonical name where it has one."""
    m = mapping.select(F.col("tag").alias("__tag"), F.col("canon").alias("__canon"))
    joined = names.join(m, names[column] == F.col("__tag"), "left")
    return joined.withColumn(column, F.coalesce("__canon", column)).drop("__tag", "__canon")


def roots(aliases: DataFrame) -> DataFrame:
    """tag, root by lower-cased names: the chain's end, or where it stands after as many steps as there are aliases."""
    low = aliases.withColumn("antecedent_name", F.lower("antecedent_name")).withColumn("consequent_name", F.lower("consequent_name"))
    return landing(active_pairs(low)).select("tag", F.col("land").alias("root"))


def resolve_tag(tags: DataFrame, aliases: DataFrame, name: str, suggest: int = 20, stored: DataFrame | None = None) -> tuple[list[int], list[str]]:
    """Ids for a name: the id itself if it is digits, else a name equal in any case, else the alias's end; else no id, and up
    to `suggest` names that contain it.  Blanks around the name don't count.  stored: roots(aliases), kept from before."""
    name = name.strip()
    if name.isascii() and name.isdigit():
        return [int(name)], []
    exact = lambda x: [r["tag_id"] for r in tags.where(F.lower("tag") == x.lower()).select("tag_id").orderBy("tag_id").limit(suggest).collect()]
    if found := exact(name):
        return found, []
    row = (roots(aliases) if stored is None else stored).where(F.col("tag") == name.lower()).first()
    if row and (found := exact(row["root"])):
        return found, []
    near = tags.where(F.col("tag").contains(name)).select("tag").orderBy("tag").limit(suggest).collect()
    return [], [r["tag"] for r in near]
