"""Directed graphs as edge lists: strong components, the implication graph without cycles, and its ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aliases import canonical
from tidemark.storage import written


def _reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, f, b: the greatest node that reaches each, and the greatest that it reaches, along edges (a, b)."""
    found = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(False).alias("moved"))
    while True:
        for _ in range(3):  # steps between two written tables
            come = edges.join(found.select(F.col("node").alias("a"), "f"), "a").groupBy(F.col("b").alias("node")).agg(F.max("f").alias("come"))
            go = edges.join(found.select(F.col("node").alias("b"), F.col("b").alias("to")), "b").groupBy(F.col("a").alias("node")).agg(F.max("to").alias("go"))
            both = found.join(come, "node", "left").join(go, "node", "left")
            moved = F.coalesce(F.col("come") > F.col("f"), F.lit(False)) | F.coalesce(F.col("go") > F.col("b"), F.lit(False))
            found = both.select("node", F.greatest("f", "come").alias("f"), F.greatest("b", "go").alias("b"), moved.alias("moved"))
        found = written(found, "reach")
        if found.where("moved").isEmpty():  # the last of the steps moved nothing
            return found.drop("moved")


def scc(edges: DataFrame) -> DataFrame:
    """node, comp of every node of edges (a, b): nodes that reach each other have the same comp, the greatest of them.

    A node whose greatest predecessor is its greatest successor is in that one's component.  The others keep the edges
    between nodes that agree on both, since a component's nodes do, and are looked at again."""
    left = written(edges.select("a", "b").where("a <> b").distinct(), "scc")
    todo = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "scc")
    done: DataFrame | None = None
    while True:
        found = _reach(todo, left)
        settled = found.where("f = b").select("node", F.col("f").alias("comp"))
        done = settled if done is None else done.unionByName(settled)
        open_ = found.where("f <> b")
        if open_.isEmpty():
            return done
        todo = open_.select("node")
        ends = open_.select("node", F.struct("f", "b").alias("mark"))
        same = left.join(ends.select(F.col("node").alias("a"), F.col("mark").alias("ma")), "a").join(ends.select(F.col("node").alias("b"), F.col("mark").alias("mb")), "b")
        left = written(same.where("ma = mb").select("a", "b"), "scc")


def implication_dag(implications: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """a_id, b_id: active implications between known tags by canonical name, without those inside a strong component."""
    rows = implications.where("status = 'active'").select(F.col("antecedent_name").alias("a"), F.col("consequent_name").alias("b")).dropna()
    rows = canonical(canonical(rows, "a", aliases), "b", aliases).where("a <> b").distinct()
    ids = tags.groupBy("tag").agg(F.min("tag_id").cast("bigint").alias("id"))
    rows = rows.join(ids.withColumnRenamed("tag", "a").withColumnRenamed("id", "a_id"), "a").join(ids.withColumnRenamed("tag", "b").withColumnRenamed("id", "b_id"), "b")
    rows = written(rows.select("a", "b", "a_id", "b_id"), "implications")
    comp = scc(rows)
    rows = rows.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    return rows.where("ca <> cb").select("a_id", "b_id").distinct()


def ancestor_cache(dag: DataFrame, tags: DataFrame, depth: int = 3, top_percent: float = 0.05) -> DataFrame:
    """tag_id, ancestor_id, depth (of the shortest way) up to `depth` hops, from the nodes of most posts.

    top_percent of the dag's nodes, one at least; ties by id."""
    depth, top_percent = max(1, depth), min(1.0, max(0.0, top_percent))
    edges = written(dag.select("a_id", "b_id").distinct(), "dag")
    nodes = edges.select(F.col("a_id").alias("tag_id")).union(edges.select("b_id")).distinct()
    counts = tags.groupBy("tag_id").agg(F.max("post_count").alias("post_count"))
    top = max(1, int(nodes.count() * top_percent))
    start = nodes.join(counts, "tag_id", "left").orderBy(F.coalesce("post_count", F.lit(0)).desc(), "tag_id").limit(top).select("tag_id")
    reach = start.select("tag_id", F.col("tag_id").alias("at"), F.lit(0).alias("depth"))
    hops, found = reach, None
    for d in range(1, depth + 1):
        hops = hops.join(edges, hops["at"] == edges["a_id"]).select("tag_id", F.col("b_id").alias("at"), F.lit(d).alias("depth")).distinct()
        found = hops if found is None else found.unionByName(hops)
    near = found.where("at <> tag_id").groupBy("tag_id", F.col("at").alias("ancestor_id")).agg(F.min("depth").alias("depth"))
    return near.select("tag_id", "ancestor_id", F.col("depth").cast("tinyint").alias("depth"))


def top_by(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; the window's limit prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
