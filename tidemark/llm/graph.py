"""Connected components of an edge list of any size, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b): root is the least node of the component."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        least = label.join(near, label["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("least"))
        jump = label.select(F.col("node").alias("least"), F.col("root").alias("far"))
        after = written(least.join(jump, "least").select("node", F.col("root").alias("was"), F.col("far").alias("root")), "labels")
        drop(label)
        label = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            drop(both)
            return label
