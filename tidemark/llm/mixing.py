"""Mixing sources to target weights by capped water-filling and seeded repetition.

Targets: weight * level, clamped at `max_epochs` times the source's size; the level is the one at which the targets add
up to the budget, found by raising it over the unclamped sources until no further source is clamped.

Repetitions: a source with target e * size takes every document floor(e) times, and one more time a seeded sample whose
sizes add up to the fraction.  The sample takes documents in the order of a seeded hash; one larger than what is left is set
aside and the next ones are tried, so it ends when every document left is larger than what lacks; one more is taken if that
brings the sum nearer.  Where the prefix by hash stops is found from two histograms of the hash (4096 cells each), so no
source's documents are ever sorted or gathered in one place, only those of one cell in 16 million.  The step is repeated on
the documents after the stop that still fit, until none or at most `_FEW` remain, which are tried one by one.

Tables by source, and the list of documents taken beyond a prefix, are broadcast where their bytes allow it, so texts aren't
moved; where there are too many sources they are joined by a shuffle.

Defined results: null text has size 0; a null source is a source of its own, the last; a source of size 0 has target 0;
repeated rows and null ids are documents like others, equal hashes go by the order of rows; texts of any length count whole;
empty tables give empty results; columns that aren't carried are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import few, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 20240229
_CELLS = 12  # bits of each histogram
_FEW = 100_000  # documents that are tried one by one instead of by another pair of histograms


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """source, source_size, weight: weights repeat along the sources by code point, null last.

    Ranks come from a range-partitioned sort and the partitions' row counts, so sources may be many."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = max(1, min(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 200))
    sorted_ = totals.repartitionByRange(n, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    sorted_ = written(sorted_.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "sources")
    before = sorted_.groupBy("part").agg(F.count("*").alias("n"))  # at most n rows
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("row") + F.col("before"), F.lit(len(weights))) + 1).cast("int"))
    return sorted_.join(F.broadcast(before), "part").select("source", "source_size", place.alias("weight"))


def fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """Adds `target`.  sources: source, source_size, weight; budget: words of the mix, by default all there are."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    row = sources.agg(F.sum("source_size").alias("t"), F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("w")).first()
    total = float(budget if budget is not None else row["t"] or 0)
    level = total / row["w"] if row["w"] else 0.0
    while level:
        over = F.col("weight") * F.lit(level) > cap
        row = sources.where("source_size > 0").agg(F.sum(F.when(over, cap)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            break
        raised = (total - (row["c"] or 0.0)) / row["w"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.withColumn("target", F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(level), cap)).otherwise(F.lit(0.0)))


def _limit(cells: DataFrame, goal: str, cell: str, out: str) -> DataFrame:
    """By source: the first cell that the goal does not wholly cover, and what is left for it."""
    w = Window.partitionBy("source").orderBy(cell)
    upto = cells.withColumn("upto", F.sum("words").over(w)).where(F.col("upto") > F.col(goal))
    first = upto.groupBy("source").agg(F.min_by(F.struct(cell, (F.col("upto") - F.col("words")).alias("under")), F.col(cell)).alias("x"))
    return first.select("source", F.col(f"x.{cell}").alias(out), F.col("x.under").alias("under"))


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """By source, null being one; the right table has a row for each source, or for each of a bounded number of cells."""
    return left.join(right.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")), how).drop("its")


def _stops(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, stop, left: the first document by hash that the goal does not cover, and what is left of the goal before it.

    rows: source, size, at, whose order is the hash's; goals: source, goal.  A source that its goal wholly covers has no row."""
    rows = rows.select("source", "size", "at", F.col("at.c1").alias("c1"), F.col("at.c2").alias("c2"))
    goals = few(written(goals, "goals"))
    hist1 = written(rows.groupBy("source", "c1").agg(F.sum("size").alias("words")), "cells")
    at1 = _joined(_limit(_joined(hist1, goals), "goal", "c1", "b1"), goals).select("source", "b1", (F.col("goal") - F.col("under")).alias("goal1"))
    at1 = few(written(at1, "limit1"))
    hist2 = _joined(rows, at1).where("c1 = b1").groupBy("source", "c2", "goal1").agg(F.sum("size").alias("words"))
    at2 = _joined(_limit(hist2, "goal1", "c2", "b2"), at1).select("source", "b1", "b2", (F.col("goal1") - F.col("under")).alias("goal2"))
    inside2 = _joined(rows, few(written(at2, "limit2"))).where("c1 = b1 and c2 = b2")
    upto = inside2.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("at"))).where("upto > goal2")
    first = upto.groupBy("source").agg(F.min(F.struct("at", (F.col("goal2") - F.col("upto") + F.col("size")).alias("left"))).alias("x"))
    return few(written(first.select("source", F.col("x.at").alias("stop"), F.col("x.left").alias("left")), "stops"))


def _first_fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Of at most `_FEW` documents of one source, in the order of the hash, those that still fit."""
    rows = rows.sort_values(["c1", "c2", "u", "row_id"])
    left, out = float(rows["left"].iloc[0]) if len(rows) else 0.0, []
    for row_id, size in zip(rows["row_id"], rows["size"], strict=True):
        if size <= left:
            left -= size
            out.append((row_id, size))
    return pd.DataFrame(out, columns=["row_id", "size"]).astype("int64").assign(source=rows["source"].iloc[0] if len(rows) else None)


def _later(slim: DataFrame, stops: DataFrame) -> DataFrame:
    """source, row_id, size of the documents after the stops that are taken: those that fit, by hash, when they are reached.

    What was set aside is larger than what is left from then on, so the size alone keeps it out."""
    rest = _joined(slim.where("size > 0"), stops).where("at > stop and size <= left").drop("stop")
    out = None
    while True:
        rest = written(rest, "rest")
        last = rest.count() <= _FEW
        if last:
            flat = rest.select("source", "size", "left", "at.*")
            found = flat.groupBy("source").applyInPandas(_first_fit, flat.select("row_id", "size", "source").schema)
        else:
            stops = _stops(rest, rest.select("source", F.col("left").alias("goal")).distinct())
            reached = _joined(rest.drop("left"), stops, "left")
            found = reached.where("stop is null or at < stop").select("at.row_id", "size", "source")
            rest = reached.where("at > stop and size <= left").drop("stop")
        found = written(found.select("source", "row_id", "size"), "later")
        out = found if out is None else out.unionByName(found)
        if last:
            return out


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    budget: float | None = None,
    seed: int = SEED,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """row (the carried columns), size, source_size, target, copies, taken of every row of docs."""
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"))
    u = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"))
    sizes = written(words.select("*", u.alias("u"), F.monotonically_increasing_id().alias("row_id")), "sizes")
    c1 = F.shiftrightunsigned("u", 64 - _CELLS).alias("c1")
    c2 = F.shiftrightunsigned("u", 64 - 2 * _CELLS).bitwiseAND(F.lit((1 << _CELLS) - 1)).alias("c2")
    at = F.struct(c1, c2, "u", "row_id").alias("at")
    slim = sizes.select("source", "size", at)

    by_source = fill(ranked_sources(slim, weights), max_epochs, budget)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs + F.lit(1e-9))
    by_source = by_source.withColumn("whole", whole).withColumn("goal", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    by_source = written(by_source, "targets")
    stops = _stops(slim, by_source.where("goal > 0").select("source", "goal"))
    later = _later(slim, stops)
    used = later.groupBy("source").agg(F.sum("size").alias("used"))
    lack = few(written(_joined(stops, used, "left").select("source", "stop", (F.col("left") - F.coalesce("used", F.lit(0))).alias("lack")), "lack"))
    over = _joined(slim.where("size > 0"), lack).where("at >= stop and size < 2 * lack").select("source", "size", "at", F.col("at.row_id").alias("row_id"))
    over = over.join(later.select("row_id"), "row_id", "left_anti")  # all larger than what lacks: one more brings the sum nearer than none
    over = over.groupBy("source").agg(F.min(F.struct("size", "at")).alias("x")).select("x.at.row_id")
    more = few(written(later.select("row_id").unionByName(over).withColumn("more", F.lit(1)), "extra"))

    limits = few(written(_joined(by_source, stops.select("source", "stop"), "left"), "limits"))
    out = _joined(sizes.withColumn("at", at), limits, "left").join(more, "row_id", "left")
    once = F.when((F.col("at") < F.col("stop")) | F.col("more").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("whole") + once).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: sizes and targets can be written in SQL; the weights repeat along the sources, and the level rises until no source is above its cap
TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total FROM s),
level(i, l) AS (
  SELECT 0, (SELECT total FROM t) / (SELECT CAST(sum(w) AS DOUBLE) FROM s WHERE source_size > 0)
  UNION ALL
  SELECT i + 1, ((SELECT total FROM t) - coalesce((SELECT sum(3.0 * source_size) FROM s WHERE source_size > 0 AND CAST(w AS DOUBLE) * l > 3.0 * source_size), 0))
    / (SELECT CAST(sum(w) AS DOUBLE) FROM s WHERE source_size > 0 AND CAST(w AS DOUBLE) * l <= 3.0 * source_size)
  FROM level WHERE i < 30)
SELECT doc_id, size, source_size, round(CASE WHEN source_size > 0 THEN least(CAST(w AS DOUBLE) * (SELECT max(l) FROM level), 3.0 * source_size) ELSE 0.0 END, 3) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""
