"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

language_id      drops documents without a language: no text or no letter
near_duplicates  keeps one document of each group of near copies (five-word shingles, similarity 0.8), that of least id
decontamination  drops documents of which a twentieth or more of the words are benchmark passages
secrets          puts <secret> in the place of each secret found; n_chars follows
mixing           takes sources to their target weights; returns the documents taken, with the number of copies

Rows pass with all their columns; a column of the input that has the name of one that the last stage adds is replaced.  A
stage's result must be written before the next stage is called: what a stage holds (tables in the shared folder, broadcasts) is
released when the next one begins.

Defined results, in every stage: nulls in any column are carried as they are.  A null or empty text has no language and leaves
in the first stage; given to a later stage alone it stays, is no near duplicate, is not contaminated, has no secrets and, as
it has size 0, is mixed as often as its source is taken whole, at no words.  Rows without an id pass like others, and stand after those with an id in near_duplicates;
without a source they are a source of their own.  Repeated rows are near duplicates of each other, one stays; in the other
stages each is judged alike.  Ties go to the least id, then to the least hash of the row.  Texts of any length are read whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, secrets
from tidemark.llm.jaccard import Join
from tidemark.llm.store import release, scope, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_HELD: list[object] = []


def stage(f: Stage) -> Stage:
    """Releases what the stage before held, and notes what this one holds."""

    @wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _HELD)
        with scope() as held:
            out = f(spark, docs, sf_dir)
        _HELD.extend(held)
        return out

    return run_


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, carry=docs.columns)
    return found.where(F.col("lang_pred") != "und").select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Join(docs, words=5, num=80, den=100).kept()


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(docs, benchmark, carry=docs.columns).where(~decontam.contaminated()).select("row.*")


@stage
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs, carry=docs.columns)
    clean = F.size("spans") == 0
    text = F.when(clean, F.col("row.text")).otherwise(secrets.redacted(F.col("row.text"), F.col("spans")))
    n_chars = F.when(clean, F.col("row.n_chars")).otherwise(F.char_length(text).cast("long"))
    new = {"text": text, "n_chars": n_chars}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ["size", "source_size", "target", "copies", "taken"]
    taken = mixing.mix_sources(docs, carry=docs.columns).where("copies > 0")
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added), *added)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", hide_secrets),
    ("mixing", mix),
]
#: the classifiers of two stages can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, make in STAGES[:-1]:
        docs = written(make(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
