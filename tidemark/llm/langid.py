"""Language identification by string kernels.

A text's features are the presence of its blended byte n-grams (n = 1, 2, 3; letters' case folded, ASCII marks and digits
as blanks), hashed to DIM bits.  The kernel of two texts is the number of common features over the root of the product of
their numbers.  A bounded sample of labelled documents (`per_lang` for each language, at most `max_sample`) is learned from:
some are Nystrom landmarks, one-versus-rest kernel ridge regression gives each language a weight for each landmark, and a
batch of texts is scored by two matrix products.

The model's size is bounded by its documented parameters: at most `max_langs` languages are learned, those of most documents (ties
by code point), with at most `n_landmarks` landmarks, or two a language if that is more.

Defined results: a null text, or one without any letter, is `und` with score 0; a null lang is never learned from, nor is a
row without an id; with nothing to learn from all texts are `und`; equal scores go to the first language by code point;
repeated rows are judged alike; texts of any length are read whole; other columns are carried as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.store import shared
from tidemark.llm.words import LOWER, pieces

BITS = 14
DIM = 1 << BITS
ROWS = 256  # texts in a matrix product
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
#: odd multipliers for n-grams of 1, 2 and 3 bytes
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917], np.uint32)


class Model(NamedTuple):
    langs: list[str]
    landmarks: np.ndarray  # DIM x landmarks, each column divided by the root of its number of features
    weights: np.ndarray  # landmarks x langs
    sharpness: float


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x DIM, 1 where a text has an n-gram of that hash."""
    n = len(offsets) - 1
    out = np.zeros(n * DIM, np.uint8)
    data = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offsets))
    code = data
    for k in range(3):
        if k:
            code = code[:-1] + (data[k:] << np.uint32(8 * k))
        if not len(code):
            break
        at = doc[: len(code)] + ((code * _MULTIPLY[k]) >> np.uint32(32 - BITS))
        out[at[doc[: len(code)] == doc[k : k + len(code)]] if k else at] = 1
    return out.reshape(n, DIM)


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return (x @ landmarks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def fit(rows: np.ndarray, langs: Sequence[str], n_landmarks: int, ridge: float, sharpness: float) -> Model:
    """rows: presence of each text.  Landmarks are taken evenly from the languages, in the order of the rows."""
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs])
    each = max(1, n_landmarks // len(names))
    picked = np.concatenate([np.flatnonzero(of == c)[:each] for c in range(len(names))])
    marks = rows[picked].astype(np.float32)
    marks = (marks / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]).T.copy()
    k_nm = np.concatenate([kernel(rows[i : i + ROWS], marks) for i in range(0, len(rows), ROWS)]).astype(np.float64)
    k_mm = k_nm[picked]
    y = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    a = k_nm.T @ k_nm + ridge * len(rows) * k_mm + 1e-6 * len(rows) * np.eye(len(picked))
    return Model(names, marks, np.linalg.solve(a, k_nm.T @ y).astype(np.float32), sharpness)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    out = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _predictor(model: Model | None):
    def of(texts: pa.Array) -> list[pa.Array]:
        langs: list[str] = []
        scores: list[float] = []
        for i, j, data, offsets in pieces(texts, rows=ROWS):
            letter = has_letter(data, offsets)
            if model is None:
                letter[:] = False
                best, score = np.zeros(j - i, int), np.zeros(j - i)
            else:
                s = (kernel(presence(data, offsets), model.landmarks) @ model.weights).astype(np.float64) * model.sharpness
                best = s.argmax(1)
                score = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            langs += [model.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
            scores += np.where(letter, score, 0.0).tolist()
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return of


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int, max_sample: int, max_langs: int, n_landmarks: int, ridge: float, sharpness: float) -> Model | None:
    """Learns from at most per_lang documents of each language, those of least hash, and max_sample in all."""
    id_, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    own = docs.select(id_.alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    most = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, min(max_langs, max_sample // 2)))
    counts = {r["lang"]: r["count"] for r in most.collect()}
    if not counts:
        return None
    each = min(per_lang, max_sample // len(counts))  # 2 at least, as languages are
    # the least hashes of a language lie below this share of it, so that few texts are moved
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, (2 * each + 50) / n))))
    draw = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 30)).alias("draw")
    near = own.select("*", draw).where(F.col("draw") < share[F.col("lang")] * (1 << 30))
    picked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))).where(F.col("n") <= each)

    def pack(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([x.tobytes() for _, _, data, offsets in pieces(texts, rows=ROWS) for x in np.packbits(presence(data, offsets), axis=1)], pa.binary())]

    found = map_texts(picked, "text", ["lang", "draw"], lambda: pack, "bits binary").select("row.lang", "row.draw", "bits").collect()
    found.sort(key=lambda r: (r["lang"], r["draw"], r["bits"]))
    rows = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in found]), axis=1)
    return fit(rows, [r["lang"] for r in found], max(n_landmarks, 2 * len(counts)), ridge, sharpness)


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: Sequence[str] = ("doc_id",),
    per_lang: int = 512,
    max_sample: int = 8192,
    max_langs: int = 256,
    n_landmarks: int = 256,
    ridge: float = 1e-5,
    sharpness: float = 4.0,
) -> DataFrame:
    """row (the carried columns), lang_pred, score."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang, max_sample=max_sample, max_langs=max_langs, n_landmarks=n_landmarks, ridge=ridge, sharpness=sharpness)
    scorer = shared(docs.sparkSession, model)  # DIM x landmarks numbers of 4 bytes
    return map_texts(docs, text_col, carry, lambda: _predictor(scorer.value), "lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
