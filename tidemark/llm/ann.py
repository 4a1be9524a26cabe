"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation with exact reranking.

Unit vectors are cut into blocks of two dimensions with 16 codewords each (four bits).  Codebooks and codes lower the
score-aware loss: the part of the residual parallel to the vector, which changes the inner products that matter, weighs
`eta` times the orthogonal part.  Codebooks, the centres of coarse lists and the two figures below are fitted on a bounded
sample of `max_sample` vectors (those of least hash), the same way at every size.

Every row is coded once: its list, its codes packed two to a byte, and the length of its residual are stored beside it.  A
query goes to the `probe` lists whose centres are nearest; on the sample, that many hold all but a PROBED share of true
neighbours.  Lists are dealt to jobs of at most about `rows` rows and `query_block` queries, so a list that a third of all rows
are in is many jobs.  A job scans by table look-ups: for each byte of codes a table of 256 sums of block scores (rounded to 8
bits) per query, added up as 16-bit integers, a quarter of the exact product's multiplications as additions.  The best `rerank`
rows are scored exactly, in double precision on the original vectors, and so is every other row whose quantised score, raised
by `slack` residual lengths, reaches the k-th exact score, however many there are, so crowds of near copies lose nothing.
`slack` is what all but a PROBED share of the sample's true neighbours need; 1 is the bound that none can exceed.  The best k of
each job meet in a bounded aggregate.  Of equal vectors in a job only the k + 1 of smallest id are scanned, since the others
lose every tie.

Defined results: null, zero, empty vectors and ones with null or non-finite components take no part, nor do rows without an
id that is a number or of another dimension than most; components of any size do, vectors being scaled by powers of two; a
query's own id is no candidate; equal scores go to the smaller id; a repeated row counts once, as does an id that has the same
score by several rows; queries with fewer candidates than k get all that their lists hold; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import bounded_batches, shared, written

WORDS = 16  # codewords of a block: four bits
BLOCK_DIMS = 2
PROBED = 0.001
#: coarse lists at most
LISTS = 512
#: vectors of the sample that are looked up in it
_ASKED = 512


def eta(threshold: float, dims: int) -> float:
    """Weight of the parallel residual for inner products of `threshold` or more on unit vectors."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """books: blocks x WORDS x BLOCK_DIMS."""

    def __init__(self, books: np.ndarray, weight: float) -> None:
        self.books, self.weight = books, weight

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of unit vectors (padded to blocks): coordinate descent on the loss, block by block."""
        blocks = len(self.books)
        parts = x.reshape(len(x), blocks, BLOCK_DIMS)
        plain = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(-1)  # rows x blocks x words
        along = np.einsum("rbd,bwd->rbw", parts, self.books)
        codes = plain.argmin(-1)
        at = np.arange(len(x))
        total = along[at[:, None], np.arange(blocks), codes].sum(1)
        for _ in range(rounds):
            for b in range(blocks):
                rest = total - along[at, b, codes[:, b]]
                # |r|^2 + (weight - 1) * (r . x)^2, with r . x = 1 - x . coded
                loss = plain[:, b] + (self.weight - 1) * (1 - rest[:, None] - along[:, b]) ** 2
                codes[:, b] = loss.argmin(1)
                total = rest + along[at, b, codes[:, b]]
        return codes.astype(np.uint8)

    def residual(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes miss of unit vectors: no inner product with a unit vector is off by more."""
        coded = self.books[np.arange(len(self.books)), codes].reshape(len(x), -1)
        return np.sqrt(((x - coded) ** 2).sum(1))


def fit(sample: np.ndarray, weight: float, rounds: int = 6, seed: int = 3) -> Quantiser:
    """Codebooks by alternating score-aware codes and weighted least squares, block by block."""
    rng = np.random.default_rng(seed)
    rows, dims = sample.shape
    blocks = dims // BLOCK_DIMS
    parts = sample.reshape(rows, blocks, BLOCK_DIMS)
    books = np.stack([parts[rng.choice(rows, WORDS, replace=rows < WORDS), b] for b in range(blocks)])
    q = Quantiser(books, weight)
    for _ in range(rounds):
        codes = q.encode(sample, 1)
        for b in range(blocks):
            coded = q.books[np.arange(blocks), codes]
            other = 1 - np.einsum("rbd,rbd->r", parts, coded) + np.einsum("rd,rd->r", parts[:, b], coded[:, b])
            for w in range(WORDS):
                own = codes[:, b] == w
                if own.any():
                    u, t = parts[own, b], other[own]
                    a = own.sum() * np.eye(BLOCK_DIMS) + (weight - 1) * u.T @ u
                    q.books[b, w] = np.linalg.solve(a + 1e-9 * np.eye(BLOCK_DIMS), u.sum(0) + (weight - 1) * (t[:, None] * u).sum(0))
    return q


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1: no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, padded to whole bytes of codes."""
    x = scaled(x)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    return np.pad(u, ((0, 0), (0, -u.shape[1] % (2 * BLOCK_DIMS))))


def centres_of(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Spherical k-means; a list without vectors keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        for c in np.unique(own):
            mean = sample[own == c].sum(0)
            if (length := np.sqrt(mean @ mean)) > 0:
                centres[c] = mean / length
    return centres


class Model(NamedTuple):
    quantiser: Quantiser
    centres: np.ndarray
    probe: int  # lists that a query goes to
    slack: float  # residual lengths that a quantised score may lack


def learn(sample: np.ndarray, weight: float, lists: int, k: int) -> Model:
    """sample: unit vectors."""
    quantiser, centres = fit(sample, weight), centres_of(sample, lists)
    codes = quantiser.encode(sample)
    coded = quantiser.books[np.arange(len(quantiser.books)), codes].reshape(len(sample), -1)
    off = quantiser.residual(sample, codes)
    asked = np.arange(0, len(sample), max(1, len(sample) // _ASKED))
    exact = sample[asked] @ sample.T
    exact[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    own = (sample @ centres.T).argmax(1)
    order = np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape), 1)
    needed = np.take_along_axis(place, own[near], 1) + 1
    lack = np.take_along_axis(exact, near, 1) - np.einsum("qd,qkd->qk", sample[asked], coded[near])
    ok = np.isfinite(lack)
    slack = np.quantile((lack / np.maximum(off[near], 1e-9))[ok], 1 - PROBED) if ok.any() else 1.0
    probe = int(np.quantile(needed[ok], 1 - PROBED, method="higher")) if ok.any() else lists
    return Model(quantiser, centres, min(lists, probe), float(min(1.0, max(0.05, 1.1 * slack))))


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes of two blocks in each byte, the first in the lower half."""
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def tables(books: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, float]:
    """bytes x 256 x queries: rounded scores of both blocks of each byte of codes, and the unit they are counted in."""
    scores = np.einsum("qbd,bwd->bwq", units.reshape(len(units), len(books), BLOCK_DIMS), books)
    step = max(1e-12, np.abs(scores).max() / 127)
    scores = np.round(scores / step).astype(np.int16)
    both = scores[1::2, :, None] + scores[::2, None, :]
    return both.reshape(len(books) // 2, WORDS * WORDS, len(units)), step


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """rows x queries: sums of looked-up entries."""
    out = table[0][codes[:, 0]]
    row = np.empty_like(out)
    for i in range(1, len(table)):
        out += np.take(table[i], codes[:, i], axis=0, out=row, mode="clip")
    return out


def usable(vector: Column) -> Column:
    """Not null, with finite components, not all of them zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


_SLACK = 1e-6  # more than what float32 and float64 sums can be off
_PAIRS = 1 << 16  # exact scores computed at once
_TOGETHER = 128  # queries scanned at once

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Job:
    """The rows of a job, ready to be searched: equal vectors and repeated rows reduced to those that can be among k."""

    def __init__(self, model: Model, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, off: np.ndarray, k: int) -> None:
        order = np.lexsort((ids,))
        _, same = np.unique(vectors[order], axis=0, return_inverse=True)
        same = same.ravel()
        by = np.argsort(same, kind="stable")
        its = ids[order][by]
        by = by[np.concatenate([[True], (same[by][1:] != same[by][:-1]) | (its[1:] != its[:-1])])]  # repeated rows
        start = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        keep = order[by[rank <= k]]
        self.model, self.k = model, k
        self.ids, self.vectors, self.codes, self.off = ids[keep], scaled(vectors[keep]), codes[keep], off[keep]
        self.length = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = _unit(self.vectors).astype(np.float32)

    def search(self, ids: np.ndarray, queries: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """queries x k: ids and scores of the best, -inf where there are fewer."""
        k, n, rows = self.k, len(ids), len(self.ids)
        queries = scaled(queries)
        units, norms = _unit(queries), np.sqrt((queries * queries).sum(1))
        best_ids, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

        def score(q: np.ndarray, r: np.ndarray) -> np.ndarray:
            exact = np.einsum("pd,pd->p", self.vectors[r], queries[q]) / (self.length[r] * norms[q])
            exact[self.ids[r] == ids[q]] = -np.inf
            return exact

        def merge(new_ids: np.ndarray, new: np.ndarray) -> None:
            all_ids, all_scores = np.concatenate([best_ids, new_ids], 1), np.concatenate([best, new], 1)
            order = np.lexsort((all_ids, -all_scores), axis=1)
            all_ids, all_scores = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
            again = (all_ids[:, 1:] == all_ids[:, :-1]) & (all_scores[:, 1:] == all_scores[:, :-1])
            all_scores[:, 1:][again] = -np.inf
            order = np.argsort(-all_scores, axis=1, kind="stable")[:, :k]
            best_ids[:], best[:] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)

        take = min(rerank, rows)
        table, step = tables(self.model.quantiser.books, units)
        about = scan(table, self.codes)  # rows x queries
        picked = np.argpartition(about, rows - take, axis=0)[rows - take :] if take < rows else np.tile(np.arange(rows)[:, None], (1, n))
        merge(self.ids[picked.T], score(np.repeat(np.arange(n), take), picked.T.ravel()).reshape(n, take))
        if take == rows:
            return best_ids, best
        floor = best[:, -1] - _SLACK
        reach = about * np.float32(step) + (self.model.slack * self.off + _SLACK + step * len(table)).astype(np.float32)[:, None]
        could = reach >= floor[None, :].astype(np.float32)
        np.put_along_axis(could, picked, False, 0)
        rows_ = np.flatnonzero(could.any(1))
        # one product over the rows that any of these queries may need, then the few pairs that reach the floor
        near = (units.astype(np.float32) @ self.unit[rows_].T >= (floor - 1e-5)[:, None]) & could[rows_].T
        q, r = np.nonzero(near)
        for low in range(0, len(q), _PAIRS):
            here, its = q[low : low + _PAIRS], rows_[r[low : low + _PAIRS]]
            exact = score(here, its)
            order = np.lexsort((self.ids[its], -exact, here))
            here, its, exact = here[order], its[order], exact[order]
            single = np.concatenate([[True], (here[1:] != here[:-1]) | (self.ids[its][1:] != self.ids[its][:-1]) | (exact[1:] != exact[:-1])])
            here, its, exact = here[single], its[single], exact[single]
            place = np.arange(len(here)) - np.searchsorted(here, here)
            ok = place < k
            new_ids, new = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
            new_ids[here[ok], place[ok]], new[here[ok], place[ok]] = self.ids[its[ok]], exact[ok]
            merge(new_ids, new)
        return best_ids, best


def _searcher(model, k: int, rerank: int, dims: int):
    def of(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        column = lambda t, c: t.column(c).chunk(0)
        codes = np.frombuffer(b"".join(column(rows, "code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        job = Job(model.value, column(rows, "id").to_numpy(), _matrix(column(rows, "v"), dims), codes, column(rows, "off").to_numpy(), k)
        ids, asked, out = column(queries, "id").to_numpy(), _matrix(column(queries, "v"), dims), []
        for at in range(0, len(ids), _TOGETHER):
            found, scores = job.search(ids[at : at + _TOGETHER], asked[at : at + _TOGETHER], rerank)
            q, c = np.nonzero(scores > -np.inf)
            out.append((ids[at + q], found[q, c], scores[q, c]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_FOUND)

    return of


def _coded(model, dims: int):
    """id, v, list, code, off of each row."""

    def of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dims))
            codes = model.value.quantiser.encode(unit)
            code = packed(codes)
            off = model.value.quantiser.residual(unit, codes)
            own = (unit @ model.value.centres.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(off)], names=["id", "v", "list", "code", "off"])

    return of


def _routed(model, dims: int):
    """id, v, lists of each query."""

    def of(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-(_unit(_matrix(batch.column(1), dims)) @ model.value.centres.T), axis=1, kind="stable")[:, : model.value.probe]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    return of


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    rerank: int = 100,
    threshold: float = 0.2,
    max_sample: int = 10_000,
    query_block: int = 4096,
    rows: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for each row that `queries` (over `id`) picks."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    vector = F.col(f"`{vector_col}`")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    own = vectors.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), vector.cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dims, total = sizes["dims"], sizes["count"]
    own = own.where(F.size("v") == dims)
    sample = own.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(min(max_sample, max(1000, (64 << 20) // (8 * dims)))).select("v").toArrow().column(0).combine_chunks()
    units = np.unique(_unit(_matrix(sample, dims)), axis=0)  # a row that is repeated would be its own neighbour
    lists = max(1, min(LISTS, int(total**0.5 / 8), len(units) // 32))
    model = shared(spark, learn(units, eta(threshold, dims), lists, k))

    coded = written(own.mapInArrow(_coded(model, dims), f"id long, v {kind}, list int, code binary, off double"), "codes")
    asked = own.where(queries).mapInArrow(_routed(model, dims), f"id long, v {kind}, lists array<int>")
    asked = written(asked.select("id", "v", F.explode("lists").alias("list")), "queries")
    # a row for each list
    shape = coded.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")), "list")
    shape = F.broadcast(written(shape, "shape"))
    part = lambda n: F.pmod(F.xxhash64(F.lit(8), "id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(shape, "list").select("list", part(F.col("parts")).alias("part"), every("blocks").alias("block"), "id", "v", "code", "off")
    right = asked.join(shape, "list").select("list", every("parts").alias("part"), part(F.col("blocks")).alias("block"), "id", "v")
    job = ["list", "part", "block"]
    find = _searcher(model, k, rerank, dims)
    found = left.groupBy(*job).cogroup(right.groupBy(*job)).applyInArrow(lambda x, y: find(x, y), "query_id long, vec_id long, score double")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
