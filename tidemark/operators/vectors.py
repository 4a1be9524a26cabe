"""Tag and post vectors: co-occurrence graph, PPMI, truncated SVD, exact neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vector import cosine, dot, normalised, weighted_sum
from tidemark.operators.relation import reliable
from tidemark.storage import written


#: tag vectors up to this size are broadcast as one matrix
MATRIX_BYTES = 64 << 20
#: digits to which inner products are compared; queries multiplied with a batch at once, and groups of the batch whose maxima
#: bound a query's k-th largest product
DIGITS, QUERIES, GROUPS = 9, 256, 256


def tag_universe(tag_stats: DataFrame, min_df: int = 100, max_tags: int = 200_000) -> DataFrame:
    """tag_id, df of the tags of enough posts, the most frequent max_tags of them; ties by id."""
    count = [F.col(c) for c in ("df_local", "post_count") if c in tag_stats.columns]
    df = tag_stats.select(F.col("tag_id").cast("bigint").alias("tag_id"), F.coalesce(*count, F.lit(0)).cast("bigint").alias("df"))
    return df.where(F.col("df") >= min_df).orderBy(F.desc("df"), "tag_id").limit(max_tags)


def tag_graph(universe: DataFrame, pmi: DataFrame | None, co: DataFrame | None, source: str = "merge", alpha: float = 0.5) -> DataFrame:
    """a, b, w (a < b): pmi plus alpha times the collections' weight, of positive ones between tags of the universe."""
    parts = []
    if source in ("pmi", "merge"):
        parts.append(pmi.where("pmi > 0").select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b"), F.col("pmi").cast("double").alias("w")))
    if source in ("pools", "merge"):
        parts.append(co.where("weight > 0").select(F.least("a_tag_id", "b_tag_id").cast("bigint").alias("a"), F.greatest("a_tag_id", "b_tag_id").cast("bigint").alias("b"), (F.col("weight") * F.lit(float(alpha))).alias("w")))
    if not parts:
        raise ValueError(f"no source {source!r}")
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    known = universe.select("tag_id")
    edges = edges.join(known.withColumnRenamed("tag_id", "a"), "a", "left_semi").join(known.withColumnRenamed("tag_id", "b"), "b", "left_semi")
    return edges.groupBy("a", "b").agg(F.sum("w").alias("w"))


def ppmi(graph: DataFrame, shift: float = 0.0) -> DataFrame:
    """a, b, x in both directions: ln(w * S / (d_a * d_b)) - shift where it is positive."""
    edges = graph.where("w > 0").select("a", "b", "w")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    rows = both.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    x = F.ln(F.col("w") * F.lit(float(total)) / (F.col("da") * F.col("db"))) - F.lit(float(shift))
    return rows.select("a", "b", x.alias("x")).where("x > 0")


def tag2vec(weights: DataFrame, universe: DataFrame, dim: int = 128) -> tuple[DataFrame, list[float]]:
    """tag_id, vec (unit rows of U * sqrt(S)) and the singular values; tags without an edge get zeros.

    The rank is below the number of tags; vectors are padded with zeros to dim.  The matrix stays distributed; only the
    Gramian's dim leading vectors meet on the driver."""
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    spark = weights.sparkSession
    order = Window.orderBy("tag_id")
    place = written(universe.select("tag_id", (F.row_number().over(order) - 1).cast("bigint").alias("row")), "universe")  # at most max_tags rows
    n = place.count()
    cells = weights.join(place.select(F.col("tag_id").alias("a"), F.col("row").alias("i")), "a").join(place.select(F.col("tag_id").alias("b"), F.col("row").alias("j")), "b").select("i", "j", "x")
    cells = written(cells, "cells")
    rank = min(dim, n - 1)
    zeros = place.select("tag_id", F.array_repeat(F.lit(0.0), dim).alias("vec"))
    if rank < 1 or cells.isEmpty():
        return zeros, []
    each = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("cells"))  # at most max_tags of them
    sparse = each.select("i", F.transform("cells", lambda c: c["j"].cast("int")).alias("js"), F.transform("cells", lambda c: c["x"]).alias("xs"))
    matrix = IndexedRowMatrix(sparse.rdd.map(lambda r: IndexedRow(r["i"], SparseVector(n, r["js"], r["xs"]))), n, n)
    svd = matrix.computeSVD(rank, computeU=True)
    sigma = [float(s) for s in svd.s.toArray()]
    rows = spark.createDataFrame(svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray()])), "row bigint, u array<double>")
    roots = F.array(*(F.lit(float(np.sqrt(s))) for s in sigma))
    vec = normalised(F.zip_with("u", roots, lambda x, s: x * s))
    vec = F.concat(vec, F.array_repeat(F.lit(0.0), dim - len(sigma)))
    found = place.join(rows, "row").select("tag_id", vec.alias("vec"))
    return written(found.unionByName(zeros.join(found, "tag_id", "left_anti")), "tag2vec"), sigma


def _bests(q: np.ndarray, v: np.ndarray, least: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column, product of each query's k largest products with v, to DIGITS; ties by `least`.

    floor: by query, what its k-th largest product is at least; raised in place.  A matrix product, whose sums differ from those
    in the order of the components by less than `slack`, says which pairs are worth an exact sum."""
    rough = q @ v.T
    rough[np.isnan(rough)] = -np.inf
    m = len(v) // GROUPS
    if m > 1 and k <= GROUPS:  # the k-th largest of the groups' maxima is at most the k-th largest of all
        tops = rough[:, : m * GROUPS].reshape(len(q), m, GROUPS).max(axis=1)
        np.maximum(floor, np.partition(tops, GROUPS - k, axis=1)[:, GROUPS - k], out=floor)
    elif len(v) > k:
        np.maximum(floor, np.partition(rough, len(v) - k, axis=1)[:, len(v) - k], out=floor)
    length = lambda x: np.sqrt((x * x).sum(1))
    slack = 2 * 10.0**-DIGITS + (q.shape[1] + 4) * 2.0**-52 * length(q) * (length(v).max() if len(v) else 0)
    row, col = np.nonzero(rough >= (floor - np.where(np.isfinite(slack), slack, np.inf))[:, None])
    sim = np.zeros(len(row))
    for d in range(q.shape[1]):
        sim += q[row, d] * v[col, d]
    ok = sim > -np.inf
    row, col, sim = row[ok], col[ok], sim[ok]
    order = np.lexsort((least[col], -np.round(sim, DIGITS), row))
    row, col, sim = row[order], col[order], sim[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], sim[place < k]


def knn(vectors: DataFrame, k: int = 32, id_col: str = "tag_id", vec_col: str = "vec", query_block: int = 4096, queries: DataFrame | None = None) -> DataFrame:
    """id, nn_id, sim, rank: the exact k largest inner products of each row with the others; products that are equal to DIGITS
    digits are ties, which go by id.

    Equal vectors form a class, of which the first few ids can be neighbours of one row; classes are searched, and each row
    takes what its class found.  Queries come in blocks of bounded size; every task multiplies its classes with a block."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    own = written(own, "vectors")
    most = k + (own.groupBy("id").count().agg(F.max("count")).first()[0] or 1)  # rows of one id leave k of so many
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= most)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), F.col("members")[0].alias("least"), "v", "members"), "classes")
    asked = own if queries is None else own.join(queries.select(F.col(id_col).cast("bigint").alias("id")), "id", "left_semi")
    asked = written(asked.join(classes.select("class", "v"), "v").select("id", "class", "v"), "queries")
    wanted = written(asked.select("class").distinct(), "wanted")
    blocks = max(1, -(-wanted.count() // query_block))
    its = classes.join(wanted, "class", "left_semi").select("class", "v") if queries is not None else classes.select("class", "v")
    found = None
    for block in range(blocks):
        rows = its.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        matrix = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            floor = np.full(len(q), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                its, least = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(its), -1)
                for i in range(0, len(q), QUERIES):
                    row, col, sim = _bests(q[i : i + QUERIES], v, least, floor[i : i + QUERIES], most)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(its[col]), pa.array(least[col]), pa.array(sim)], names=["asked", "class", "least", "sim"])

        part = classes.select("class", "least", "v").mapInArrow(search, "asked long, class long, least long, sim double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "id long, nn_id long, sim double, rank int")
    near = lambda by, id_: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("sim", DIGITS)), id_))
    found = found.withColumn("n", near("asked", "least")).where(F.col("n") <= most)
    found = found.join(classes.select("class", "members"), "class").select("asked", F.explode("members").alias("nn_id"), "sim")
    found = found.withColumn("n", near("asked", "nn_id")).where(F.col("n") <= most).drop("n")
    pairs = asked.select("id", F.col("class").alias("asked")).join(found, "asked").where(F.col("id") != F.col("nn_id"))
    return pairs.select("id", "nn_id", "sim", near("id", "nn_id").alias("rank")).where(F.col("rank") <= k)


def post2vec(pairs: DataFrame, posts: DataFrame, tag_vecs: DataFrame, dims: int, tag_stats: DataFrame | None = None, reliable_only: bool = True) -> DataFrame:
    """post_id, vec: the unit vector of the sum of idf * vec over a post's distinct tags; zero stays zero.

    pairs: distinct.  Tags without a vector are left out, an unknown idf is 1.  Where the vectors take at most MATRIX_BYTES they
    are broadcast as a matrix and only weights are shuffled; else each pair brings its vector along."""
    rows = (reliable(posts) if reliable_only else posts).select(F.col("id").alias("post_id"))
    weights = tag_vecs if tag_stats is None else tag_vecs.join(tag_stats.select("tag_id", "idf"), "tag_id", "left")
    weight = F.lit(1.0) if tag_stats is None else F.coalesce("idf", F.lit(1.0))
    known = weights.select("tag_id", F.struct(F.col("tag_id"), weight.alias("weight"), "vec").alias("t"))
    if tag_vecs.count() * (dims + 1) * 8 <= MATRIX_BYTES:
        return _summed(pairs, rows, weights.select("tag_id", weight.alias("weight"), F.col("vec").cast("array<double>").alias("vec")), dims)
    own = pairs.join(known, "tag_id").groupBy("post_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    empty = F.array_repeat(F.lit(0.0), dims)
    return rows.join(own, "post_id", "left").select("post_id", F.when(F.col("ts").isNull(), empty).otherwise(normalised(weighted_sum(F.col("ts"), dims))).alias("vec"))


def _summed(pairs: DataFrame, rows: DataFrame, known: DataFrame, dims: int) -> DataFrame:
    """post2vec by a broadcast matrix: a post's tags are gathered, their rows summed in the order of tags."""
    found = known.orderBy("tag_id").toArrow()
    ids, weight = (found.column(i).to_numpy() for i in (0, 1))
    matrix = found.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims) * weight[:, None]
    shared = pairs.sparkSession.sparkContext.broadcast((ids.astype(np.int64), matrix))
    lists = pairs.groupBy("post_id").agg(F.array_sort(F.collect_list(F.col("tag_id").cast("bigint"))).alias("tags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            lists = batch.column(1).fill_null([])
            n = lists.value_lengths().to_numpy()
            tags = lists.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(ids, tags), max(0, len(ids) - 1))
            has = ids[at] == tags if len(ids) else np.zeros(len(tags), bool)
            of = np.repeat(np.arange(len(n)), n)[has]
            out = np.zeros((batch.num_rows, dims))
            if len(of):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                out[of[first]] = np.add.reduceat(matrix[at[has]], first, axis=0)
            length = np.sqrt((out * out).sum(1))
            out[length > 0] /= length[length > 0][:, None]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], names=["post_id", "vec"])

    return rows.join(lists, "post_id", "left").select("post_id", "tags").mapInArrow(run, f"post_id {rows.schema['post_id'].dataType.simpleString()}, vec array<double>")


def similar(vectors: DataFrame, id_col: str, vec_col: str, id_: int, k: int, include_query: bool = False) -> DataFrame:
    """id, sim: the k rows most similar by cosine to the row of that id; an error if there is none."""
    row = vectors.where(F.col(id_col) == id_).select(F.col(vec_col).cast("array<double>")).first()
    if row is None:
        raise KeyError(f"no vector for {id_}")
    query = F.array(*(F.lit(float(x)) for x in row[0]))
    rows = vectors if include_query else vectors.where(F.col(id_col) != id_)
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), query).alias("sim")).orderBy(F.desc_nulls_last("sim"), "id").limit(k)


def similar_posts(vectors: DataFrame, post_id: int, k: int = 10, include_query: bool = False) -> DataFrame:
    return similar(vectors, "post_id", "vec", post_id, k, include_query)


def similar_tags(vectors: DataFrame, tag_id: int, k: int = 10, knn: DataFrame | None = None) -> DataFrame:
    """From stored neighbours where there are any, else by all vectors."""
    if knn is not None:
        stored = knn.where(F.col("id") == tag_id).select(F.col("nn_id").alias("id"), "sim")
        if not stored.isEmpty():
            return stored.orderBy(F.desc("sim"), "id").limit(k)
    return similar(vectors, "tag_id", "vec", tag_id, k)


__all__ = ["cosine", "dot", "knn", "post2vec", "ppmi", "similar", "similar_posts", "similar_tags", "tag2vec", "tag_graph", "tag_universe"]
