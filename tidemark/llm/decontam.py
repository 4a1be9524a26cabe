"""Benchmark decontamination by winnowing.

Of a benchmark item's and a document's word k-grams, the least hash of each `w` neighbours is kept as a fingerprint, with
k + w - 1 = n words: any n words in a row that two texts share leave the same fingerprint in both.  Documents' fingerprints
are looked up among those of the benchmark; around each hit the n-word windows are compared word by word, which decides.
An item of fewer than n words is one window of its own length L, with k = L and w = 1.

A benchmark of at most `block_bytes` of text is broadcast as sorted arrays (about 5 times its size), and one pass over the
documents joins and extends; nothing is shuffled, whatever passages documents share.  Of a larger one the fingerprints are
joined to those of the documents by a shuffle (a document has each of its fingerprints once).  Then only documents that share
one are compared, with the blocks of the benchmark that they share it with, a block being some `block_bytes` and no less than
one item.  What moves on are the words that are hit, by the hashes of their text; texts are not written again.

Defined results: null texts and texts without words have no words, no hits and are not contaminated; null or empty items
match nothing; items are reported by distinct id, an item without an id counts for hits only; repeated rows are judged
alike; texts and items of any length are read whole; other columns are carried as they are; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.store import bounded_batches, few, identity, shared, written
from tidemark.llm.words import ALNUM, LOWER, grams, minima, pieces, split

#: a word, once A-Z are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 13
K = 7
BLOCK_BYTES = 8 << 20


class Index:
    """The windows of one block of items: by window length the fingerprints, the windows' hashes and where each is."""

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], n: int, k: int) -> None:
        self.n, self.k, self.ids = n, k, list(ids)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.text: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for item, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = split(raw, np.array([0, len(raw)]), ALNUM, LOWER)
            self.text.append((words.data.tobytes(), words.start.astype(np.int32), words.end.astype(np.int32)))
            size = min(n, len(words.start))
            if size:
                k_, w = self.shape(size)
                g = grams(words.hash, k_)
                found.setdefault(size, []).append((np.unique(g[minima(g, w)]), grams(words.hash, size), item))
        for size, each in found.items():
            windows = np.concatenate([x[1] for x in each])
            item = np.concatenate([np.full(len(x[1]), x[2], np.int32) for x in each])
            place = np.concatenate([np.arange(len(x[1]), dtype=np.int32) for x in each])
            order = np.argsort(windows, kind="stable")
            self.lengths[size] = np.unique(np.concatenate([x[0] for x in each])), windows[order], item[order], place[order]

    def shape(self, size: int) -> tuple[int, int]:
        """k and w for windows of `size` words."""
        return (self.k, self.n - self.k + 1) if size == self.n else (size, 1)

    def words_at(self, item: int, place: int, size: int) -> list[bytes]:
        data, start, end = self.text[item]
        return [data[start[i] : end[i]] for i in range(place, place + size)]


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _scan(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of the documents in data: first words, which words are hit, items' ids."""
    words = split(data, offsets, ALNUM, LOWER)
    h, doc = words.hash, words.doc_of()
    change = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
    for size, (prints, windows, item, place) in index.lengths.items():
        k, w = index.shape(size)
        total = len(h) - size + 1
        if total <= 0:
            continue
        whole = doc[:total] == doc[size - 1 :]  # windows that stay within a document
        g = grams(h, k)
        at = minima(g, w)  # by window: the place of its fingerprint
        hit = _member(g[at], prints) & whole
        starts = np.flatnonzero(hit)
        if not len(starts):
            continue
        full = grams(h, size)[starts]
        starts = starts[_member(full, windows)]
        for s in starts.tolist():
            value = grams(h[s : s + size], size)[0]
            a, b = np.searchsorted(windows, value, "left"), np.searchsorted(windows, value, "right")
            if [words.data[x:y].tobytes() for x, y in zip(words.start[s : s + size], words.end[s : s + size], strict=True)] != index.words_at(item[a], place[a], size):
                continue
            change[s] += 1
            change[s + size] -= 1
            items[doc[s]].update(index.ids[i] for i in set(item[a:b].tolist()) if index.ids[i] is not None)
    return words.first, np.cumsum(change)[:-1] > 0, items


_FIELDS = "n_words long, hits array<int>, items array<string>"


def _matcher(index: Index):
    def of(texts: pa.Array) -> list[pa.Array]:
        n_words: list[int] = []
        hits: list[list[int]] = []
        items: list[list[str]] = []
        for i, j, data, offsets in pieces(texts):
            first, hit, found = _scan(index, data, offsets)
            n_words += np.diff(first).tolist()
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            edge_at = np.flatnonzero(edge)
            if not len(edge_at):
                hits += [[]] * (j - i)
                items += [[]] * (j - i)
                continue
            for d in range(j - i):
                own = hit[first[d] : first[d + 1]]
                hits.append(np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist() if own.any() else [])
                items.append(sorted(found[d]))
        return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return of


def _hit_words(hits: F.Column) -> F.Column:
    """Words in the union of spans: an array of start, end, start, end and so on, or several arrays end to end."""
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(hits) / 2).cast("int") - 1)), lambda i: F.struct(F.get(hits, 2 * i).alias("a"), F.get(hits, 2 * i + 1).alias("b")))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["to"], x["a"]))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to"))
    total = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])
    return F.when(F.size(hits) == 0, F.lit(0)).otherwise(total).cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", n: int = N, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the carried columns), n_words, hits (word spans: start, end, ...), items (ids, sorted), n_hit."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        index = shared(docs.sparkSession, _index_of(items.select("id", "text"), n, k))
        return map_texts(docs, text_col, carry, lambda: _matcher(index.value), _FIELDS).withColumn("n_hit", _hit_words(F.col("hits")))

    bounded_batches(docs.sparkSession)
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(-(-total // block_bytes))).cast("int"))
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(text.alias("text"), identity(text).alias("key")).select("key.*", "text").where("text is not null")
    its = written(items.select("block", "text").mapInArrow(lambda b: _prints(b, n, k, None), "block int, size int, print long").distinct(), "prints")
    sizes = [r["size"] for r in its.select("size").distinct().collect()]  # n at most
    own = keyed.mapInArrow(lambda b: _prints(b, n, k, sizes), "h1 long, h2 long, size int, print long")
    wanted = written(own.join(its, ["size", "print"]).select("h1", "h2", "block").distinct(), "sharing")
    found = None
    for block in sorted(r["block"] for r in wanted.select("block").distinct().collect()):
        index = shared(docs.sparkSession, _index_of(items.where(F.col("block") == block).select("id", "text"), n, k))
        some = keyed.join(few(written(wanted.where(F.col("block") == block).select("h1", "h2"), "block")), ["h1", "h2"], "left_semi")
        part = map_texts(some, "text", ["h1", "h2"], lambda b=index: _matcher(b.value), _FIELDS).where(F.size("hits") > 0)
        part = written(part.groupBy("row.h1", "row.h2").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits")  # equal texts have equal hits
        found = part if found is None else found.unionByName(part)
    word = F.regexp_count(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.coalesce(word, F.lit(0)).cast("long").alias("n_words"), identity(text).alias("key")).select("row", "n_words", "key.*")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    if found is None:
        return out.select("row", "n_words", none("int").alias("hits"), none("string").alias("items"), F.lit(0).cast("long").alias("n_hit"))
    whole = found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a block
    out = out.join(few(written(whole, "hits")), ["h1", "h2"], "left")
    out = out.select("row", "n_words", F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("string")).alias("items"))
    return out.withColumn("n_hit", _hit_words(F.col("hits")))


def _index_of(items: DataFrame, n: int, k: int) -> Index:
    """Of a block of items, whose bytes are bounded."""
    rows = items.distinct().collect()
    return Index([r["id"] for r in rows], [r["text"] for r in rows], n, k)


def _prints(batches: Iterator[pa.RecordBatch], n: int, k: int, sizes: Sequence[int] | None) -> Iterator[pa.RecordBatch]:
    """The columns before the text, size, print: each text's fingerprints once, for windows of the given sizes, or of an item's
    own size."""
    for batch in batches:
        own = batch.schema.names[:-1]
        for i, _, data, offsets in pieces(batch.column(len(own))):
            words = split(data, offsets, ALNUM, LOWER)
            count, doc = np.diff(words.first), words.doc_of()
            for size in sizes if sizes is not None else range(1, n + 1):
                k_, w = (k, n - k + 1) if size == n else (size, 1)
                total = len(doc) - size + 1
                if total <= 0:
                    continue
                g = grams(words.hash, k_)
                inside = np.flatnonzero(doc[:total] == doc[size - 1 :])
                if sizes is None:
                    inside = inside[np.minimum(count[doc[inside]], n) == size]
                at = minima(g, w)[inside]
                pair = np.unique(np.stack([doc[inside], g[at].view(np.int64)], 1), axis=0)
                row = pa.array(i + pair[:, 0])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(len(own))), pa.array(np.full(len(pair), size, np.int32)), pa.array(np.ascontiguousarray(pair[:, 1]))], names=[*own, "size", "print"])


def contaminated() -> F.Column:
    """The contract's rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, dw.size, p FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
