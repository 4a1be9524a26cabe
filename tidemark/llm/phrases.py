"""Substring dedup by automata of repeated phrases.

A window is `n` consecutive words.  Every window that also starts in a document with a smaller id is found, and the words
it covers are removed, in four steps:

1. Sieve: of a document's 5-word grams the least hash of each n - 4 neighbours is an anchor, so a window has an anchor that
   depends on its words only.  Anchors that one document only has are dropped.  Runs of windows whose anchor recurs are the
   candidate passages, cut from every document; all later steps move those alone.  Passages are numbered off into parts of
   PART_BYTES of text.
2. Confirm: each part sends each of its windows' hashes once, with the least and the greatest place it has it at; of a
   window's rows the first is the owner's, and the parts that have it at a later place are told.  A part then finds the windows
   that are repetitions among its own words.  Of a run of these, every n-th and the last cover all of its words.
3. The text of those windows, which are the repeated phrases, is taken from the owner's passage, once for each shard.
4. Each shard (a bounded number of phrases) compiles an Aho-Corasick automaton and streams its passages through it; every
   occurrence in a document that comes after the owner is located in the words themselves, whatever the hashes said.

A window that a third of all documents share is a row for each part in step 2 and for each shard in step 3.  What is streamed
in step 4 is the candidate passages of all documents, each through the automaton of its shard, which has the phrases of these
passages: whole texts through all automata would be as many passes over the corpus as there are shards, a number that grows with
the corpus, and a word outside the passages cannot be repeated.

Defined results: null texts and texts of fewer than n words lose nothing; a row without an id comes after all others, and
rows of equal id (or none) are not before each other; ids are numbers or texts of numbers, any other text counts as no id;
repeated rows are judged alike; texts of any length are read whole; other columns are carried as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.store import bounded_batches, few, identity, shared, written
from tidemark.llm.words import BLANKS, grams, minima, pieces, split

N = 13
K = 5
#: recurring anchors that are broadcast as a sorted array (8 bytes each); more are joined to their documents by a shuffle
BROADCAST_ANCHORS = 4_000_000
#: text of a part's passages; the arrays made of it take some 40 times as much
PART_BYTES = 1 << 20
#: phrases of a shard; their automaton takes some 100 MB
SHARD = 8_000
LAST = (1 << 63) - 1  # the place of rows without an id


def anchors(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """By window: the hash of its anchor."""
    g = grams(h, k)
    at = minima(g, n - k + 1)
    return g[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """anchor and the document's columns before its text, once for each document."""
    for batch in batches:
        own = batch.schema.names[:-1]
        for i, j, data, offsets in pieces(batch.column(len(own))):
            words = split(data, offsets, BLANKS)
            doc = words.doc_of()
            if len(words.hash) < n:
                continue
            inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
            a, d = anchors(words.hash, n, k)[inside], doc[: len(inside)][inside]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            if fresh.any():
                at = pa.array(i + d[fresh])
                yield pa.RecordBatch.from_arrays([pa.array(a[fresh].view(np.int64)), *(batch.column(c).take(at) for c in range(len(own)))], names=["anchor", *own])


def _passages(data: np.ndarray, offsets: np.ndarray, n: int, k: int, known: np.ndarray) -> list[list[dict]]:
    """By text: its runs of windows with a known anchor, as first word and words joined by blanks."""
    words = split(data, offsets, BLANKS)
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    total = len(words.hash) - n + 1
    if total <= 0 or not len(known):
        return out
    doc = words.doc_of()
    a = anchors(words.hash, n, k)
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    hit = (known[at] == a) & (doc[:total] == doc[n - 1 :])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # windows s to e - 1; a run that goes on in the next text is cut there
        cuts = [s, *(np.flatnonzero(np.diff(doc[s:e])) + s + 1).tolist(), e]
        for x, y in zip(cuts, cuts[1:], strict=False):
            last = y + n - 2
            text = b" ".join(data[words.start[x] : words.end[last]].tobytes().split())
            out[doc[x]].append({"start": int(x - words.first[doc[x]]), "text": text.decode("utf-8", "replace")})
    return out


def _numbered(found: list[list[dict]], state: dict[str, int]) -> list[list[dict]]:
    """The passages of a task with their parts: the task's number, then that of each stretch of PART_BYTES."""
    for passages in found:
        for p in passages:
            p["part"] = (state["task"] << 32) + state["bytes"] // state["part"]
            state["bytes"] += len(p["text"])
    return found


def _numbering(part_bytes: int) -> dict[str, int]:
    return {"task": TaskContext.get().partitionId(), "bytes": 0, "part": part_bytes}


def _windows(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the passages: hash, row of the passage, first word."""
    out = []
    for i, _, data, offsets in pieces(text):
        words = split(data, offsets, BLANKS)
        doc = words.doc_of()
        inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        out.append((grams(words.hash, n)[inside].view(np.int64), i + doc[inside], inside - words.first[doc[inside]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


_WINDOW = "window long, place long, most long, part long, passage long, pos int"


def _window_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """From passages (passage, place, part, text): each window of a part once, with its first place, passage and position,
    and the greatest place."""
    for batch in batches:
        window, row, pos = _windows(batch.column(3), n)
        passage, place, part = (batch.column(i).to_numpy()[row] for i in range(3))
        order = np.lexsort((pos, passage, place, window, part))
        window, place, part, passage, pos = (x[order] for x in (window, place, part, passage, pos))
        new = np.ones(len(window), bool)
        new[1:] = (window[1:] != window[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        columns = [window[first], place[first], place[last], part[first], passage[first], pos[first].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _WINDOW.split(", ")])


_OWNED = "its_part long, window long, owner_place long, owner long, owner_pos int"


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of window, place, passage and pos: for each part that has a window after its first place, where
    the first is."""
    first: list[np.ndarray] = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.int32)]
    for batch in batches:
        window, place, most, part, passage, pos = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(first))
        if not len(window):
            continue
        carried = len(first[0])
        start = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        of = np.repeat(start, np.diff(np.append(start, len(window))))
        later = most > place[of]
        later[:carried] = False  # told before
        at = np.flatnonzero(later)
        own = of[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[at], window[at], place[own], passage[own], pos[own])], names=[x.split()[0] for x in _OWNED.split(", ")])
        s = start[-1]
        first = [x[s : s + 1] for x in (window, place, most, part, passage, pos)]


_COVER = pa.schema([("passage", pa.int64()), ("owner", pa.int64()), ("owner_pos", pa.int32()), ("owner_place", pa.int64())])


def _covering(n: int):
    """A part's owned windows and its passages: of each run of repeated windows every n-th and the last."""

    def of(owned: pa.Table, passages: pa.Table) -> pa.Table:
        if not owned.num_rows or not passages.num_rows:
            return _COVER.empty_table()
        known, at = np.unique(owned.column("window").to_numpy(), return_index=True)
        owner_place, owner, owner_pos = (owned.column(c).to_numpy()[at] for c in ("owner_place", "owner", "owner_pos"))
        window, row, pos = _windows(passages.column("text"), n)
        its = np.minimum(np.searchsorted(known, window), len(known) - 1)
        hit = (known[its] == window) & (passages.column("place").to_numpy()[row] > owner_place[its])
        its, row, pos = its[hit], row[hit], pos[hit]
        if not len(row):
            return _COVER.empty_table()
        joins = np.concatenate([[False], (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)])
        start = np.flatnonzero(~joins)
        index = np.arange(len(pos)) - np.repeat(start, np.diff(np.append(start, len(pos))))
        keep = (index % n == 0) | np.concatenate([~joins[1:], [True]])
        its = its[keep]
        return pa.table([pa.array(passages.column("passage").to_numpy()[row[keep]]), pa.array(owner[its]), pa.array(owner_pos[its]), pa.array(owner_place[its])], schema=_COVER)

    return of


def _phrase_texts(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, at, phrase = [], [], []
            for passage, text, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split(" ")
                for p in positions:
                    owner.append(passage)
                    at.append(p)
                    phrase.append(" ".join(words[p : p + n]))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(at, pa.int32()), pa.array(phrase, pa.string())], names=["owner", "owner_pos", "phrase"])

    return of


def _located(n: int):
    """A shard's phrases (phrase, owner_place) and passages (h1, h2, place, start, text): spans of words to remove, by h1, h2."""

    def of(phrases: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        automaton = ahocorasick.Automaton()
        for phrase, owner in zip(phrases["phrase"], phrases["owner_place"], strict=True):
            automaton.add_word(f" {phrase} ", (len(phrase) + 1, int(owner)))
        if not len(automaton) or not len(passages):
            return pd.DataFrame({c: [] for c in ("h1", "h2", "first", "last")})
        automaton.make_automaton()
        out = []
        for h1, h2, place, start, text in zip(*(passages[c] for c in ("h1", "h2", "place", "start", "text")), strict=True):
            text = f" {text} "
            begin: list[int] = []
            for end, (length, owner) in automaton.iter(text):
                if owner < place:
                    begin.append(end - length)  # the blank before the phrase
            if not begin:
                continue
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
            at = np.unique(np.searchsorted(blanks, begin))
            cut = np.flatnonzero(np.diff(at) > n)
            first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + n
            out += [(h1, h2, int(start + x), int(start + y)) for x, y in zip(first, last, strict=True)]
        return pd.DataFrame(out, columns=["h1", "h2", "first", "last"])

    return of


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, k: int = K, part_bytes: int = PART_BYTES) -> DataFrame:
    """h1, h2 (the identity of id and text) and spans (first word, word after the last) of each document that repeats a phrase."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    key = identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    place = F.coalesce(F.col(f"`{id_col}`").try_cast("long"), F.lit(LAST)).alias("place")
    own = docs.select(place, key.alias("key"), text).select("place", "key.*", "text")

    places = own.select("place", "text").mapInArrow(lambda b: _anchor_rows(b, n, k), "anchor long, place long").groupBy("anchor")
    known = written(places.agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("anchor"), "anchors")
    schema = "place long, h1 long, h2 long, found array<struct<start:int,text:string,part:long>>"
    if known.count() <= BROADCAST_ANCHORS:
        sieve = shared(spark, np.sort(known.toArrow().column(0).to_numpy().view(np.uint64)))

        def make():
            state = _numbering(part_bytes)
            return lambda texts: [pa.array([x for _, _, data, offsets in pieces(texts) for x in _numbered(_passages(data, offsets, n, k, sieve.value), state)], _PASSAGES)]

        found = map_texts(own, "text", ["place", "h1", "h2"], make, schema[schema.index("found") :]).select("row.*", "found")
    else:
        by_key = own.mapInArrow(lambda b: _anchor_rows(b, n, k), "anchor long, place long, h1 long, h2 long").join(known, "anchor")
        by_key = by_key.groupBy("h1", "h2").agg(F.collect_set("anchor").alias("anchors"))  # as many as a text has

        def cut_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = _numbering(part_bytes)
            for batch in batches:
                # an anchor that recurs does so in every text that has it, so one array serves the batch
                sieve = np.unique(batch.column(4).flatten().to_numpy().view(np.uint64))
                made = [x for _, _, data, offsets in pieces(batch.column(3)) for x in _numbered(_passages(data, offsets, n, k, sieve), state)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(made, _PASSAGES)], names=["place", "h1", "h2", "found"])

        found = own.join(by_key, ["h1", "h2"]).select("place", "h1", "h2", "text", "anchors").mapInArrow(cut_own, schema)
    passages = written(found.select("place", "h1", "h2", F.explode("found").alias("p")).select("place", "h1", "h2", "p.*", F.monotonically_increasing_id().alias("passage")), "passages")

    windows = passages.select("passage", "place", "part", "text").mapInArrow(lambda b: _window_rows(b, n), _WINDOW)
    owned = windows.repartition("window").sortWithinPartitions("window", "place", "passage", "pos").mapInArrow(_owned, _OWNED)
    cover = _covering(n)
    cover_of = owned.groupBy("its_part").cogroup(passages.select("part", "passage", "place", "text").groupBy("part"))
    covered = written(cover_of.applyInArrow(lambda x, y: cover(x, y), "passage long, owner long, owner_pos int, owner_place long"), "cover")

    wanted = covered.select("owner", "owner_pos").distinct().groupBy("owner").agg(F.collect_list("owner_pos").alias("positions"))
    texts = passages.join(wanted, F.col("passage") == F.col("owner")).select("passage", "text", "positions")
    texts = texts.mapInArrow(_phrase_texts(n), "owner long, owner_pos int, phrase string")
    shards = max(1, -(-covered.count() // SHARD))
    shard = F.pmod(F.xxhash64("passage"), F.lit(shards)).alias("shard")
    sent = covered.select(shard, "owner", "owner_pos", "owner_place").distinct().join(texts, ["owner", "owner_pos"]).select("shard", "phrase", "owner_place")
    streamed = passages.join(covered.select("passage").distinct(), "passage", "left_semi").select(shard.alias("its_shard"), "h1", "h2", "place", "start", "text")
    spans = sent.groupBy("shard").cogroup(streamed.groupBy("its_shard")).applyInPandas(lambda p, s: _located(n)(p, s), "h1 long, h2 long, first long, last long")
    return written(spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")), "spans")


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("part", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, spans: row, n_words, n_removed, kept."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()  # at 20 and 09 to 0D, as for all bytes
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    gone[s["first"]] += 1
                    gone[s["last"]] -= 1
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                n_removed.append(len(words) - len(stay))
                words = [words[i] for i in stay.tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["row", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ("doc_id",), n: int = N, k: int = K, part_bytes: int = PART_BYTES) -> DataFrame:
    """row (the carried columns), n_words, n_removed, kept (the words that stay, joined by a blank, UTF-8)."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, n=n, k=k, part_bytes=part_bytes)
    key = identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), key)
    own = own.select("row", "text", "key.*").join(few(spans), ["h1", "h2"], "left").select("row", "text", "spans")
    schema = own.select("row").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit(b"")}).schema
    return own.mapInArrow(_cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
o AS (SELECT g, min(doc_id) AS owner FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM s JOIN o USING (g) WHERE s.doc_id > owner),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
