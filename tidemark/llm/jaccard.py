"""Similarity join on word shingles by prefix filters under several global token orders, and its connected groups.

1. Each text becomes the set of its shingles' hashes.  Equal sets form a class (a 128-bit signature, aggregated map-side),
   so copies are never paired; from here on a class is one set.
2. Global orders: the first puts shingles that many texts share last, the rest by hash.  Which these are is counted over
   all texts, in blocks of a few thousand, whose frequent shingles are added up; any order gives the same links.
3. Two sets can only be similar enough if their first few shingles in an order (the prefix) have one in common.  Prefix
   shingles are shuffled once and streamed in order: up to SMALL sets that share one are paired if size and position
   allow it.  Where more share one, each is paired with the first CENTRES, the sets of fewest rare shingles, which are the same
   for most shingles of a crowd, so the pairs of a crowd are few.
4. Candidates must also have common prefix shingles in the other orders, and parities (a bit or two for each shingle, see
   `parity`) that differ in no more bits than similar sets may differ in shingles.  Only those that do are verified, on whole
   sets, which are many times larger; pairs are dealt out by their neighbourhood, so sets move about once.  A job's sets are
   bounded in bytes: a neighbourhood of more is cut into a grid by both ends of its pairs, and a cell of the grid that is
   still too large by pairs.
5. Where many sets share a prefix shingle, the pairs that are not yet in one connected group are taken as well, in a grid
   of blocks of CROWD sets, and pass 4 again: no link between different groups is lost, and links within a group need not be
   listed.  With `every_link` all
   pairs of such sets that size and position allow are taken, and every link is listed.

Defined results: texts without words, and null texts, have an empty set, link to nothing and are their own component; a row
without an id belongs to its class, and its component's id is the least there is (null if there is none); repeated rows are
copies; of rows that have id and text in common the one of least hash of all columns is kept; other columns are carried as
they are; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.graph import components
from tidemark.llm.store import bounded_batches, few, identity, shared, written
from tidemark.llm.words import BLANKS, LOWER, Words, grams, mix, odd, pieces, split

SMALL = 16
CENTRES = 3
#: shingles counted together, and how often one must be among them to be passed on
BLOCK, OFTEN = 1 << 22, 4
#: frequent shingles that the order knows (8 bytes each, broadcast); others are ordered by hash alone
FREQUENT = 1 << 18
#: sets of one shingle that are compared across groups in one block
CROWD = 2048
#: shingles of all pairs' sets in a job (8 bytes each), each pair counted as OWN more
JOB, OWN = 1 << 21, 256
_SEEDS = odd(3, 41)  # of the orders
_PAIR = "a binary, b binary, n int"  # n: the sum of both sizes


def sets_of(words: Words, k: int) -> Iterator[np.ndarray]:
    """By text: the sorted distinct hashes of its k-word shingles, or of all its words if they are fewer."""
    for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        h = words.hash[i:j]
        yield np.unique(grams(h, min(k, len(h)))) if len(h) else h


def signature(s: np.ndarray) -> bytes | None:
    if not len(s):
        return None
    return np.array([mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(), mix(s + np.uint64(0xD1B54A32D192ED03)).sum()], np.uint64).tobytes()


class Rule:
    """Jaccard similarity of num/den or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def need(self, n, m):
        """Least number of common shingles of sets of n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def apart(self, both: int) -> int:
        """Most shingles that only one of two similar sets has, whose sizes sum to `both`."""
        return both - 2 * self.need(both, 0)

    def alone(self, n: int) -> bool:
        """Whether a set of n is similar enough to equal sets only."""
        return (n * self.den < self.num * (n + 1)) and ((n - 1) * self.den < self.num * n)

    def holds(self, x: np.ndarray, y: np.ndarray) -> bool:
        common = len(x) + len(y) - len(np.union1d(x, y))
        return self.den * common >= self.num * (len(x) + len(y) - common)


def ordered(s: np.ndarray, order: int, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in one of the global orders, and how many of it are not frequent.  The first order knows what is frequent."""
    key = mix(s * _SEEDS[order]) >> np.uint64(1)
    rare = len(s)
    if not order and len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        key |= known.astype(np.uint64) << np.uint64(63)
        rare -= int(known.sum())
    return s[np.argsort(key, kind="stable")], rare


def parity(s: np.ndarray) -> np.ndarray:
    """Bits, a power of two of them and at least two for each shingle, in bytes: each tells whether an odd number of shingles
    fall on it.  A shingle that only one of two sets has changes one bit, so their parities differ in as many bits at most."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parities differ, the longer one folded to the other's length."""
    if len(x) != len(y):
        x, y = (np.bitwise_xor.reduce(p.reshape(-1, min(len(x), len(y))), axis=0) for p in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


#: what is made of a set for a job; prefixes are cut to half of each hash, which lets a pair more pass and never a pair less
_MADE = {
    "whole": lambda s, rule: s,
    "parity": lambda s, rule: parity(s),
    "second": lambda s, rule: ordered(s, 1, s[:0])[0][: rule.prefix(len(s))].astype(np.uint32),
    "third": lambda s, rule: ordered(s, 2, s[:0])[0][: rule.prefix(len(s))].astype(np.uint32),
}


def _texts(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in pieces(column):
        yield from sets_of(split(data, offsets, BLANKS, LOWER), k)


def _signed(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """row, n, sig of each text; in between, rows of frequent shingles."""
    block: list[np.ndarray] = []
    held = 0

    def frequent() -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(block), return_counts=True)
        h, n = h[n >= OFTEN], n[n >= OFTEN]
        if len(h):
            nulls = [pa.nulls(len(h), t) for t in schema.types[:3]]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    for batch in batches:
        ns, sigs = [], []
        for s in _texts(batch.column(1), k):
            ns.append(len(s))
            sigs.append(signature(s))
            block.append(s)
            held += len(s)
            if held >= BLOCK:
                yield from frequent()
                block, held = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(len(ns), pa.int64()), pa.nulls(len(ns), pa.int64())], schema=schema)
    if block:
        yield from frequent()


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, rule: Rule, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """token, sig, n, place, rare of the first order's prefixes; equal texts of a task give theirs once."""
    names = ["token", "sig", "n", "place", "rare"]
    seen: set[bytes] = set()
    for batch in batches:
        tokens, sigs, ns, places, rares, held = [], [], [], [], [], 0
        for s in _texts(batch.column(0), k):
            sig = signature(s)
            if sig is None or rule.alone(len(s)) or sig in seen:
                continue
            if len(seen) < 1 << 17:
                seen.add(sig)
            in_order, rare = ordered(s, 0, frequent)
            p = rule.prefix(len(s))
            tokens.append(in_order[:p])
            sigs.append(sig)
            ns.append(len(s))
            rares.append(rare)
            places.append(p)
            held += p
            if held > 1 << 17:
                yield _dealt(names, tokens, sigs, ns, places, rares)
                tokens, sigs, ns, places, rares, held = [], [], [], [], [], 0
        if tokens:
            yield _dealt(names, tokens, sigs, ns, places, rares)


def _dealt(names: list[str], tokens: list, sigs: list, ns: list, counts: list, rares: list) -> pa.RecordBatch:
    of = np.repeat(np.arange(len(counts)), counts)
    places = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
    columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(sigs, pa.binary()).take(pa.array(of)), pa.array(np.array(ns, np.int32)[of]), pa.array(places), pa.array(np.array(rares, np.int32)[of])]
    return pa.RecordBatch.from_arrays(columns, names=names)


_STREAMED = "token long, a binary, b binary, n int, place int"


def _streamed(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """From prefix rows in the order of token, rare, n, sig: pairs (a, b, and in n the sum of their sizes), and the rows of
    tokens that more than SMALL sets have (a, with b null)."""
    names = [x.split()[0] for x in _STREAMED.split(", ")]
    head: dict[str, np.ndarray] = {}  # the first SMALL rows of the last token so far
    count, last = 0, None  # its rows so far, and the last one's set
    for batch in batches:
        token = batch.column(0).to_numpy()
        sig = np.array(batch.column(1).to_pylist(), object)
        n, place = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        if not len(token):
            continue
        carried = 0
        before = 0
        if count and token[0] == head["token"][0]:
            carried, before = len(head["token"]), count
            token, sig, n, place = (np.concatenate([head[x], y]) for x, y in (("token", token), ("sig", sig), ("n", n), ("place", place)))
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        if carried:
            keep[:carried] = True
            keep[carried] = last != sig[carried]
        at = np.flatnonzero(keep)
        token, sig, n, place = token[at], sig[at], n[at], place[at]
        new = at >= carried
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        index = np.arange(len(token)) - np.repeat(start, np.diff(np.append(start, len(token))))
        if before > carried:  # the token's rows beyond its head went by earlier
            first_run = int(start[1]) if len(start) > 1 else len(token)
            index[carried:first_run] += before - carried
        row = np.arange(len(token))
        left, right = [], []

        def pair(x: np.ndarray, y: np.ndarray) -> None:
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (rule.den * small >= rule.num * large) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= rule.need(n[x], n[y]))
            left.append(x[ok])
            right.append(y[ok])

        for d in range(1, SMALL):
            y = row[new & (index >= d) & (index < SMALL)]
            if not len(y):
                break
            pair(y - d, y)
        begin = np.repeat(start, np.diff(np.append(start, len(token))))
        far = row[new & (index >= SMALL)]
        for c in range(CENTRES):
            pair(begin[far] + c, far)
        x, y = np.concatenate(left), np.concatenate(right)
        # rows of tokens that have more than SMALL: those beyond, and their first ones when the first beyond comes
        opened = far[index[far] == SMALL]
        hot = np.concatenate([far, *(begin[opened] + c for c in range(SMALL))]).astype(np.int64)
        if len(x) + len(hot):
            a = np.where([p < q for p, q in zip(sig[x], sig[y], strict=True)], sig[x], sig[y]) if len(x) else sig[:0]
            b = np.where([p < q for p, q in zip(sig[x], sig[y], strict=True)], sig[y], sig[x]) if len(x) else sig[:0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([token[x], token[hot]])),
                    pa.array([*a, *sig[hot]], pa.binary()),
                    pa.concat_arrays([pa.array(list(b), pa.binary()), pa.nulls(len(hot), pa.binary())]),
                    pa.array(np.concatenate([n[x] + n[y], n[hot]]).astype(np.int32)),
                    pa.array(np.concatenate([place[x], place[hot]]).astype(np.int32)),
                ],
                names=names,
            )
        s = start[-1]
        count, last = int(index[-1]) + 1, sig[-1]
        head = {k: v[s : s + SMALL] for k, v in (("token", token), ("sig", sig), ("n", n), ("place", place))}


def _across(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n) of different groups among the rows (job, sig, n, place, root, side) of each job, in the order of job and n.

    Rows of side 2 are compared with all others, rows of sides 0 and 1 with the other side.  Only sets whose size allows it
    are compared, so the rows held are those of a job within a factor of the similarity."""
    token = n = place = side = np.zeros(0, np.int64)
    sig = root = np.zeros(0, object)
    for batch in batches:
        new = batch.num_rows
        if not new:
            continue
        token = np.concatenate([token, batch.column(0).to_numpy()])
        sig = np.concatenate([sig, np.array(batch.column(1).to_pylist(), object)])
        n = np.concatenate([n, batch.column(2).to_numpy().astype(np.int64)])
        place = np.concatenate([place, batch.column(3).to_numpy().astype(np.int64)])
        root = np.concatenate([root, np.array(batch.column(4).to_pylist(), object)])
        side = np.concatenate([side, batch.column(5).to_numpy().astype(np.int64)])
        out: list[tuple[bytes, bytes, int]] = []
        for y in range(len(token) - new, len(token)):
            lo = int(np.searchsorted(token[:y], token[y]))
            lo += int(np.searchsorted(n[lo:y], -(-rule.num * n[y] // rule.den)))
            x = slice(lo, y)
            ok = (root[x] != root[y]) & ((side[x] != side[y]) | (side[y] == 2)) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= rule.need(n[x], n[y]))
            out += [(min(s, sig[y]), max(s, sig[y]), int(m + n[y])) for s, m in zip(sig[x][ok], n[x][ok], strict=True) if s != sig[y]]
            if len(out) > 1 << 16 or y == len(token) - 1:
                out = list(set(out))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], names=["a", "b", "n"])
                out = []
        lo = int(np.searchsorted(token, token[-1]))
        lo += int(np.searchsorted(n[lo:], -(-rule.num * n[-1] // rule.den)))
        token, n, place, sig, root, side = token[lo:], n[lo:], place[lo:], sig[lo:], root[lo:], side[lo:]


def _sharing(rule: Rule, columns: Sequence[str]):
    """Of a group's pairs, those whose parities allow it and whose prefixes have something in common in every order."""

    def of(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        bits = {s: np.frombuffer(v, np.uint8) for s, v in zip(sets["sig"], sets["parity"], strict=True)}
        near = [differing(bits[a], bits[b]) <= rule.apart(n) for a, b, n in zip(pairs["a"], pairs["b"], pairs["n"], strict=True)]
        pairs = pairs.loc[near, ["a", "b", "n"]]
        left = {*pairs["a"], *pairs["b"]}  # isin would drop zero bytes at a signature's end
        has = {s: [set(np.frombuffer(v, np.uint32).tolist()) for v in vs] for s, *vs in zip(sets["sig"], *(sets[c] for c in columns), strict=True) if s in left}
        keep = [all(not x.isdisjoint(y) for x, y in zip(has[a], has[b], strict=True)) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
        return pairs.loc[keep]

    return of


def _similar(rule: Rule):
    """Of a group's pairs, those that are similar enough."""

    def of(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        has = {s: np.frombuffer(v, np.uint64) for s, v in zip(sets["sig"], sets["whole"], strict=True)}
        keep = [rule.holds(has[a], has[b]) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
        return pairs.loc[keep, ["a", "b", "n"]]

    return of


def _neighbourhood(pairs: DataFrame) -> DataFrame:
    """node, root: the least set next to the least set next to each (or itself).  Sets that belong together mostly agree on
    it; where they don't, a set is sent to more than one job."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "near")
    far = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return near.join(far, "root").select("node", F.col("far").alias("root"))


def _jobs(pairs: DataFrame) -> DataFrame:
    """a, b, n, job: pairs dealt to jobs of bounded weight, whatever set or neighbourhood most of them share."""
    root = written(_neighbourhood(pairs), "roots")
    of_a, of_b = (root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    weight = (F.col("n") + OWN).cast("long")
    grouped = written(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n", F.xxhash64(F.least("root_a", "root_b")).alias("root")), "grouped")
    # the tables of what is too large have a row for JOB of all weight at most
    large = grouped.groupBy("root").agg(F.sum(weight).alias("w")).where(F.col("w") > JOB)
    large = few(written(large.select("root", F.ceil(F.sqrt(2 * F.col("w") / JOB)).cast("long").alias("side")), "large"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("side"))
    cell = F.when(F.col("side").isNull(), F.col("root")).otherwise(F.xxhash64("root", part("a"), part("b")))
    cells = written(grouped.join(large, "root", "left").select("a", "b", "n", cell.alias("cell")), "cells")
    full = cells.groupBy("cell").agg(F.sum(weight).alias("w")).where(F.col("w") > JOB)
    full = few(written(full.select("cell", F.ceil(2 * F.col("w") / JOB).cast("long").alias("parts")), "full"))
    job = F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("a", "b"), "parts")))
    return written(cells.join(full, "cell", "left").select("a", "b", "n", job.alias("job")), "jobs")


def _judged(pairs: DataFrame, bring, columns: Sequence[str], judge) -> DataFrame:
    """Pairs that judge keeps, job by job; bring(wanted, columns) makes the columns of the sets that jobs want from the texts,
    and they move once, to their jobs."""
    dealt = _jobs(pairs)
    wanted = dealt.select("job", F.col("a").alias("sig")).unionByName(dealt.select("job", F.col("b").alias("sig"))).distinct()
    brought = bring(few(written(wanted, "wanted")), columns)
    return written(dealt.withColumnRenamed("job", "its_job").groupBy("its_job").cogroup(brought.groupBy("job")).applyInPandas(lambda p, s: judge(p, s), _PAIR), "kept")


class Join:
    """The join's tables: `rows` (row, key, n, sig), `links` (a, b) between classes, `groups` (node, root).

    links are enough for the groups, and all there are with `every_link`."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ("doc_id",), words: int = 3, num: int = 90, den: int = 100, every_link: bool = False, crowd: int = CROWD) -> None:
        spark, rule = docs.sparkSession, Rule(num, den)
        bounded_batches(spark)
        text = F.col(f"`{text_col}`").cast("string").alias("text")
        key = identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
        own = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")).alias("r"), text)
        schema = own.select("r").withColumns({"n": F.lit(0).cast("long"), "sig": F.lit(None).cast("binary"), "token": F.lit(0).cast("long"), "often": F.lit(0).cast("long")}).schema
        for f in schema.fields:
            f.nullable = True

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = iter(batches)
            first = next(batches, None)
            if first is None:
                return
            arrow = pa.schema([("r", first.schema.field(0).type), ("n", pa.int64()), ("sig", pa.binary()), ("token", pa.int64()), ("often", pa.int64())])
            yield from _signed(chain([first], batches), words, arrow)

        table = written(own.mapInArrow(signed, schema), "signatures")
        self.rows = table.where("r is not null").select("r.row", "r.id", "r.key", "n", "sig")
        self._one = written(self.rows.where("sig is not null").groupBy("sig").agg(F.min("key").alias("key")), "one-of-each")
        every = [F.col(f"`{c}`") for c in docs.columns]
        self._keyed = docs.select(F.struct(*every).alias("row"), key.alias("key"), identity(*every).alias("whole"))
        often = table.where("token is not null").groupBy("token").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "token").limit(FREQUENT)
        frequent = shared(spark, np.sort(often.select("token").toArrow().column(0).to_numpy().view(np.uint64)))

        prefixes = docs.select(text).mapInArrow(lambda rows: _prefixes(rows, words, rule, frequent.value), "token long, sig binary, n int, place int, rare int")
        dealt = prefixes.repartition("token").sortWithinPartitions("token", "rare", "n", "sig")
        streamed = written(dealt.mapInArrow(lambda rows: _streamed(rows, rule), _STREAMED), "candidates")
        pairs = written(streamed.where("b is not null").select("a", "b", "n").distinct(), "pairs")
        crowded = streamed.where("b is null").select("token", F.col("a").alias("sig"), "n", "place")

        def bring(wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
            return self._sets(docs.select(key.alias("key"), text), wanted, columns, words, rule)

        self._bring = bring
        links = self._verified(pairs, rule)
        groups = components(links)
        rooted = crowded.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("token", "sig", "n", "place", F.coalesce("root", "sig").alias("root"))
        if every_link:
            rooted = crowded.withColumn("root", F.col("sig"))
        rooted = written(rooted, "crowded")
        split_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        split_ = few(written(split_.select("token", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "split"))
        far = rooted.join(split_, "token").withColumn("i", F.pmod(F.xxhash64("sig"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        job = F.xxhash64("token", F.least("i", "j"), F.greatest("i", "j")).alias("job")
        far = far.select(job, "sig", "n", "place", "root", F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"))
        more = far.repartition("job").sortWithinPartitions("job", "n", "sig")
        more = more.mapInArrow(lambda rows: _across(rows, rule), _PAIR).distinct().join(pairs, ["a", "b"], "left_anti")
        more = written(more, "more-pairs")
        if not more.isEmpty():
            found = self._verified(more, rule)
            links = written(links.unionByName(found), "links")
            groups = components(links)
        self.links, self.groups = links, groups

    def _sets(self, texts: DataFrame, wanted: DataFrame, columns: Sequence[str], words: int, rule: Rule) -> DataFrame:
        """job, sig and columns (of `_MADE`) of the sets in wanted (job, sig), from the text of one row of each class.  Of equal
        rows a task makes the columns once."""
        jobs = self._one.join(wanted, "sig").groupBy("key").agg(F.collect_list("job").alias("jobs"))
        jobs = few(written(jobs, "wanted-keys"))

        def make():
            seen: set[bytes] = set()

            def of(batch: pa.Array) -> list[pa.Array]:
                out: list[list] = [[] for _ in range(1 + len(columns))]
                for s in _texts(batch, words):
                    sig = signature(s)
                    values = [None] * len(out) if sig in seen else [sig, *(_MADE[c](s, rule).tobytes() for c in columns)]
                    if len(seen) < 1 << 17:
                        seen.add(sig)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                return [pa.array(c, pa.binary()) for c in out]

            return of

        found = map_texts(texts.join(jobs, "key"), "text", ["jobs"], make, ", ".join(f"{c} binary" for c in ["sig", *columns]))
        return found.where("sig is not null").select(F.explode("row.jobs").alias("job"), "sig", *columns)

    def _verified(self, pairs: DataFrame, rule: Rule) -> DataFrame:
        sharing = _judged(pairs, self._bring, ["parity", "second", "third"], _sharing(rule, ["second", "third"]))
        return _judged(sharing, self._bring, ["whole"], _similar(rule))

    def classes(self) -> DataFrame:
        """sig, root (of the class's group) and component_id (the least id of the group)."""
        ids = self.rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"))
        rooted = ids.join(self.groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return rooted.join(least, "root").select("sig", "root", "component_id")

    def kept(self) -> DataFrame:
        """The rows of docs, with all their columns, less all but one of each group: the one of the least id stays.  All rows
        whose set is empty stay.  Texts aren't moved: rows go by the keys of those that leave."""
        slim = self.rows.select("id", "key", "sig").where("sig is not null").join(self.classes().select("sig", "root"), "sig")
        slim = written(slim.groupBy("root", "id", "key").agg(F.count("*").alias("n")), "grouped")
        best = slim.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")).select("root", "best.key")
        gone = few(written(slim.join(best, ["root", "key"], "left_anti").select("key").distinct(), "gone"))
        twice = few(written(slim.where("n > 1").join(best, ["root", "key"], "left_semi").select("key").distinct(), "twice"))
        left = self._keyed.join(gone, "key", "left_anti")
        one = left.join(twice, "key", "left_semi").groupBy("key").agg(F.min_by("row", "whole").alias("row"))
        return left.join(twice, "key", "left_anti").select("row").unionByName(one.select("row")).select("row.*")

    def result(self) -> DataFrame:
        """row (the carried columns), id, n_shingles, component_id of every row."""
        out = self.rows.join(self.classes().withColumnRenamed("sig", "its"), F.col("sig") == F.col("its"), "left")
        return out.select("row", "id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Join(spark.read.parquet(f"{sf_dir}/documents.parquet")).result()
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, links.y FROM r JOIN links ON links.x = r.u)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least AS BIGINT) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS least FROM r GROUP BY v) c ON c.v = d.doc_id
"""
