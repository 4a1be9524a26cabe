import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, store
from tidemark.llm.words import mix

SCHEMA = "doc_id long, text string, n_shingles string, row string"


def brute(rows, k=3, num=90, den=100):
    sets = []
    for doc_id, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def joined(spark, rows, partitions=3):
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).repartition(partitions)
    out = jaccard.Join(df).result().select("id", "n_shingles", "component_id").collect()
    return sorted((str(r[0]), r[1], str(r[2])) for r in out)


def corpus(seed):
    """A crowd of near copies, groups of copies, a passage that many share, and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(130)], [word() for _ in range(60)]
    texts = []
    for _ in range(90):
        w = base[:]
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 9])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(passage + [word() for _ in range(r.randrange(0, 40))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(40)]
    texts += r.choices(texts, k=60)
    texts += [t.upper().replace(" ", "\n") for t in r.choices(texts, k=5)]
    texts += [" ".join(base[:n]) for n in range(1, 14)] + ["", None, "  \t", "one", "One", "one two", "é É", "É é"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[5]), (None, "nobody has this text"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert joined(spark, rows) == brute(rows)


def test_empty(spark):
    assert joined(spark, [], 1) == []


def test_pairs_across_batches_and_groups():
    rule = jaccard.Rule(90, 100)
    assert rule.prefix(100) == 11 and rule.need(100, 100) == 95
    assert rule.alone(8) and not rule.alone(9) and not rule.alone(10)


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).repartition(3)
    kept = jaccard.Join(df).kept()
    assert kept.columns == df.columns
    empty = sum(1 for _, n, _ in brute(rows) if not n)
    with_words = {c for _, n, c in brute(rows) if n}
    assert kept.count() == len(with_words) + empty
    assert {str(r["doc_id"]) for r in kept.collect()} >= with_words - {"None"}


def test_other_shingles_and_thresholds(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).repartition(2)
    out = jaccard.Join(df, words=5, num=80, den=100).result().select("id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out) == brute(rows, 5, 80, 100)


def test_every_link_of_a_crowd(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(40)] = f"x{i}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 3]) for i in range(38)} for w in map(str.split, texts)]
    expected = {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    join = jaccard.Join(docs, num=60, den=100, every_link=True)
    of = {bytes(x["sig"]): x["id"] for x in join.rows.collect()}
    found = [tuple(sorted((of[bytes(x["a"])], of[bytes(x["b"])]))) for x in join.links.collect()]
    assert len(of) == 60 and len(found) == len(set(found)) and set(found) == expected
    few = jaccard.Join(docs, num=60, den=100)
    assert few.links.count() < len(expected)  # it leaves links within a group out
    assert join.groups.select("node").distinct().count() == few.groups.select("node").distinct().count()


@pytest.mark.parametrize("crowd", [4, 30])
def test_parted_crowds_lose_nothing(spark, crowd):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.Join(df, crowd=crowd).result().select("id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out) == brute(rows)


@pytest.mark.parametrize("shape", ["star", "clique", "large sets"])
def test_jobs_are_bounded(spark, shape):
    n = {"star": 20_000, "clique": 20_000, "large sets": 3000}[shape]
    size = 30_000 if shape == "large sets" else 300
    name = lambda c: F.concat(F.lit("n"), c.cast("string")).cast("binary")
    i = F.col("id")
    a, b = (F.lit(0), i + 1) if shape != "clique" else (i % 200, 200 + F.floor(i / 200))
    pairs = spark.range(n).select(name(a).alias("a"), name(b).alias("b"), F.lit(2 * size).alias("n"))
    jobs = jaccard._jobs(pairs)
    assert jobs.count() == n and jobs.select("a", "b").distinct().count() == n
    weights = [r["w"] for r in jobs.groupBy("job").agg(F.sum(F.col("n") + jaccard.OWN).alias("w")).collect()]
    assert max(weights) <= jaccard.JOB and len(weights) <= 6 * sum(weights) / jaccard.JOB + 1


def test_rows_that_differ_beside_id_and_text_are_kept_the_same_way(spark):
    rows = [(1, "a b c d e f", x) for x in "pqrstu"] + [(2, "a b c d e f", "v")]
    kept = {jaccard.Join(spark.createDataFrame(r, "doc_id long, text string, other string").repartition(p)).kept().first()["other"] for r, p in ((rows, 1), (rows[::-1], 3))}
    assert len(kept) == 1 and kept < set("pqrstu")


def test_long_texts(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    near = [x if i % 600 else "changed" for i, x in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100_000]))]
    assert [c for _, _, c in joined(spark, rows)] == ["1", "1", "3"]


def test_parities_never_part_what_is_similar():
    r = np.random.default_rng(4)
    rule = jaccard.Rule(90, 100)
    similar = told_apart = unlike = 0
    for _ in range(1500):
        n = int(r.choice([1, 2, 9, 20, 31, 33, 100, 127, 129, 260, 511, 514, 1030]))
        x = np.unique(mix(r.integers(0, 1 << 62, n).astype(np.uint64)))
        own = int(r.integers(0, 1 + n // 4))
        y = np.unique(np.concatenate([x[: n - own], mix(r.integers(0, 1 << 62, int(r.integers(0, 2 + own))).astype(np.uint64))]))
        if not len(y):
            continue
        far = jaccard.differing(jaccard.parity(x), jaccard.parity(y))
        assert far == jaccard.differing(jaccard.parity(y), jaccard.parity(x)) and far <= len(np.setxor1d(x, y))
        if rule.holds(x, y):
            similar += 1
            assert far <= rule.apart(len(x) + len(y))
        elif n > 100:
            unlike += 1
            told_apart += far > rule.apart(len(x) + len(y))
    assert similar > 300 and unlike > 300 and told_apart > 0.8 * unlike


@pytest.mark.parametrize("limit", [None, 0])
def test_whole_sets_move_for_few_pairs_but_links(spark, monkeypatch, limit):
    """Texts of similarity 0.8 share prefixes in every order, yet are no links.  With no table broadcast the result is the same."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        w = [word() for _ in range(300)]
        for at in (), (7,), (11, 60, 90, 120, 150, 180, 210, 240, 260, 280), (14, 30, 40, 75, 100, 130, 160, 190, 220, 250, 270, 290):
            rows.append((len(rows), " ".join(word() if j in at else x for j, x in enumerate(w))))
    if limit is not None:
        monkeypatch.setattr(store, "BROADCAST_BYTES", limit)
    kept, keep = [], jaccard.written

    def written(df, label):
        out = keep(df, label)
        if label == "kept":
            kept.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    assert joined(spark, rows) == brute(rows)
    assert kept[1] >= 60 and kept[0] <= 1.1 * kept[1]


def test_sharing_looks_up_signatures_that_end_in_zero_bytes():
    rule = jaccard.Rule(90, 100)
    s = np.unique(mix(np.arange(100, dtype=np.uint64)))
    rows = [(name, *(jaccard._MADE[c](s, rule).tobytes() for c in ("parity", "second", "third"))) for name in (b"a" * 15 + b"\0", b"\0" * 16)]
    sets = pd.DataFrame(rows, columns=["sig", "parity", "second", "third"])
    pairs = pd.DataFrame([(rows[0][0], rows[1][0], 200)], columns=["a", "b", "n"])
    assert len(jaccard._sharing(rule, ["second", "third"])(pairs, sets)) == 1
