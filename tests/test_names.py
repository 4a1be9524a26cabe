"""Aliases, strong components, implications, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aliases, graph

PAIR = "antecedent_name string, consequent_name string, status string, line long"


def named(spark, pairs):
    return spark.createDataFrame([(a, b, s, i) for i, (a, b, s) in enumerate(pairs)], PAIR)


def tags(spark, counts):
    return spark.createDataFrame([(i, n, 0, c) for i, (n, c) in enumerate(sorted(counts.items()))], "tag_id long, tag string, category int, post_count long")


@pytest.mark.parametrize(
    ("pairs", "counts", "expected"),
    [
        ([("a", "b"), ("b", "c")], {}, {"a": "c", "b": "c"}),
        ([("a", "a")], {}, {}),
        ([("x", "y"), ("y", "x")], {"x": 5, "y": 9}, {"x": "y", "y": "y"}),
        ([("x", "y"), ("y", "x")], {"x": 5, "y": 5}, {"x": "x", "y": "x"}),
        ([("t", "p"), ("p", "q"), ("q", "p")], {"p": 1, "q": 2}, {"t": "q", "p": "q", "q": "q"}),
        ([("d", "e"), ("d", "f")], {}, {"d": "f"}),
        ([("u", "v"), ("v", "u")], {}, {"u": "u", "v": "u"}),
    ],
)
def test_alias_map(spark, pairs, counts, expected):
    rows = [(a, b, "active") for a, b in pairs] + [("g", "h", "deleted"), ("", "h", "active"), (None, "h", "active")]
    found = aliases.alias_map(tags(spark, counts), named(spark, rows)).collect()
    assert {r["tag"]: r["canon"] for r in found} == expected


def test_alias_map_matches_a_walk(spark):
    r = random.Random(7)
    names = [f"n{i}" for i in range(60)]
    nxt = {a: r.choice(names) for a in names if r.random() < 0.8}
    counts = {n: r.randrange(5) for n in names if r.random() < 0.7}
    expected = {}
    for a in nxt:
        if nxt[a] == a:
            continue
        seen, x = [], a
        while x in nxt and nxt[x] != x and x not in seen:
            seen.append(x)
            x = nxt[x]
        cycle = seen[seen.index(x) :] if x in seen else [x]
        expected[a] = min(cycle, key=lambda n: (-counts.get(n, -1), n)) if len(cycle) > 1 else x
    found = aliases.alias_map(tags(spark, counts), named(spark, [(a, b, "active") for a, b in nxt.items()])).collect()
    assert {row["tag"]: row["canon"] for row in found} == expected


def test_scc_matches_reachability(spark):
    r = random.Random(3)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(40)]
    nodes = {x for e in edges for x in e}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in edges:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    expected = {v: max(u for u in nodes if u in reach[v] and v in reach[u]) for v in nodes}
    found = graph.scc(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {row["node"]: row["comp"] for row in found} == expected


def test_implications(spark):
    known = tags(spark, {n: 1 for n in "abcdefgxy"})
    ids = {r["tag"]: r["tag_id"] for r in known.collect()}
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "d"), ("d", "e"), ("d", "e"), ("f", "nobody"), ("g", "y"), ("e", None)]
    mapping = spark.createDataFrame([("g", "y")], "tag string, canon string")
    dag = graph.implication_dag(named(spark, [(a, b, "active") for a, b in rows] + [("a", "f", "pending")]), known, mapping)
    assert {(r["a_id"], r["b_id"]) for r in dag.collect()} == {(ids[a], ids[b]) for a, b in [("x", "a"), ("c", "d"), ("d", "e")]}


def test_ancestors_are_nearest_and_bounded(spark):
    dag = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 3)], "a_id long, b_id long")
    counts = spark.createDataFrame([(1, "a", 9), (2, "b", 1)], "tag_id long, tag string, post_count long")
    found = {(r["tag_id"], r["ancestor_id"], r["depth"]) for r in graph.ancestor_cache(dag, counts, 3, 0.2).collect()}
    assert found == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3)}
    assert {r["tag_id"] for r in graph.ancestor_cache(dag, counts, 0, 7.0).collect()} == {1, 2, 3, 4}


def test_resolve(spark):
    known = tags(spark, {"Car": 1, "carpet": 2, "auto": 3})
    alias = named(spark, [("Wagon", "kombi", "active"), ("kombi", "car", "active"), ("l1", "l2", "active"), ("l2", "l1", "active")])
    of = lambda n: aliases.resolve_tag(known, alias, n)
    assert of("12") == ([12], [])
    assert of("cAR")[0] == of("wagon")[0] == [r["tag_id"] for r in known.where(F.col("tag") == "Car").collect()]
    assert of("arp") == ([], ["carpet"])
    assert of("l1") == ([], [])
