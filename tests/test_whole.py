"""The queries of graphs over all of part against plain Python."""

import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def part(spark):
    found = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()}
    assert max(found) > 1400
    return found


def cycle_names(nxt, sizes):
    """canon of each name: where its walk ends, or the largest of the cycle that it runs into."""
    out = {}
    for x in nxt:
        if nxt[x] == x:
            continue
        seen, at = [], x
        while at in nxt and nxt[at] != at and at not in seen:
            seen.append(at)
            at = nxt[at]
        out[f"t{x}"] = f"t{min(seen[seen.index(at):], key=lambda v: (-sizes.get(v, -1), f't{v}'))}" if at in seen else f"t{at}"
    return out


@pytest.mark.parametrize("name", ["alias_functional_graph", "alias_canonical_cycle"])
def test_aliases_of_all_parts(spark, part, name):
    if name == "alias_functional_graph":
        nxt = {x: (x * x + 1) % 97 for x in part}
    else:
        nxt = {x: x // 7 * 7 + (x + 1) % 7 for x in part if all(x // 7 * 7 + i in part for i in range(7))}
    found = catalog.QUERIES[name](spark, SF).collect()
    assert len(found) > 1400 and {r["tag"]: r["canon"] for r in found} == cycle_names(nxt, part) and len(found) == len({r["tag"] for r in found})


def test_components_of_all_parts(spark, part):
    edges = {(x, x // 2) for x in part if x} | {(x // 2, x) for x in part if x and x % 10 == 0}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    reach = {v: reached(v) for e in edges for v in e}
    comp = {v: max(u for u in reach[v] if v in reach[u]) for v in reach}
    found = catalog.QUERIES["scc"](spark, SF).collect()
    assert len(found) == len(part) and {r["node"]: r["comp"] for r in found} == comp
    dag = catalog.QUERIES["implication_dag"](spark, SF).collect()
    assert sorted((r["a_id"], r["b_id"]) for r in dag) == sorted((a, b) for a, b in edges if comp[a] != comp[b])
