"""The registered corpus queries against their SQL, and the others' shapes, on the smallest tables."""

import duckdb
import pytest

from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.sql(registry.ORACLE[name])
    found = registry.QUERIES[name](spark, sf).select(*expected.columns)
    assert rows(map(tuple, found.collect())) == rows(expected.fetchall())


def test_neighbours_against_brute_force(spark):
    """Recall on all of sf0.1, where there are several lists."""
    import numpy as np

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow()
    ids = table.column("vec_id").to_numpy()
    x = np.array(table.column("embedding").to_pylist(), float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in registry.QUERIES["op7_nearest"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(ids[np.argsort(-s, kind="stable")[:5]].tolist()) & set(got[int(ids[q])]))
    assert hits >= 0.95 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = registry.QUERIES["op6_language_id"](spark, sf).where("held_out and lang_pred <> 'und'").join(docs.where("lang is not null"), "doc_id").collect()
    assert len(found) > 150 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


COLUMNS = {
    "op1_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}


def rows(cursor):
    cell = lambda v: round(v, 3) if isinstance(v, float) else v
    return sorted(repr(tuple(map(cell, r))) for r in cursor)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    found = registry.QUERIES[name](spark, sf)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name]
    table, key = {"op10_url_filter": ("pages", "page_id"), "op7_nearest": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert found.count() == (5 * len(range(0, n, 50)) if name == "op7_nearest" else n)
