"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog, roundtrips  # noqa: F401 (registers its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["posts_normalize", "post_tags", "post_tags_from_text", "tag_stats", "pmi_pairs", "topk_static", "topk_adaptive", "topk_delta_encode", "pools_parse", "pool_entropy_idf", "pool_edges", "pool_tag_cooccurrence", "rating_set_disjoint", "ancestor_cache", "tag_knn", "post2vec_norms", "events_windowed"]
CHECKED += ["tags_csv", "aliases_csv", "implications_csv", "pools_csv_sharded", "posts_stored", "post_tags_sharded", "packs_read_back", "roaring_files", "arrays_read_back", "row_map_appended", "run_metadata", "manifest_changes", "schema_checks", "column_and_hash_checks", "vector_checks"]


def test_registered():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and all(isinstance(x, str) for x in oracle.values()) and all(map(callable, queries.values()))
    assert set(catalog.QUERIES) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).columns == ["tag_id", "post_id", "rank"]


def rows(columns, found):
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.sql(catalog.ORACLE[name])
    found = catalog.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(expected.columns, expected.fetchall())
