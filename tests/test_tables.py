"""Readers, writers, collections, posting lists and the command line on a small hand-made dump."""

import csv
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import codec, roaring
from tidemark.operators import checks, pools, relation, stats, vectors
from tidemark.settings import Settings
from tidemark.sources import sinks, tables
from tidemark.streaming import incremental
from tidemark.validate import CHECKS, validate

POSTS = [
    # id, created_at, rating, tag_string, fav_count, score, is_deleted, is_pending, parent_id, description
    (1, "2020-01-02 03:04:05", "s", "red car  car unknown", 5, 1, "f", "f", "", 'says "hi",\nthen leaves'),
    (2, "2020-01-03 00:00:00", "q", "blue auto", 5, 1, "f", "f", "1", ""),
    (3, "2021-12-31 23:59:59", "e", "red", 7, 0, "t", "f", "", ""),
    (4, "", "s", "red blue", 9, 2, "f", "t", "", ""),
    (5, "2021-02-01 00:00:00", "s", "red blue car", 1, 3, "f", "f", "", ""),
    (6, "2021-02-01 00:00:00", "s", "", 1, 3, "f", "", "", ""),
]
COLUMNS = ["id", "created_at", "rating", "tag_string", "fav_count", "score", "is_deleted", "is_pending", "parent_id", "description"]


def put(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("dump")
    put(d / "db.csv", COLUMNS, POSTS)
    put(d / "tags.csv", ["id", "name", "category", "post_count"], [(10, "red", 0, 4), (11, "blue", 0, "x"), (12, "car", 1, 2), (13, "unused", "", 1)])
    put(d / "tag_aliases.csv", ["ID", "Antecedent_Name", "consequent_name", "status"], [(1, "auto", "car", "active")])
    put(d / "tag_implications.csv", ["id", "antecedent_name", "consequent_name", "status"], [(1, "auto", "red", "active"), (2, "blue", "red", "deleted")])
    pool = ["id", "name", "created_at", "updated_at", "creator_id", "description", "is_active", "category", "post_ids"]
    put(d / "pools.csv", pool, [(999, "a", "", "", 1, "", "t", "Series", "{5,1,1,2}"), (1000, "b", "", "", 1, "", "t", "collection", "{1,x,2}"), (1001, "c", "", "", 1, "", "f", "series", "{1,2,3}"), (1002, "d", "", "", 1, "", "t", "series", "{71,72,73}"), (1003, "e", "", "", 1, "", "t", "collection", "{81,82,83}")])
    return str(d)


def pairs_of(df):
    return {(r["post_id"], r["tag_id"]) for r in df.collect()}


def test_posts(spark, root):
    rows = {r["id"]: r for r in tables.read_posts(spark, f"{root}/db.csv").collect()}
    assert rows[1]["description"] == 'says "hi",\nthen leaves' and rows[1]["parent_id"] is None and rows[2]["parent_id"] == 1
    assert (rows[1]["year"], rows[1]["month"], rows[4]["year"]) == ("2020", "01", None)
    assert rows[6]["is_pending"] is None and rows[1]["comment_count"] == 0 and rows[1]["md5"] is None
    assert len(rows[1]) == 31


def test_tags_are_lenient(spark, root):
    assert {r["tag"]: r["post_count"] for r in tables.read_tags(spark, f"{root}/tags.csv").collect()} == {"red": 4, "blue": 0, "car": 2, "unused": 1}
    assert tables.read_name_pairs(spark, None).count() == 0


def test_pools_need_their_columns(spark, root):
    with pytest.raises(ValueError, match="post_ids"):
        tables.read_pools(spark, f"{root}/tags.csv")


def test_build(spark, root):
    everything = [x for x in cli.STEPS if not x.startswith("pools_")] + ["pools"]
    config = Settings(root, given={"pairs.support": 1, "universe.min_df": "1", "embedding.dim": 4, "neighbours.k": 2, "ranking.k": 2})
    assert {r["status"] for r in validate(spark, config).collect()} == {"WARN"}
    took = cli.run(spark, config, everything)
    assert set(took) == set(cli.STEPS) and "fresh" not in took.values()
    read = lambda n: spark.read.parquet(f"{root}/{n}")
    expected = {(1, 10), (1, 12), (2, 11), (2, 12), (5, 10), (5, 11), (5, 12)}
    stored = tables.read_post_tags(spark, f"{root}/post_tags")
    assert pairs_of(stored) == expected and checks.duplicate_pairs(stored).isEmpty()
    assert not checks.schema_faults(stored, checks.POST_TAGS) and not checks.schema_faults(read("tags_dict"), checks.TAGS_DICT)
    assert {r["tag"] for r in read("tags_dict").collect()} == {"red", "blue", "car"}
    assert pairs_of(tables.of_tag(read("post_tags"), 12)) == {(1, 12), (2, 12), (5, 12)}
    assert {(r["a_id"], r["b_id"]) for r in read("tag_implications").collect()} == {(12, 10)}
    assert {(r["tag_id"], r["post_id"], r["rank"]) for r in read("tag_topk").collect()} == {(10, 1, 1), (10, 5, 2), (11, 2, 1), (11, 5, 2), (12, 2, 1), (12, 1, 2)}
    assert {(r["rating"], r["year"], r["month"]) for r in read("posts_parquet").select("rating", "year", "month").distinct().collect()} >= {("s", "2020", "01"), ("s", None, None)}
    n = {r["tag_id"]: r["idf"] for r in read("tags_stats").collect()}
    assert math.isclose(n[10], math.log((3 + 1000) / (4 + 1000)))
    assert {r["pool_id"] for r in read("pools_meta").collect()} == {999, 1002, 1003}
    ok = pools.eligible_pools(read("pool_entropy"))
    assert {r["pool_id"] for r in ok.collect()} == {999, 1002}  # without tags a series stays, a collection goes
    assert {(r["a_post_id"], r["b_post_id"]) for r in read("pool_edges").collect()} == {(1, 2), (1, 5), (2, 5), (71, 72), (71, 73), (72, 73)}
    assert {r["post_id"]: r["pools"] for r in read("post_pool_counts").collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0}
    assert read("post2vec").count() == 3 and checks.vector_faults(read("post2vec"), "post_id", "vec", 4).isEmpty()
    assert checks.neighbour_faults(read("tag2vec_knn")).isEmpty()
    assert set(cli.run(spark, config, everything).values()) == {"fresh"}
    with pytest.raises(ValueError, match="no steps"):
        cli.run(spark, config, ["nonsense"])
    text, code = checks.report(found := validate(spark, config))
    assert code == 0 and found.where("status <> 'PASS'").isEmpty() and found.count() >= len(CHECKS), text
    meta = sinks.read_metadata(spark, f"{root}/tag2vec_meta.json")
    assert meta["settings"]["embedding"]["dim"] == 4 and len(meta["singular_values"]) <= 16 and meta["tags"] == 3
    assert sorted(r["id"] for r in sinks.read_roaring(spark, f"{root}/features/rating_s.roar").collect()) == [1, 4, 5, 6]
    assert cli.resolve(spark, config, " AUTO ") == ["tag 12"] and cli.resolve(spark, config, "lu") == ["maybe blue"]
    assert [x.split()[2] for x in cli.similar_tags(spark, config, "car", 2)] and cli.similar_tags(spark, config, "zzz") == ["nothing is like 'zzz'"]
    known = {r["post_id"]: any(r["vec"]) for r in read("post2vec").collect()}  # a zero vector is like nothing
    assert {int(x.split()[1]) for x in cli.similar_posts(spark, config, 1)} == ({i for i, ok in known.items() if ok and i != 1} if known[1] else set())
    # a post that is no longer what its vector says is found
    read("post2vec").withColumn("vec", F.transform("vec", lambda x: x + 1)).write.parquet(f"{root}/turned")
    assert not checks.recomputed_faults(read("turned"), read("post2vec"), "post_id", "vec").isEmpty()


def test_settings():
    s = Settings("d", reliable_only=False, given={"ranking.mode": "sqrt_df", "idf.alpha": "2", "eligible.use_series": "false"})
    assert s.of("ranking")["mode"] == "sqrt_df" and s.of("ranking")["k"] == 5000 and s.of("idf")["alpha"] == 2.0
    assert s.of("relation") == {"reliable_only": False} and s.of("eligible")["use_series"] is False and s.at("x") == "d/x"
    for bad in ({"ranking.nothing": 1}, {"nothing.k": 1}):
        with pytest.raises(ValueError, match="no settings"):
            Settings(given=bad)
    with pytest.raises(ValueError):
        Settings(given={"eligible.use_series": "maybe"}).of("eligible")


def test_roaring_is_the_public_format(spark):
    sets = [[], [0], [5, 65535, 65536, 1 << 31, (1 << 32) - 1], list(range(0, 200_000, 3)), list(range(70_000)), [*range(10), *range(1 << 17, (1 << 17) + 5000)]]
    for ids in sets:
        data = roaring.dump(ids)
        assert roaring.load(data) == ids
        theirs = spark._jvm.org.roaringbitmap.RoaringBitmap()
        theirs.deserialize(spark._jvm.java.nio.ByteBuffer.wrap(bytearray(data)))
        assert theirs.getCardinality() == len(ids) and list(theirs.toArray())[-3:] == [x - (1 << 32) if x >> 31 else x for x in ids[-3:]]
        theirs.runOptimize()
        out = spark._jvm.java.nio.ByteBuffer.allocate(theirs.serializedSizeInBytes())
        theirs.serialize(out)
        assert roaring.load(bytes(out.array())) == ids
    for bad in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            roaring.dump(bad)
    with pytest.raises(ValueError):
        roaring.load(b"\x00\x00\x00\x00\x00\x00\x00\x00")


def test_packs(spark, tmp_path):
    lists = spark.createDataFrame([(1, [0, 5, 300]), (257, [7]), (2, [])], "tag_id int, post_ids array<long>")
    assert sinks.export_packs(sinks.packed_lists(lists), str(tmp_path)) == 3
    index = (tmp_path / "index_0001.bin").read_bytes()
    records = [codec.INDEX_RECORD.unpack(index[i : i + 16]) for i in range(0, len(index), 16)]
    pack = (tmp_path / "shard_0001.pack").read_bytes()
    assert [(t, codec.decode(pack[o : o + n])) for t, o, n in records] == [(1, [0, 5, 300]), (257, [7])]
    found = sinks.read_packs(spark, str(tmp_path))
    assert {(r["tag_id"], tuple(r["post_ids"])) for r in found.collect()} == {(1, (0, 5, 300)), (257, (7,)), (2, ())} and checks.pack_faults(found).isEmpty()
    assert not checks.pack_faults(found.withColumn("gap", F.lit(1).cast("long"))).isEmpty()
    (tmp_path / "shard_0001.pack").write_bytes(pack[:-1])
    (tmp_path / ".shard_0001.pack.crc").unlink()
    with pytest.raises(Exception, match="beyond its pack"):
        sinks.read_packs(spark, str(tmp_path)).collect()


def test_codec():
    assert codec.encode([1, 129, 400]) == bytes([1, 0x80, 1, 0x8F, 2])
    for bad in ([3, 3], [-1]):
        with pytest.raises(ValueError):
            codec.encode(bad)
    for bad in (b"\x80", b"\x01\x80", b"\xff" * 9 + b"\x01"):
        with pytest.raises(ValueError):
            codec.decode(bad)
    assert codec.decode(b"") == [] and codec.decode(codec.encode([0, 127, 128, 1 << 62])) == [0, 127, 128, 1 << 62]
    with pytest.raises(ValueError):
        codec.decode(bytes([4, 0]))


def test_deltas(spark):
    df = spark.createDataFrame([([3, 4, 90],), ([],)], "ids array<long>").select(codec.deltas(F.col("ids")).alias("d"))
    assert [r["d"] for r in df.collect()] == [[3, 1, 86], []]
    assert [r["d"] for r in df.select(codec.undeltas(F.col("d")).alias("d")).collect()] == [[3, 4, 90], []]


def test_arrays(spark, tmp_path, root):
    import numpy as np

    columns = relation.post_columns(tables.read_posts(spark, f"{root}/db.csv"))
    assert sinks.export_arrays(columns, str(tmp_path), {"post_id": "<i8", "epoch_day": "<i4"}) == 6
    assert np.fromfile(tmp_path / "post_id.bin", "<i8").tolist() == [1, 2, 3, 4, 5, 6]
    assert np.fromfile(tmp_path / "epoch_day.bin", "<i4")[3] == 0
    sinks.write_metadata(spark, str(tmp_path / "m.json"), a=1)
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}


def test_arrays_are_never_broadcast(spark, tmp_path, monkeypatch):
    import numpy as np

    n = 700_000  # the bytes of the files are below Spark's limit of a broadcast, their rows are not
    monkeypatch.setattr(sinks, "ARRAY_PART", 300_000, raising=False)
    columns = spark.range(n).select(((F.col("id") * 7919) % n).alias("id"), ((F.col("id") * 7919) % n % 5).alias("v"))
    assert sinks.export_arrays(columns, str(tmp_path), {"id": "<i8", "v": "|i1"}) == n
    assert np.array_equal(np.fromfile(tmp_path / "id.bin", "<i8"), np.arange(n))
    its = {c: sinks.read_array(spark, str(tmp_path), c, t).withColumnRenamed("value", c) for c, t in (("id", "<i8"), ("v", "|i1"))}
    both = its["id"].join(its["v"], "row")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert tuple(both.agg(F.count("*"), F.sum("row"), F.sum(F.when((F.col("row") != F.col("id")) | (F.col("v") != F.col("id") % 5), 1).otherwise(0))).first()) == (n, n * (n - 1) // 2, 0)
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole numbers"):
        sinks.read_array(spark, str(tmp_path), "odd", "<i2").collect()


def test_parsed_ids(spark):
    df = spark.createDataFrame([("{3,1,1,2}",), ("{}",), ("",), ("{5, x ,4}",), (None,), ("{7",)], "s string")
    assert [r[0] for r in df.select(pools.parsed_ids(F.col("s"))).collect()] == [[1, 2, 3], [], [], [4, 5], None, []]


def test_counts_do_not_wrap(spark):
    pairs = spark.range(600).select(F.col("id").alias("post_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("tag_id"))
    known = spark.createDataFrame([(1, 600), (2, 600)], "tag_id int, post_count long")
    assert [tuple(r)[:3] for r in stats.tag_pmi(pairs, known).collect()] == [(1, 2, 600)]


def test_svd_agrees_with_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.6), 1)
    m = m + m.T
    cells = [(int(i) + 100, int(j) + 100, float(m[i, j])) for i, j in zip(*m.nonzero(), strict=True)]
    universe = spark.createDataFrame([(100 + i, 1) for i in range(10)], "tag_id long, df long")
    vecs, sigma = vectors.tag2vec(spark.createDataFrame(cells, "a long, b long, x double"), universe, 5)
    u, s, _ = np.linalg.svd(m)
    assert np.allclose(sigma, s[:5], atol=1e-6)
    rows = np.array([r["vec"] for r in vecs.orderBy("tag_id").collect()])
    assert not rows[9].any() and np.allclose((rows[:9] ** 2).sum(1), 1)
    own = u[:, :5] * np.sqrt(s[:5])
    own /= np.linalg.norm(own, axis=1)[:, None]
    assert np.allclose(rows[:9] @ rows[:9].T, own @ own.T, atol=1e-5)


def test_neighbours_of_copies(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8))
    v[100:160] = v[7]  # equal vectors, and ones that differ in the last bits only
    v[200:300] = v[8] * (1 + np.arange(100)[:, None] / 7)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = rng.permutation(700)
    monkeypatch.setattr(vectors, "GROUPS", 16, raising=False)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "tag_id long, vec array<double>").repartition(5)
    sims = np.round(v @ v.T, 9)
    near = {int(i): [int(n) for _, n in sorted((-s, n) for s, n in zip(row, ids, strict=True) if n != i)[:4]] for i, row in zip(ids, sims, strict=True)}
    for asked, block in ((None, 4096), (None, 100), (df.where("tag_id % 9 = 0").select("tag_id"), 50)):
        found = {}
        for r in vectors.knn(df, 4, query_block=block, queries=asked).orderBy("id", "rank").collect():
            found.setdefault(r["id"], []).append(r["nn_id"])
        assert found == {i: n for i, n in near.items() if asked is None or i % 9 == 0}


def test_index_faults_move_each_side_once(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (2, 5), (3, 6)], "post_id long, tag_id int")
    index = spark.createDataFrame([(5, [1, 2, 9]), (7, [4, 4])], "tag_id int, post_ids array<long>")
    found = checks.index_faults(index, pairs)
    assert sorted(map(tuple, found.collect())) == [(2, 5, "relation"), (2, 5, "relation"), (3, 6, "relation"), (4, 7, "index"), (4, 7, "index"), (9, 5, "index")]
    assert checks.index_faults(relation.inverted_index(pairs.distinct()), pairs.distinct()).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(post_ids") == 1


def test_stream(spark, root, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    full = [n for n, _, _ in tables.POSTS]
    for part in (POSTS[:2], POSTS[2:]):
        put(folder / f"{part[0][0]}.csv", full, [[dict(zip(COLUMNS, p, strict=True)).get(c, "") for c in full] for p in part])
    known, mapping = tables.read_tags(spark, f"{root}/tags.csv"), spark.createDataFrame([("auto", "car")], "tag string, canon string")
    q = incremental.ingest(incremental.post_stream(spark, str(folder), 1), known, mapping, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert pairs_of(incremental.ingested(spark, str(tmp_path / "out"))) == {(1, 10), (1, 12), (2, 11), (2, 12), (5, 10), (5, 11), (5, 12)}


def test_manifest_and_fingerprint(spark):
    m = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    found = checks.manifest_diff(m([("a", "1"), ("b", "1"), ("c", "1")]), m([("a", "1"), ("b", "2"), ("d", "1")])).collect()
    assert {(r["path"], r["change"]) for r in found} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    x, y = spark.range(10), spark.range(10).orderBy(F.desc("id"))
    assert checks.fingerprint(x, "id").collect() == checks.fingerprint(y, "id").collect()


def test_rows_and_report(spark):
    rows = sinks.row_map(spark.range(5, 900, 7).repartition(5), "id")
    assert checks.row_map_faults(rows).isEmpty()
    assert [(r["row"], r["id"]) for r in rows.orderBy("row").collect()] == list(enumerate(range(5, 900, 7)))
    assert not checks.row_map_faults(rows.where("row > 0")).isEmpty()
    text, code = checks.report(checks.verdict(rows, "has rows", F.lit(0)).unionByName(checks.verdict(rows, "has none", F.count("*"))))
    assert code == 1 and "FAIL  has none: 128" in text
