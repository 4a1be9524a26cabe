"""The pipeline on documents made for it, each stage against what it is to do."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    r = random.Random(3)
    word = {g: ["".join(r.choice(a) for _ in range(r.randrange(2, 7))) for _ in range(300)] for g, a in (("en", "abcdefg"), ("fr", "hijklmn\u00e9"))}
    text = lambda g, n: " ".join(r.choices(word[g], k=n))
    rows = [(i, text("en" if i % 3 else "fr", 120), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(80)]
    item = text("en", 30)
    near = rows[1][1].split()
    near[50] = "changed"
    rows += [
        (100, "1234 !!", "en", "s0"),
        (101, None, "en", "s0"),
        (102, " ".join(near), "en", "s1"),
        (103, rows[2][1], "en", None),
        (104, text("en", 60) + " " + item, "en", "s2"),
        (105, text("en", 60) + ' token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ' + text("en", 20), "en", "s3"),
    ]
    docs = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = pipeline.written(stage(spark, docs, folder), name)
        assert out.columns[:5] == docs.columns[:5]
        seen[name], docs = ({r["doc_id"]: r for r in out.collect()}), out
    clean = set(range(80))
    assert set(seen["language_id"]) == clean | {102, 103, 104, 105}
    assert set(seen["near_duplicates"]) == clean | {104, 105}
    assert set(seen["decontamination"]) == clean | {105} == set(seen["secrets"])
    hidden = seen["secrets"][105]
    assert "<secret>" in hidden["text"] and "f33e61083db5" not in hidden["text"] and hidden["n_chars"] == len(hidden["text"])
    assert all(seen["secrets"][i]["text"] == seen["language_id"][i]["text"] for i in clean)
    mixed = seen["mixing"].values()
    assert all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mixed)
    target = {r["source"]: r["target"] for r in mixed}
    for s, t in target.items():
        assert abs(sum(r["taken"] for r in mixed if r["source"] == s) - t) <= 130


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0


def test_empty_and_extra_columns(spark, folder, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, sig string")
    for _, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, folder), "empty")
    assert docs.isEmpty() and docs.columns.count("size") == 1


def test_weak_predictions_among_many_languages_stay(spark, folder):
    r = random.Random(8)
    word = lambda g: "".join(chr(0x4E00 + 4 * g + r.randrange(4)) for _ in range(4))
    rows = [(100 * g + i, " ".join(word(g) for _ in range(40)), f"l{g}", "s", 0) for g in range(40) for i in range(12)]
    rows += [(5000 + g, " ".join(word((g + i) % 40) for i in (0, 0, *range(1, 12))), f"l{g}", "s", 0) for g in range(40)]
    docs = spark.createDataFrame([*rows, (9999, "12 34", "l0", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    found = pipeline.langid.identify(docs)
    assert not found.where("score between 0.0001 and 0.3").isEmpty()
    assert sorted(x["doc_id"] for x in pipeline.language_id(spark, docs, folder).collect()) == sorted(x[0] for x in rows)


def test_repeated_rows_ties_nulls_and_long_texts_in_every_stage(spark, folder):
    r = random.Random(21)
    known = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 80")
    long = " ".join(r.choices([w for t in known.where("lang = 'en'").select("text").limit(5).collect() for w in t[0].split()], k=30_000))
    odd = [(500, long, "en", None, None), (500, long, "en", None, None), (None, "abcdefg gfedcba bad cab fed egg", None, None, None), (501, None, None, "s1", 7), (502, "", "en", "s1", 0), (503, "fade bad cab", "en", "s9", 12)]
    docs = known.unionByName(spark.createDataFrame(odd, known.schema))
    out = {}
    for name, stage in pipeline.STAGES:
        made = pipeline.written(stage(spark, docs, folder), name)
        out[name] = made.collect()
    count = lambda name, i: sum(x["doc_id"] == i for x in out[name])
    assert len(out["language_id"]) == 84 and count("language_id", 501) == count("language_id", 502) == 0 and count("language_id", None) == 1
    assert len(out["near_duplicates"]) == 85 and count("near_duplicates", 500) == 1 and count("near_duplicates", 501) == count("near_duplicates", 502) == 1
    assert len(out["decontamination"]) == 86 == len(out["secrets"])
    assert {x["taken"] for x in out["mixing"] if x["doc_id"] in (501, 502)} <= {0} and {x["copies"] for x in out["mixing"]} <= {1, 2, 3}
    hidden = {x["doc_id"]: x for x in out["secrets"]}
    assert hidden[501]["text"] is None and hidden[501]["n_chars"] == 7 and hidden[502]["text"] == "" and hidden[500]["text"] == long
    again = {name: stage(spark, docs, folder).count() for name, stage in pipeline.STAGES}
    assert again == {name: len(rows) for name, rows in out.items()}
