"""Each corpus operator on small tables with nulls, empty and odd texts, ties, repeated rows, no rows and clashing names."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, decontam, langid, mixing, phrases, secrets, store, tokencount, urlrules, warc
from tidemark.llm.store import new_path

DOCS = "doc_id long, text string, lang string, source string, size string, n_hit string, spans string, score string, kept string"


def documents(spark, rows, partitions=2):
    """rows: (doc_id, text[, lang[, source]]); the other columns clash with the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, *["clash"] * 5) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def words_of(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(2, 6))) for _ in range(n)]


# mixing


def filled(sizes, weights, cap=3.0):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * left / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(words_of(i, r.randrange(0, 30))), "en", s) for i, s in enumerate(["a"] * 150 + ["b"] * 3 + ["c"] * 40 + [None] * 25 + ["\u00e9"] * 30 + ["z"])]
    rows += [(5, "one two", "en", "a")] * 2 + [(None, "x y z", "en", "b"), (900, None, "en", "c"), (901, "", "en", "void")]
    out = mixing.mix_sources(documents(spark, rows), carry=["doc_id", "source", "size"]).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, filled([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], target[x["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert x["taken"] == x["copies"] * x["size"] and x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]), s
    again = mixing.mix_sources(documents(spark, rows, 3)).select("row.doc_id", "taken").collect()
    assert sorted((str(x["doc_id"]), x["taken"]) for x in again) == sorted((str(x["doc_id"]), x["taken"]) for x in out)


@pytest.mark.parametrize("few", [100_000, 20])
def test_mixing_fills_behind_a_long_document(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "_FEW", few, raising=False)
    r = random.Random(9)
    lengths = {s: [r.randrange(100, 401) for _ in range(150)] + [40_000] for s in "abcdef"} | {"z": [30_000] * 20}
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate((s, n) for s, ns in lengths.items() for n in ns)]
    for seed in (1, 2, 3):
        out = mixing.mix_sources(documents(spark, rows), weights=(1.0,), budget=90_000.0, seed=seed, carry=["source"]).select("row.source", "size", "target", "copies", "taken").collect()
        for s in "abcdef":
            own = [x for x in out if x["source"] == s]
            lack = own[0]["target"] - sum(x["taken"] for x in own)
            least = min(x["size"] for x in own if not x["copies"])
            assert 0 < own[0]["target"] < 13_000 and abs(lack) <= least / 2, (seed, s, lack)


def test_mixing_nothing(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# secrets

HEXES = ["f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "0123456789abcdef", "0123456789abcde"]


def test_base_spans_and_edges(spark):
    texts = [
        None,
        "",
        f'Token = "{HEXES[0]}" und',
        "PASSWORD: 'hunter2hunter2' api-key=nope apikey=aaaaaaaaaaaa api_key=bbbbbbbbbbbb",
        "secret=password=abcdefghijkl token=short",
        "AKIA" + "Q" * 14 + " AKIA" + "Q" * 13,
        f"\u00e9\u00e9 {HEXES[1]} {HEXES[2]} \u212aey \u017fecret=qqqqqqqqqqqqqqqq",
        "x" * 50_000 + f" {HEXES[0]}",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[2])]
    out = secrets.find_secrets(documents(spark, rows), learn=False).select("row.doc_id", "spans").collect()
    assert len(out) == len(rows)
    own = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in out}
    assert own[0] == own[1] == []
    assert [k for k, *_ in own[2]] == ["assign", "hex"]
    assert [k for k, *_ in own[3]] == ["assign"] * 3
    assert own[4] == [("assign", 0, 28)]
    assert own[5] == [("access", 0, 18)]
    assert own[6] == [("hex", 3, 19)]
    assert own[7] == [("hex", 50_001, 50_041)] and own[None] == own[2]


def test_viterbi_and_gradient_are_exact():
    rng = np.random.default_rng(0)
    f = secrets.Field()
    f.step = rng.normal(size=(3, 3))
    t = f.steps()
    for n in (1, 3, 6):
        s, first = rng.normal(size=(n, 3)), rng.random(n) < 0.3
        first[0] = True
        total = lambda p: sum(s[i][x] + (secrets._START[x] if first[i] else t[p[i - 1], x]) for i, x in enumerate(p))
        assert f.viterbi(s, first).tolist() == list(max(product(range(3), repeat=n), key=total))
    # over many segments, against the plain recursion
    s, first = rng.normal(size=(1000, 3)), rng.random(1000) < 0.01
    first[0] = True
    best, back = s[0] + secrets._START, []
    for i in range(1, 1000):
        way = best[:, None] + (secrets._START[None] if first[i] else t)
        back.append(way.argmax(0))
        best = way.max(0) + s[i]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert f.viterbi(s, first).tolist() == path[::-1]
    # tokens that are idle throughout are O throughout
    low = s - np.array([30.0, 30.0, 0.0])
    assert f.idle(low).all() and (f.viterbi(low, first) == secrets.O).all()
    # the gradient of the log-likelihood by differences
    places, gold = rng.integers(0, 40, (2, 5, secrets._SLOTS)).astype(np.int32), np.array([[0, 1, 2, 0, 1], [2, 2, 0, 2, 2]])
    real, weight = np.array([[True] * 5, [True] * 3 + [False] * 2]), np.array([1.0, 0.5])
    f.state[:40] = rng.normal(size=(40, 3))

    def likelihood():
        s, t, out = f.scores(places), f.steps(), 0.0
        for c in range(2):
            n = int(real[c].sum())
            value = lambda p: secrets._START[p[0]] + sum(s[c, i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            out += weight[c] * (value(gold[c, :n]) - np.log(sum(math.exp(value(p)) for p in product(range(3), repeat=n))))
        return out

    d_state, d_step = f._gradient(places, gold, real, weight)
    for at, array, d in (((7, 0), f.state, d_state), ((11, 2), f.state, d_state), ((0, 1), f.step, d_step), ((2, 2), f.step, d_step)):
        array[at] += 1e-2
        up = likelihood()
        array[at] -= 2e-2
        assert math.isclose((up - likelihood()) / 2e-2, d[at], abs_tol=2e-3)
        array[at] += 1e-2


def prose(seed, n):
    return [" ".join(words_of(f"{seed}-{i}", 40, "abcdefghiklmnoprstuvwz")) + "." for i in range(n)]


def test_field_finds_planted_secrets_of_all_kinds_and_of_a_kind_it_never_saw(spark):
    facts = 100

    def score(field, kinds, seed):
        r, hits, wrong, n = random.Random(seed), 0, 0, 0
        texts, truth = [], []
        for text in prose(f"test{seed}", 400):
            text, secret, _ = secrets.planted(text, r, kinds)
            texts.append(text)
            truth.append(secret)
        for text, secret in zip(texts, truth, strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            base = secrets.base_spans(text)
            if secret and any(a < secret[1] and secret[0] < b for a, b, _ in base):
                continue
            found = [x for x in secrets.found_spans(field, raw, np.array([0, len(raw)]), secrets.CAUTION)[0] if not any(a < x[1] and x[0] < b for a, b, _ in base)]
            hit = [x for x in found if secret and x[0] < secret[1] and secret[0] < x[1]]
            n, hits, wrong = n + bool(secret), hits + bool(hit), wrong + len(found) - len(hit)
        return hits / n, hits / max(1, hits + wrong)

    windows = [(x, facts) for x in prose("train", 900)]
    recall, precision = score(secrets.Field().train(secrets.examples(windows)), list(secrets.PLANTS), 1)
    assert recall > 0.85 and precision > 0.95, (recall, precision)
    for kind, least in (("signed", 0.8), ("key", 0.4)):
        recall, precision = score(secrets.Field().train(secrets.examples(windows, [k for k in secrets.PLANTS if k != kind])), [kind], 2)
        assert recall > least and precision > 0.9, (kind, recall, precision)


def test_field_over_documents(spark):
    r = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate(prose("docs", 300))]
    long = " ".join(words_of(77, 30_000, "abcdefghiklmnoprstuvwz"))
    dump = "+/".join("".join(r.choice(secrets._ALNUM) for _ in range(60)) for _ in range(400))
    rows += [(1000, "\u00e9\u00e9 " + rows[5][1] + f" client secret {'Kx7'}pQ9zLm2Vb4TnR and " + rows[6][1], "en"), (1001, long + " api key is Zq8Rt5Wn3Yb6Vc1Xm4Kp", "en"), (1002, dump, "en"), (1003, None, "en"), (1004, "", "en"), (1000, rows[0][1], "en")]
    out = secrets.find_secrets(documents(spark, rows)).select("row.doc_id", "spans").collect()
    assert len(out) == len(rows)
    of = {}
    for x in out:
        of.setdefault(x["doc_id"], []).extend((s["kind"], s["start"], s["end"]) for s in x["spans"])
    text = rows[300][1]
    at = text.index("Kx7")
    assert ("crf", at, at + 16) in of[1000]
    at = rows[301][1].index("Zq8R")
    assert ("crf", at, at + 20) in of[1001]
    assert not of[1003] and not of[1004] and sum(len(of[i]) for i in range(300)) <= 3
    assert secrets.find_secrets(documents(spark, [])).isEmpty()


def test_redaction(spark):
    df = spark.createDataFrame([("\u00e9 abcdef x", [(2, 5), (4, 8)]), ("ab", []), (None, [])], "t string, spans array<struct<start:long,end:long>>")
    assert [r[0] for r in df.select(secrets.redacted(F.col("t"), F.col("spans"))).collect()] == ["\u00e9 <secret> x", "ab", ""]


# decontamination


def contaminated_brute(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = word(text), set(), set()
    for i, t in items:
        v = word(t)
        n = min(13, len(v))
        grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in grams:
                hit.update(range(j, j + n))
                if i is not None:
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    base = [words_of(i, 40) for i in range(8)]
    items = [(i, " ".join(b)) for i, b in enumerate(base)] + [(20, "Alpha, beta"), (21, "solo"), (22, ""), (23, None), (None, " ".join(base[0][5:30])), (1, " ".join(base[1])), (24, " ".join(base[1][3:20]))]
    r = random.Random(2)
    texts = [None, "", "solo", "ALPHA -- beta", "alpha beta gamma", "12 solo 13", " ".join(base[1]).upper(), ". ".join(base[0][:13]), " ".join(base[0][:12]), " ".join(words_of(99, 300))]
    for i in range(30):
        b, a = r.choice(base), r.randrange(25)
        texts.append(" ".join(words_of(100 + i, r.randrange(200)) + b[a : a + r.randrange(10, 20)] + words_of(200 + i, r.randrange(50))))
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, texts[7])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_contamination(documents(spark, rows), benchmark, carry=["doc_id", "n_hit"], block_bytes=block_bytes)
    found = out.select("row.doc_id", "n_words", F.col("n_hit"), "items").collect()
    assert len(found) == len(rows)
    expected = sorted((str(d), *contaminated_brute(t, items)) for d, t in rows)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["items"]) for x in found) == expected
    assert decontam.find_contamination(documents(spark, rows), benchmark.limit(0)).where("n_hit > 0").isEmpty()
    assert decontam.find_contamination(documents(spark, []), benchmark).isEmpty()


# token counts


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "Hello  world's   \n\n end ", "<|endoftext|>a<|endoftext|>", "\u4f60\u597d, \U0001f600! x\u00b2 \u00bd \u0378\u2028b", "can't we'll I'VE 123abc_def  ", "a" * 30_000, "\x00\x01 tab\tnew\r\nline\u00a0\u3000wide", "\U0001fae9 \u1c89\u088f"]
    r = random.Random(8)
    texts += ["".join(chr(r.choice([*range(32, 127), *range(0xA0, 0x250), 0x2019, 0x4E00, 0x10330])) for _ in range(200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[2])]
    out = tokencount.count_tokens(documents(spark, rows)).select("row.doc_id", "n_bytes", "n_tokens").collect()
    library = Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY))
    expected = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_tokens"]) for x in out) == expected


# languages


def test_languages(spark):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "\u00e9\u00e0klm"}
    rows = [(i, " ".join(words_of(i, 5 + i % 40, alphabets[g])), g, "s") for i, g in ((i, list(alphabets)[i % 3]) for i in range(300))]
    odd = [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (None, rows[0][1], "bb"), (1003, "\u4e00", None), (5, rows[5][1], rows[5][2])]
    df = documents(spark, rows + odd)
    found = {str(r["doc_id"]): r for r in langid.identify(df).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(found[str(i)]["lang_pred"] == "und" and found[str(i)]["score"] == 0 for i in (1000, 1001, 1002))
    assert found["1003"]["lang_pred"] in alphabets and found["None"]["lang_pred"] == "aa"
    held = [r for r in df.where(langid.held_out(F.col("doc_id"))).select("doc_id", "lang").collect() if r["doc_id"] < 300]
    assert held and all(found[str(r["doc_id"])]["lang_pred"] == r["lang"] for r in held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    # labels of held-out documents change nothing
    other = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert {str(r["doc_id"]): r["lang_pred"] for r in langid.identify(other).select("row.doc_id", "lang_pred").collect()} == {k: r["lang_pred"] for k, r in found.items()}
    assert langid.identify(documents(spark, [(1, "abc")])).first()["lang_pred"] == "und"
    assert langid.identify(documents(spark, [])).isEmpty()


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 7))
    x[50:90] = x[49]  # one common vector
    rows = [(i * 10, [float(v) for v in x[i]], 0) for i in range(400)]
    odd = [(7, None, 0), (50_000, [0.0] * 7, 0), (50_050, [1.0, None, *[0.0] * 5], 0), (50_100, [float("nan")] * 7, 0), (50_150, [float("inf")] * 7, 0), (50_200, [1.0], 0), (None, [1.0] * 7, 0), (50_250, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(3)
    out = ann.nearest(df, F.col("id") % 50 == 0, rows=150, query_block=32).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, unit = np.array([r[0] for r in rows]), x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        s = np.round(unit @ unit[q // 10], 12)
        s[q // 10] = -9
        best = [int(ids[i]) for i in np.lexsort((ids, -s))[:5]]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 5 and all(math.isclose(v, s[i // 10], abs_tol=1e-9) for i, v in found)
        if 490 <= q < 900:
            assert [i for i, _ in found] == best  # ties by id
    assert hits >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int")
    assert ann.nearest(few, F.col("id") == 0).count() == 2
    assert ann.nearest(df.limit(0), F.col("id") == 0).isEmpty()


def test_neighbours_in_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 32))
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = {True: [], False: []}
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits[q < 1000].append(len(found & set(np.argsort(-s)[:5].tolist())) / 5)
    assert len(got) == 150 and np.mean(hits[True]) >= 0.99 and np.mean(hits[False]) >= 0.99, (np.mean(hits[True]), np.mean(hits[False]))


@pytest.mark.parametrize("rows", [64, 8192])
def test_neighbours_of_repeated_rows(spark, rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 6))
    plain = [(i, [float(v) for v in x[i]]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    find = lambda r: sorted(map(tuple, ann.nearest(spark.createDataFrame(r, schema).repartition(2), F.col("id") % 5 == 0, rows=rows).collect()))
    once = find(plain)
    assert len(once) == 60 and find(plain * 8) == once


def test_neighbours_of_tiny_vectors_and_odd_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5)) * 10.0 ** rng.integers(-200, 200, (40, 1))
    rows = [(str(i), [float(v) for v in x[i]]) for i in range(40)] + [("no number", [1.0] * 5)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), F.col("id") % 10 == 0).collect()
    unit = ann.scaled(x)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert len(found) == 20
    for r in found:
        s = unit @ unit[r["query_id"]]
        s[r["query_id"]] = -9
        assert r["vec_id"] == np.argsort(-s)[r["rank"] - 1] and math.isclose(r["score"], s[r["vec_id"]], abs_tol=1e-12)


def test_table_scan_adds_up_what_the_codes_say():
    rng = np.random.default_rng(2)
    units = ann._unit(rng.normal(size=(300, 13)))
    model = ann.learn(units, ann.eta(0.2, 13), 4, 5)
    codes = model.quantiser.encode(units)
    table, step = ann.tables(model.quantiser.books, units[:7])
    coded = model.quantiser.books[np.arange(8), codes].reshape(300, -1)
    code = ann.packed(codes)
    assert code.shape == (300, 4) and code.dtype == np.uint8 and 1 <= model.probe <= 4 and 0 < model.slack <= 1
    assert np.abs(ann.scan(table, code) * step - coded @ units[:7].T).max() <= step * 4


# archives


@pytest.mark.parametrize("chunk_bytes", [7, 1 << 20])
def test_archives(spark, chunk_bytes):
    html = ["h\u00e9\u00e9\r\n" * 7, "", "abc\r\n\r\n", "\r\n\r\n\r\n", None, "h\u00e9\u00e9\r\n" * 7, "\u00fc" * 50, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\r\n", "z" * 9000]
    rows = [(i + 1, "http://a/\r\nX: 1" if i else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", html[0], "x"), (3, "u", html[2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    path = new_path(spark, "warc-test")
    warc.write_warc(df, path, chunk_bytes=chunk_bytes)
    table = warc.read_warc(spark, path)
    last = table.where("last").collect()
    assert len(last) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        to = first[h or ""]
        expected.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == to else "revisit", str(None if i == to else to)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in last) == sorted(expected)
    whole = {}
    for r in sorted(table.where("not last and page_id <> 3").collect(), key=lambda r: r["chunk_no"]):
        whole[r["page_id"]] = whole.get(r["page_id"], b"") + r["data"]
    assert whole == {i: h.encode() for i, _, h, _ in rows if i not in (None, 3) and h and first[h] == i}
    assert max(len(r["data"]) for r in table.collect()) <= chunk_bytes


def test_no_archive_and_small_payloads(spark):
    path = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).isEmpty()
    path = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbb"), (4, "u", "bbb")], "page_id long, url string, html string"), path, min_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_warc(spark, path, keep_data=False).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# repeated phrases


def kept_brute(rows, n=13):
    place = lambda d: math.inf if d is None else d
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            owner[g] = min(owner.get(g, math.inf), place(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i for j in range(len(w) - n + 1) if owner[tuple(w[j : j + n])] < place(d) for i in range(j, j + n)}
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("limit", [phrases.BROADCAST_ANCHORS, 0])
def test_repeated_phrases(spark, monkeypatch, limit):
    monkeypatch.setattr(phrases, "BROADCAST_ANCHORS", limit)
    monkeypatch.setattr(store, "BROADCAST_BYTES", limit and 1 << 10)
    monkeypatch.setattr(phrases, "SHARD", 20)
    r = random.Random(6)
    passage = words_of(1, 60)
    few = words_of(2, 4)
    texts = [None, "", " \t", "short", " ".join(passage[:13]), " ".join(passage[:12]), " ".join(passage).upper(), "\n".join(passage), " ".join(r.choices(few, k=200)), " ".join(["a"] * 40), " ".join(["a"] * 13)]
    for i in range(40):
        a = r.randrange(50)
        texts.append(" ".join(words_of(50 + i, r.randrange(30)) + passage[a : a + r.randrange(5, 40)] + r.choices(few, k=r.randrange(30)) + words_of(150 + i, r.randrange(9))))
    texts += r.choices(texts[10:], k=8) + ["\u00e9t\u00e9 " * 30, "\u00e9t\u00e9\x85x " * 30]
    rows = [((i * 37) % 101, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, texts[7]), (rows_id := 37, texts[1]), (74, texts[7]), (74, texts[2])]
    assert rows_id == 37
    out = phrases.remove_repeats(documents(spark, rows, 3), carry=["doc_id", "kept"], part_bytes=500).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept"].decode()) for x in out) == kept_brute(rows)


def test_no_phrases(spark):
    assert phrases.remove_repeats(documents(spark, [])).isEmpty()


# urls


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/?q", "http://example.com", "http://x.net/es/a", "http://x.net/es", "http://xnet/es/", "http://net/fr/#f", "nothing", None, "x://h?a://b/c", "http://a.com/p\nq", "http://notexample.com/en/", "//a.net/es/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, urls[3], "x")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "page_id long, label string")
    out = {str(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.filter_urls(pages, labels).collect()}
    assert out["0"] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert out["1"] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out["2"] == ("example.com", "", None, "allow")
    assert out["3"] == ("x.net", "/es/a", "net/es/", "block") == out["None"]
    assert out["4"][2] is None and out["5"][2] is None
    assert out["6"] == ("net", "/fr/", "net/fr/", "block")
    assert out["7"] == out["8"] == ("", "", None, "allow") == out["12"]
    assert out["9"] == ("h", "", None, "allow")
    assert out["10"] == ("a.com", "/p\nq", "com/", "allow")
    assert out["11"][2] == "com/"
    assert urlrules.filter_urls(pages.limit(0), labels).isEmpty()


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}.example.org/{'casino' if i % 4 == 1 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.where("page_id < 150").select("page_id", F.when(F.col("page_id") % 4 == 1, "block").when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise("allow").alias("label"))
    out = {r["page_id"]: r["verdict"] for r in urlrules.filter_urls(pages, labels, rules=()).collect()}
    assert out == {i: "block" if i % 4 == 1 else "allow" for i in range(200)}


def test_rules_of_a_small_host_in_a_large_table(spark):
    rows = [(i, f"http://{'rare' if i < 12 else 'many'}.example.org/{'r' if i < 12 else 'm'}") for i in range(1600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", F.when(F.col("page_id") < 11, "block").when(F.col("page_id") > 11, "allow").alias("label"))
    out = {r["page_id"]: r["verdict"] for r in urlrules.filter_urls(pages, labels, rules=()).collect()}
    assert out == {i: "block" if i < 12 else "allow" for i in range(1600)}


@pytest.mark.parametrize("noise", [False, True])
def test_rules_behind_a_host_of_many_shared_tokens(spark, noise):
    shared = [f"p{x}" for x in "abcdefghijklmn"]
    urls = [("/".join(x for j, x in enumerate(shared) if not noise or i >= 14 or j != i), "allow") for i in range(60)]
    urls += [("spam", "block" if i % 9 else "allow") for i in range(45)] + [("spam", None)] * 3
    pages = spark.createDataFrame([(i, f"http://h{'ot' if v == 'allow' and u != 'spam' else 'am'}/{u}/") for i, (u, v) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(urls)], "page_id long, label string")
    out = {r["page_id"]: r["verdict"] for r in urlrules.filter_urls(pages, labels, rules=()).collect()}
    assert out == {i: "block" if u == "spam" else "allow" for i, (u, _) in enumerate(urls)}


def test_rules_that_hold_less_often_than_not(spark):
    """A tenth of all URLs is blocked; of one combination of tokens six in ten are, of each token alone far fewer."""
    rows, labels = [], []
    for i in range(1200):
        host, path = ("x" if i % 4 < 1 else "y"), ("win" if i % 5 == 0 else "text")
        rows.append((i, f"http://{host}.example.org/{path}/"))
        bad = i // 20 % 5 < 3 if (host, path) == ("x", "win") else i % 13 == 0
        labels.append((i, "block" if bad else "allow"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels, "page_id long, label string")
    out = {r["page_id"]: r["verdict"] for r in urlrules.filter_urls(pages, known, rules=()).collect()}
    assert out == {i: "block" if i % 4 < 1 and i % 5 == 0 else "allow" for i in range(1200)}


def test_equal_rules_and_long_urls(spark):
    """Tokens p and q go with opposite labels equally often: the rule whose items come first decides where both fit."""
    rows = [(i, f"http://h.org/{'p' if i % 2 else 'q'}") for i in range(40)] + [(100, "http://h.org/p/q"), (101, "http://h.org/" + "z/" * 50_000 + "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, "allow" if i % 2 else "block") for i in range(40)], "page_id long, label string")
    out = {r["page_id"]: r["verdict"] for r in urlrules.filter_urls(pages, labels, rules=()).collect()}
    assert out[100] == "allow" and out[101] == "block" and all(out[i] == ("allow" if i % 2 else "block") for i in range(40))


# very long texts, and the tables that operators keep


def test_very_long_texts(spark):
    long = words_of(1, 200_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:1100]) + " x " + " ".join(words_of(2, 50))), (3, " ".join(words_of(3, 60)))]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], 1)
    out = phrases.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out} == {1: (200_000, 0), 2: (151, 100), 3: (60, 0)}
    benchmark = spark.createDataFrame([(7, " ".join(long[150_000:150_040]))], "item_id long, text string")
    out = decontam.find_contamination(docs, benchmark).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out} == {1: (200_000, 40, ["7"]), 2: (151, 0, []), 3: (60, 0, [])}
    assert {r["size"] for r in mixing.mix_sources(docs).select("size").collect()} == {200_000, 151, 60}
    more = documents(spark, [(i, t, "en") for i, t in rows] + [(10 + i, " ".join(words_of(i, 9, "uvwxyz")), "fr") for i in range(40)])
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(more).select("row.doc_id", "lang_pred").where("doc_id < 4").collect()} == {1: "en", 2: "en", 3: "en"}


def test_languages_beyond_the_bound_are_not_learned(spark):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join(words_of(i, 20, alphabets[g])), g) for i, g in ((i, "aa" if i % 2 else "bb" if i % 8 else "cc") for i in range(160))]
    assert {r["lang_pred"] for r in langid.identify(documents(spark, rows), max_langs=2).select("lang_pred").distinct().collect()} == {"aa", "bb"}


def test_what_is_held_is_released(spark):
    with store.scope() as held:
        table, value = store.written(spark.range(5).withColumn("s", F.lit("x" * 100)), "held"), store.shared(spark, [1])
    assert len(held) == 2 and value.value == [1] and table.count() == 5
    assert "broadcast" in store.few(table)._jdf.queryExecution().logical().toString().lower()
    folder = table.inputFiles()[0]
    store.release(spark, held)
    assert not held and store._SCOPES == []
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(folder).count()


def test_batches_are_bounded_in_bytes(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 4000).alias("text"))
    from tidemark.llm.arrow import map_texts

    rows = map_texts(docs, "text", ["doc_id"], lambda: lambda texts: [__import__("pyarrow").array([len(texts)] * len(texts))], "n long").agg(F.max("n")).first()[0]
    assert rows * 4000 <= 2 * store.BATCH_BYTES
