"""Corpus operators against brute force, the library and exact round trips; odd inputs for each."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import foreign
from plenogrid.llm import ann, bpe, licences, mixture, neardup, quality, registry, repeats, tokenfile, vectordup, webtext
from plenogrid.llm.common import components

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b c d"), (6, "word " * 30000), (7, "é🙂 \x00 z"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, clashing extra columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", F.lit("s").alias("source"), F.lit(1).alias("size"), F.lit(2).alias("component_id"), F.lit(3).alias("n_tokens"), F.lit(4).alias("row_id"), F.lit(5).alias("hash"), F.lit("x").alias("lang"))


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# op4


def removal(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return out


COLUMNS4 = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_on_documents(spark, sf, docs):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS4) for r in repeats.query(spark, sf).collect()}
    want = rows(docs)
    assert got == dict(zip((i for i, _ in want), removal([(t or "").encode() for _, t in want]), strict=True))


def test_repeats_on_odd_texts(spark):
    r = random.Random(1)
    rnd = lambda n, k=4: "".join(r.choice("abcdeé"[:k]) for _ in range(n))
    base = rnd(900)
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 1500, base, base[:350] + "X" + base[350:], rnd(50) + base[100:301] + rnd(60), base, rnd(3000, 2), "ab" * 600, rnd(100) + "é" * 300, "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["row"]["doc_id"]: tuple(x[c] for c in COLUMNS4) for x in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == removal([(t or "").encode() for t in texts])


@pytest.mark.parametrize("length", [2, 7, 40, 300])
def test_repeats_of_other_lengths(spark, length):
    """From one doubling to several; passages that stand in many texts with other neighbours on both sides."""
    r = random.Random(length)
    rnd = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = rnd(length + 30)
    texts = [rnd(r.randrange(2 * length)) + passage[k % 5 :] + rnd(r.randrange(2 * length)) for k in range(40)] + [rnd(3 * length), "ab" * length, passage[:-40]]
    got = {x["row"]["doc_id"]: tuple(x[c] for c in COLUMNS4) for x in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length).collect()}
    assert [got[i] for i in range(len(texts))] == removal([t.encode() for t in texts], length)


def test_repeats_leave_no_table(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    repeats.remove_repeats(odd).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_repeats_edge_rows(odd):
    assert repeats.remove_repeats(odd).count() == len(ODD)
    assert repeats.without_repeats(odd).columns == odd.columns
    assert repeats.remove_repeats(odd.where("false")).count() == 0


# op5


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows_):
    sets = {i: shingle_set(t) for i, t in rows_}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for h in s for j in holders[h])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for h in s:
            holders[h].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_on_documents(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.query(spark, sf).collect()}
    assert got == near(rows(docs))


def test_near_duplicates_chain_and_group(spark):
    """Copies of copies: ends of a chain are unlike, and many copies of one text differ from each other."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    data, w = [], list(base)
    for i in range(12):
        data.append((i, " ".join(w)))
        w[(i * 9) % 120] = word()
    for i in range(100, 160):
        v = list(base)
        for _ in range(2):
            v[r.randrange(120)] = word()
        data.append((i, " ".join(v)))
    data += [(500, "Only four words here"), (501, "only FOUR words here"), (502, "only four words")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == near(data)


@pytest.mark.parametrize("part", [256, 7])
def test_near_duplicates_in_a_dense_group(spark, monkeypatch, part):
    """Texts about the threshold from each other: stars leave many components, which the cells must join."""
    monkeypatch.setattr(neardup, "PART", part)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    data = []
    for i in range(90):
        v = list(base)
        for _ in range(r.choice([2, 3, 3, 4, 5])):
            v[r.randrange(150)] = word()
        data.append((i, " ".join(v)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(df).collect()}
    assert got == near(data)


def test_near_duplicates_edge_rows(odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got if r["doc_id"] != 4)
    assert neardup.near_duplicates(odd.where("false")).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.count() == len(ODD) - 1


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


# op3


def test_mixture_matches_sql(spark, sf):
    got = mixture.query(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(mixture.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert all((got[c] == want[c]).all() for c in want.columns) and len(got) == len(want)


def test_mixture_caps_and_targets(spark):
    data = [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w " * 10, "b") for i in range(10)] + [(2000 + i, "w " * 7, None) for i in range(60)] + [(3000, None, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixture.assignments(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby(got.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 10
    assert got[got.source == "b"].target.iloc[0] == 300.0
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns and mixed.where("source = 'b'").count() == 30


def test_mixture_edge_rows(odd):
    assert mixture.assignments(odd).count() == len(ODD)
    assert mixture.mix(odd).columns == odd.columns
    assert mixture.assignments(odd.where("false")).count() == 0 and mixture.mix(odd.where("false")).count() == 0


# op6 and op7


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def strange():
    r = random.Random(3)
    alphabet = "ab cde  \n\t\x1c\x1f\x85\xa0é²½Ⅷ٣一'sS'll_-!?.,🙂́​ 12345 \r\n\x00"
    out = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(400)]
    return out + [(5000, None), (5001, ""), (5002, "<|endoftext|>"), (5003, "x<|endoftext|><|endoftext|> y"), (5004, "a" * 5000), (5005, " " * 300 + "x")]


def digests(library, data):
    out = {}
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        a = np.array(ids, "<u4")
        out[i] = (len(a), hashlib.sha256(a.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_bpe_equals_the_library(spark, sf, docs, library, strange):
    for df, data in ((docs, rows(docs)), (spark.createDataFrame(strange, "doc_id long, text string"), strange)):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(df, ids=False).collect()}
        assert got == digests(library, data)


def test_bpe_round_trip(spark, strange):
    df = spark.createDataFrame(strange, "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in strange}


def test_bpe_edge_rows(odd):
    assert bpe.encode(odd).count() == len(ODD) and bpe.encode(odd.where("false")).count() == 0


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_token_file_round_trip(spark, library, strange, tmp_path, layout):
    path = str(tmp_path / "ids")
    tokenfile.write(spark.createDataFrame(strange, "doc_id long, text string"), path, layout=layout)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in tokenfile.read(spark, path).collect()}
    start = 0
    for i, t in sorted(strange):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)


def test_token_file_on_documents(spark, sf, docs, library):
    """Every row of the table: the cut into pieces gives the ids that the library gives for the whole text."""
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.query(spark, sf).collect()}
    start = 0
    for i, t in sorted(rows(docs)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got.pop(i) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_file_edge_rows(spark, odd, tmp_path):
    tokenfile.write(odd, str(tmp_path / "a"))
    assert tokenfile.read(spark, str(tmp_path / "a"), ids=False).count() == len(ODD)
    tokenfile.write(odd.where("false"), str(tmp_path / "b"))
    assert tokenfile.read(spark, str(tmp_path / "b")).count() == 0


# op8


def test_licences_match_sql(spark, sf):
    got = licences.query(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(licences.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert all(((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() for c in want.columns) and len(got) == len(want)


def test_licences_cases(spark):
    data = [
        (1, "Released UNDER the MIT-License. x"), (2, "under the mit license under the MIT license"), (3, "licence under the permit license"), (4, "Licensed under the Apache License, Version 2.0"),
        (5, "A text.\nThis work is licensed under the GNU General Public License, version 2\nmore"), (6, "CC BY\nNC"), (7, "the under mit license"),
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string"), spans=True).collect()}
    assert [got[i]["n_base"] for i in range(1, 8)] == [1, 2, 0, 1, 0, 1, 0]
    assert (got[2]["first_word"], got[2]["last_word"]) == (0, 4)
    assert got[6]["labels"] == "cc-by-nc" and got[3]["labels"] == ""
    assert got[5]["labels"] == got[7]["labels"] == "" and got[5]["score"] == 0  # no notice, and the telling words are not enough of one


def test_whole_notices(spark):
    whole = {label: text for label, text, _ in licences.NOTICES}

    def wrapped(text, n=9, sign="\n * "):
        w = text.split()
        return "/*" + sign.join(" ".join(w[i : i + n]) for i in range(0, len(w), n)) + ". */ More. Text."

    clean = [
        "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "Released under the Apache License.", "licence text the under mit license",
        "This work is licensed under the GNU General Public License, version 2",
        wrapped(whole["gpl-3"].replace("version 3", "version 2")), wrapped(whole["gpl-3"].replace("gnu general", "gnu lesser general")),
        wrapped(whole["cc-by-nc"].replace("noncommercial", "noncommercial sharealike")), wrapped(whole["cc-by-nc"].replace("noncommercial 4 0", "4 0")),
        wrapped(whole["mpl-2"].replace("v 2 0", "v 1 1")), " filler text here ".join(sorted(set(whole["mit"].split()))),
    ]
    real = [(label, "x " * 300 + wrapped(text) + " y" * 300) for label, text in whole.items()]
    real += [
        ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("bsd", wrapped(whole["bsd"].replace("redistributions of", "1. Redistributions of").replace("redistributions in", "\n\n2. Redistributions in"))), ("apache-2", "Licensed under the Apache\nLicense, Version 2.0"),
    ]
    data = [(i, t) for i, t in enumerate([*clean, *(t for _, t in real)])]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string"), spans=True).collect()}
    assert [got[i]["labels"] for i in range(len(clean))] == [""] * 5 + ["gpl-2", "lgpl-3"] + [""] * 4  # relatives get their own label or none
    assert [got[len(clean) + i]["labels"] for i in range(len(real))] == [label for label, _ in real]
    assert all(got[len(clean) + i]["matches"][0]["first"] == 300 for i in range(len(whole)))


def test_licences_of_notices_match_sql(spark):
    """Whole, wrapped, shortened and mixed notices, which the tables lack."""
    r = random.Random(6)
    texts = []
    for _, text, _ in licences.NOTICES:
        w = text.split()
        texts += [text, "a b " * 50 + "\n// ".join(w) + " c" * 99, " ".join(w[: len(w) * 9 // 10]), " ".join(x for x in w if r.random() < 0.9), " ".join(w[: len(w) // 2]), text + " then " + licences.NOTICES[0][1]]
        k = len(w) // 2
        texts.append(" ".join(w[:k]) + " z" * r.randint(5, 60) + " " + " ".join(w[k:]))
    df = spark.createDataFrame(list(enumerate([*texts, None, "released under the BSD license"])), "doc_id long, text string")
    got = licences.scan(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(licences.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert all(((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() for c in want.columns) and (got.labels != "").sum() >= 40
    assert got.labels.iloc[-1] == ""


def test_licences_edge_rows(odd):
    assert licences.scan(odd).count() == len(ODD) and licences.scan(odd.where("false")).count() == 0


# op9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.95 and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_solver_against_projected_gradients():
    """The dual of the hinge loss with a constant feature, solved another way, and the log-count ratios by hand."""
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 40, r.integers(2, 12))) for _ in range(60)]
    y = np.array([int(x[0] < 9) ^ int(r.random() < 0.15) for x in rows])
    model = quality.fit(rows, y, rounds=3000)
    dense = np.zeros((60, 40))
    for k, x in enumerate(rows):
        dense[k, x] = 1
    p, q = 1 + dense[y > 0].sum(0), 1 + dense[y == 0].sum(0)
    rest = quality.COLUMNS - 40
    ratio = np.log(p / (p.sum() + rest)) - np.log(q / (q.sum() + rest))
    u = dense * ratio
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    z = np.where(y > 0, 1.0, -1.0)[:, None] * np.column_stack([u, np.ones(60)])
    alpha, gram = np.zeros(60), z @ z.T
    for _ in range(40000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, 2.0)
    w = alpha @ z
    assert np.abs(model.weight[:40] - w[:40] * ratio).max() < 0.02 and abs(model.intercept - w[40]) < 0.02
    assert np.allclose(model.scale[:40], ratio**2)


def test_quality_scores_against_single_texts(spark, docs):
    """Scores of the table against features taken text by text, and packed features come back whole."""
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, t in rows(docs):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        columns = quality.features(raw, np.array([0, len(raw)]))
        assert (quality._unpack(quality._pack(columns)) == columns).all()
        total = model.weight[columns].sum() / max(1e-12, np.sqrt(model.scale[columns].sum())) + model.intercept
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9
    for n in (4095, 4096, 65536):
        assert (quality._unpack(quality._pack(np.arange(n))) == np.arange(n)).all()


def test_quality_kinds_within_the_training_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.cross_validate(docs, labels) > 0.95
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.cross_validate(docs, turned) == quality.cross_validate(docs, labels)  # labels of the held-out fold play no part


def test_quality_edge_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    for labels in (none, one):
        got = quality.score(odd, quality.train(odd, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(odd, quality.train(odd, one)).columns == odd.columns
    assert quality.score(odd.where("false"), quality.train(odd.where("false"), none)).count() == 0


# op1 and op10


def vectors(spark, n=400, dim=16, seed=5):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[50:80] = x[49] + 0.05 * r.standard_normal((30, dim)).astype(np.float32)
    x[80:100] = x[79]
    x[101] = 3 * x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [None] * dim), (1080, [1.0, 2.0]), (None, [1.0] * dim), (1100, [float("inf")] + [1.0] * (dim - 1))]
    return x.astype(float), spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("block", F.lit("x"))


def test_nearest_neighbours(spark):
    x, df = vectors(spark)
    got = defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for i, v in found.values())
        hit += len(set(order) & {i for i, _ in found.values()})
    assert hit >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0, None])
def test_nearest_neighbours_of_unequal_length(spark, spread):
    """Lengths times lognormal(spread), or a single row that is three times longer."""
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if spread is None:
        x[7] *= 3
    else:
        x *= r.lognormal(0, spread, (len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for row in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        found[row["query_id"]].append(row["vec_id"])
    hit = 0
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(1)
        assert found[q] == sorted(found[q], key=lambda i: (-s[i], i)) and len(set(found[q])) == 20
        hit += len(set(found[q]) & set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]))
    assert hit >= 0.95 * 20 * len(range(0, len(x), 20))


def test_nearest_neighbours_of_repeated_rows(spark):
    """Rows that repeat an id ask once, and equal scores go by id."""
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[0].tolist())] + [(i, x[30].tolist()) for i in (97, 95, 96)]
    got = [(v["rank"], v["vec_id"]) for v in ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=63).orderBy("rank").collect()]
    s = dict(enumerate(x @ x[0])) | {i: x[30] @ x[0] for i in (95, 96, 97)}
    assert got == [(k + 1, i) for k, i in enumerate(sorted((i for i in s if i), key=lambda i: (-s[i], i)))]


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_share_of_verified_rows(scale):
    """On full blocks a few percent are verified, and at least nine of ten neighbours are among them."""
    r = np.random.default_rng(9)
    x = r.standard_normal((ann.BLOCK, 64))
    x *= (1 + scale * (ann.RATIO - 1) * r.random((ann.BLOCK, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    found = list(ann.Index(x).candidates(x[:100], 21))
    best = np.argsort(-(x[:100] @ x.T), axis=1)[:, :21]
    assert np.mean([len(f) for f in found]) <= 0.06 * ann.BLOCK
    assert np.mean([len(set(f) & set(b)) / 21 for f, b in zip(found, best, strict=True)]) >= 0.95


def test_nearest_neighbours_few_rows(spark):
    _, df = vectors(spark)
    few = df.where("vec_id in (0, 1, 2, 1000)")
    assert [(r["query_id"], r["rank"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("part", [2048, 16])
def test_vector_near_duplicates(spark, monkeypatch, part):
    monkeypatch.setattr(vectordup, "PART", part)
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near_ = u @ u.T >= 0.9
    np.fill_diagonal(near_, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *[root[j] for j in np.flatnonzero(near_[i])]]) for i in range(len(x))]
        if new == root:
            break
        root = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectordup.near_duplicates(df).collect()}
    for i in range(len(x)):
        assert got[i] == (int(near_[i].sum()), root[i], root[i] == i)
    assert got[1000] == (0, 1000, True) and got[1040] == (0, 1040, True) and got[None] == (0, None, True)
    assert vectordup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_vector_near_duplicates_on_embeddings(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near_ = u @ u.T >= 0.9
    np.fill_diagonal(near_, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near_, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectordup.query(spark, sf).collect()}
    assert got == {int(i): (int(n), int(ids[k]), int(ids[k]) == int(i)) for i, n, k in zip(ids, near_.sum(1), root, strict=True)}


def test_bands_grow_with_the_logarithm():
    for n in (2000, 10**6, 10**9, 10**12):
        bits, bands = vectordup.banding(n)
        assert n / 2**bits <= 512 or bits == 30
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** bands <= vectordup.MISSED


def test_links_just_above_the_threshold_are_found(spark):
    """5,000 pairs at a cosine of 0.9001; with 40 bands one of 900 missed every band."""
    r = np.random.default_rng(1)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.standard_normal((2, 5000, 64)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    classes = spark.createDataFrame([(2 * i + k, v.tolist()) for i, p in enumerate(zip(x, y, strict=True)) for k, v in enumerate(p)], "rep long, vector array<double>")
    got = {(p["a"], p["b"]) for p in vectordup.links(classes, 64).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(5000)} <= got


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_embeddings_have_their_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hit = total = 0
    found = defaultdict(set)
    for r in ann.query(spark, sf).collect():
        found[r["query_id"]].add(r["vec_id"])
    for q, got in found.items():
        s = x @ x[list(ids).index(q)]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit, total = hit + len(got & set(best)), total + len(best)
    assert hit / total >= 0.9


# op2


def test_page_text(spark, sf):
    got = webtext.query(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)


class Article(HTMLParser):
    """Another reading of the pages: the blocks within <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text, self.found = False, [], []

    def flush(self):
        own, self.text = " ".join("".join(self.text).split()), []
        if own and self.inside:
            self.found.append(own)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag != "b":
            self.flush()
            self.inside = self.inside or tag == "article"

    def handle_endtag(self, tag):
        if tag != "b":
            self.flush()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.text.append(data)


def test_pages_against_a_parser(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in webtext.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.flush()
        assert got[r["page_id"]] == "\n\n".join(parser.found)


def precision_and_recall(pages):
    weights, change = webtext.train()
    good = found = true = 0
    for page, article in pages:
        blocks = webtext.blocks(page, weights)
        for (text, _), y in zip(blocks, webtext.viterbi([score for _, score in blocks], change), strict=True):
            good, found, true = good + (y and text in article), found + y, true + (text in article)
    return good / found, good / true


def test_labelled_pages_held_out():
    assert min(precision_and_recall(webtext.labelled_pages(100, seed=77))) >= 0.97


@pytest.mark.parametrize("layout", foreign.LAYOUTS)
def test_foreign_layouts(layout):
    """Pages with other class names, languages and nesting than the training pages have."""
    assert min(precision_and_recall(foreign.pages(layout, 60))) >= 0.9


def test_block_scores_are_sums_of_feature_weights():
    weights, _ = webtext.train()
    for page, _ in webtext.labelled_pages(20, seed=3):
        for (a, features), (b, score) in zip(webtext.blocks(page), webtext.blocks(page, weights), strict=True):
            assert a == b and score == pytest.approx(sum(weights.get(f, 0) for f in features), abs=1e-9)


@pytest.mark.parametrize("markup", ["<div class=a>x", "<b class=a>x<p>", "<i>x<div>", '<p class="x>text', "<ul><li>x", '<a "', "</b></div>x<br>", "<b><i></b>"])
def test_time_is_linear_in_open_tags(markup):
    weights, change = webtext.train()

    def seconds(n):
        start = time.process_time()
        webtext.main_text(markup * n, weights, change)
        return time.process_time() - start

    seconds(1000)
    assert seconds(80000) < 8 * max(0.1, seconds(20000))


def test_page_cases(spark):
    pages = [
        (1, "u", "<html><body><nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>First  paragraph\nof the text.<p>Second <b>one</b> here.<br></article><div class='comments'><p>I was here first.</p></div><footer>&copy; x</footer>", None),
        (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>cut off in a <a hre", "y"), (4, "u", "<p>cut off in a <a hre", "y"),
    ]
    got = {r["page_id"]: r for r in webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Title & more\n\nFirst paragraph of the text.\n\nSecond one here." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["text"] == ""
    assert webtext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "markup",
    [
        "<video-js id=x></video-js>", "<audio-player src=x></audio-player>", "<svg-icon></svg-icon>", "<object-view></object-view>", "<svg class=i/>", "<svg class='i' />",
        "<svg><path d=x>", "<object data=x>", "<iframe src=x>", "<svg/><svg><text>no</text></svg>", "<svg><svg><text>no</text></svg><text>no</text></svg>", "<script>'<p>no</p>'</script>",
        "<STYLE>p > a {}</STYLE >", "<svg><!-- <svg> --><text>no</text></svg>", "<script>'<svg>'</script><svg>no</svg>", "<noscript><p>no</p></noscript>", "<object><object><p>no</p></object><p>no</p></object>", "<video controls><p>no</p></video>",
    ],
)
def test_page_keeps_what_follows_raw_elements(markup):
    assert [t for t, _ in webtext.blocks(f"<article><p>A</p>{markup}<p>B</p></article><svg></svg>")] == ["A", "B"]


def test_page_raw_elements_cut_off():
    assert [t for t, _ in webtext.blocks("<title-bar>T</title-bar><p>B</p><script>x = '<p>no</p>'")] == ["T", "B"]
    assert [t for t, _ in webtext.blocks("<p>A</p>" + "<object><iframe>" * 20000 + "<p>B</p>")] == ["A", "B"]


def test_viterbi_is_the_best_path():
    r = random.Random(9)
    for _ in range(50):
        n = r.randint(1, 7)
        s, c = [r.uniform(-3, 3) for _ in range(n)], tuple(r.uniform(-2, 2) for _ in range(4))
        value = lambda y: sum(a for a, b in zip(s, y, strict=True) if b) + sum(c[2 * a + b] for a, b in zip(y, y[1:]))  # noqa: E731, B023, B905
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert value(webtext.viterbi(s, c)) == pytest.approx(value(best))


# pipeline


def test_pipeline_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = got
        got = stage(spark, before, sf)
        got = corpus_pipeline.materialize(got)
        if k == 0:
            model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r["doc_id"] for r in quality.score(before, model).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in got.collect()} == want
        if k == 1:
            assert {r["doc_id"] for r in got.collect()} == {i for i, (_, _, kept) in near(rows(before)).items() if kept}
        if k == 2:
            data = rows(before)
            cut = dict(zip((i for i, _ in data), removal([(t or "").encode() for _, t in data]), strict=True))
            assert all(hashlib.sha256(t.encode()).hexdigest() == cut[i][3] for i, t in rows(got))
        if k < 4:
            assert got.columns == docs.columns
        if k == 3:
            taken = {r["doc_id"]: r["taken"] for r in mixture.assignments(before).collect()}
            size = {r["doc_id"]: r["size"] for r in mixture.assignments(before).collect()}
            assert {r["doc_id"] for r in got.collect()} >= {i for i, n in taken.items() if n and size[i]}
    assert got.count() == before.count()  # what goes into the last stage, encoded
    assert {(r["doc_id"], r["n_tokens"]) for r in got.collect()} == {(r["doc_id"], r["n_tokens"]) for r in bpe.encode(before, ids=False).collect()}


def test_pipeline_on_odd_rows(spark, odd, sf):
    """Nulls, blanks, a long text, repeated rows and clashing columns through all stages; then no rows at all."""
    got = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for df in (got, got.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = df
            df = corpus_pipeline.materialize(stage(spark, df, sf))
            assert k == 4 or df.columns == before.columns
            if k in (0, 1):
                assert df.count() <= before.count()
            if k in (2, 4):
                assert df.count() == before.count()


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
