"""Spelling variants against all neighbours one edit away, gram bounds against all edits; odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plenogrid.llm import spelling


def counted(rows, letters, least):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= least}


def brute(words, times=5):
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= shapes[(i, w[:i], w[i + 1 :])] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()}


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_variants_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(counted(rows, 6, 5))
    assert found(spelling.query(spark, sf)) == want and sum(v[1] > 0 for v in want.values()) > 50


@pytest.mark.parametrize(("letters", "prune", "dictionary"), [(6, 64, 1 << 18), (6, 2, 1 << 18), (8, 0, 40)])
def test_variants_of_dense_words(spark, letters, prune, dictionary):
    """Few letters, so that many words are near, grams are frequent and chains of forms are long."""
    r = random.Random(prune)
    pool, words = ["abcabc", "éaéaéab", "abababababab"], []
    for _ in range(900):
        w = list(r.choice(pool))
        i = r.randrange(len(w) + 1)
        w[i : i + r.randrange(2)] = r.choice(["", "a", "b", "é", "c"])
        pool.append("".join(w))
    words = [w for w in pool for _ in range(r.choice([1, 2, 5, 30, 160, 900]))]
    r.shuffle(words)
    rows = [(k, " ".join(words[i : i + 3000])) for k, i in enumerate(range(0, len(words), 3000))]
    want = brute(counted(rows, letters, 5))
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), letters=letters, prune=prune, dictionary=dictionary)) == want
    assert len(want) > 100 and sum(v[1] for v in want.values()) > 300


def test_affected_grams():
    """Every edit leaves as many grams as the bound says, of words of six letters and more; one at least."""
    r = random.Random(4)
    for _ in range(300):
        word = "".join(r.choice("abc") for _ in range(r.randrange(6, 14)))
        s = spelling.padded(word)
        frequent = {g: 1 for q in range(2, 7) for i in range(len(s) - q + 1) if r.random() < 0.6 for g in [s[i : i + q]]}
        frequent |= {"".join(r.choice("abc^$") for _ in range(r.randrange(2, 6))): 1 for _ in range(60)}
        kept, most = spelling.decompose(word, frequent)
        assert most < len(kept)
        own = Counter(s[a:b] for a, b in kept)
        edits = {word[:i] + c + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for c in ("", "a", "b", "z")}
        for other in edits - {word}:
            t = spelling.padded(other)
            assert (own & Counter(t[a:b] for a, b in spelling.decompose(other, frequent)[0])).total() >= len(kept) - most


def test_short_words_need_padding(spark):
    words = spark.createDataFrame([("ab", 9)], "word string, n long")
    with pytest.raises(Exception, match="padding"):
        spelling.gram_lists(words, {"^^": 1, "^^^": 1, "^^^a": 1, "^^^ab": 1}).collect()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 50)
    text = "Wörter und Zeichen, " * 90 + "z" * 300 + " ende"
    assert [w for found in spelling._runs(text) for w in found] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_spelling_edge_rows(spark):
    long = "z" * 3000
    rows = [(1, None), (2, ""), (3, "?! 12"), (4, "Wörter wörter WÖRTER " * 40), (4, "Wörter wörter WÖRTER " * 40), (None, "wörtér " * 6), (None, None), (5, f"{long} " * 5 + f"{long}y " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit("x").alias("word"), F.lit(2).alias("form"))
    assert found(spelling.variants(df)) == brute(counted(rows, 6, 5))
    assert spelling.variants(df.where("false")).count() == 0
