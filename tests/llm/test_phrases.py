"""Phrase mining against a plain count of all phrases, tries against dictionaries; odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid.llm import phrases


def brute(rows, support, longest, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: n for p, n in c.items() if n >= support}
        inside = defaultdict(int)
        for p, n in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], n)
        found = []
        for p, a in cand.items():
            if len(p) >= 2 and 100 * inside[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "été", "x-y", "🙂", "dog"]
    gap = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \x0b", "\xa0"]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(gap) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize(("support", "longest", "shard"), [(3, 4, 1 << 19), (12, 3, 3), (1, 4, 100)])
def test_phrases_against_all_counts(spark, support, longest, shard):
    """One trie and many, down to a support of one."""
    rows = made(support, 60 if support > 1 else 25)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(x) for x in phrases.mine(df, support, longest, shard=shard).collect())
    assert got == brute(rows, support, longest)


def test_phrases_top_and_ties(spark):
    rows = [("en", f"p{i} q{i}. " * 3) for i in range(40)]
    got = sorted(tuple(x) for x in phrases.mine(spark.createDataFrame(rows, "lang string, text string"), 3, top=7).collect())
    assert got == brute(rows, 3, 4, 7) and len(got) == 7


@pytest.mark.parametrize(("words", "n", "k"), [(3, 20, 3), (50, 3000, 4), (6000, 20000, 2), (5000, 4000, 4), (1, 1, 1)])
def test_trie(words, n, k):
    r = np.random.default_rng(n)
    spelled = np.unique(r.integers(1, 1 << 63, words).astype(np.uint64))
    phrase = np.unique(spelled[np.minimum(r.geometric(0.02 if words > 10 else 0.6, (n, k)) - 1, len(spelled) - 1)], axis=0)
    trie = phrases.build(phrase)
    text = np.concatenate([phrase[r.integers(0, len(phrase), 300)].ravel(), r.choice(spelled, 500), r.integers(1, 1 << 63, 50).astype(np.uint64)])
    link = r.random(len(text)) < 0.9
    link[-1] = False
    known = {tuple(p): i for i, p in enumerate(phrase.tolist())}
    want = [known.get(tuple(text[i : i + k].tolist()), -1) if i + k <= len(text) and link[i : i + k - 1].all() else -1 for i in range(len(text))]
    assert trie.match(text, link).tolist() == want


def test_phrases_edge_rows(spark):
    odd = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t "), ("en", "a b " * 40000), (None, "a b " * 40), ("en", "...")], "lang string, text string")
    odd = odd.select("*", F.lit(1).alias("n"), F.lit("x").alias("word"), F.lit(2).alias("h1"), F.lit(3).alias("rank"), F.lit(4).alias("doc_id"))
    got = {(r["lang"], r["phrase"]): (r["a"], r["n"]) for r in phrases.mine(odd).collect()}
    assert got[("en", "a b a b")] == (39999, 80000)
    assert got[("und", "b a b a")] == (38, 80)
    assert phrases.mine(odd.where("false")).count() == 0
    assert phrases.mine(odd.where("text is null")).count() == 0
