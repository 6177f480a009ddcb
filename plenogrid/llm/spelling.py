"""Spelling variants: near words found with variable-length grams.

* Words are the runs of letters, counted over all texts.
* The gram dictionary is pruned by frequency: a gram of ``SHORTEST`` letters or more
  is extended while more than T of the words' places hold it, up to ``LONGEST_GRAM``.
  T is at least ``PRUNE`` and at least the number of places over ``DICTIONARY``, so at
  most ``DICTIONARY`` grams are frequent; these alone are broadcast.
* A padded word is decomposed: at each place the dictionary's gram, unless the one
  before reaches as far.  A gram follows from its own letters, so an edit at place i
  leaves those that end before it; beyond it, new grams can swallow those that end
  within LONGEST_GRAM.  The largest number of grams with i < end <= i + LONGEST_GRAM
  over all i is the word's affected-gram bound, and two near words share at least as
  many grams as either has beyond its bound; with the padding used, one at least.
* Of each word's grams, rarest first, only the first bound + 1 are put into inverted
  lists, by gram and length.  Words that meet in a list merge their gram lists, unless
  the letters that they hold an odd number of times differ by more than an edit
  changes; enough shared grams make a candidate, taken at the first shared gram alone,
  and the edit distance verifies it.

No list of a rare gram is longer than T, and a word's rarest grams are what it meets
others by.  Forms are followed by pointer doubling.

Defined results: a null or empty text has no words; a null id is written as the
empty text before the colon; repeated rows count again; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: A word's letters and occurrences at least, and how many times more often its form stands.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: Runs whose checksum this divides lose a letter.
DROP = 199
SHORTEST, LONGEST_GRAM, PAD = 2, 6, 3
PRUNE, DICTIONARY = 24, 1 << 20
#: Characters of a text looked at in one go, and words held by a task before they are handed over.
STEP, HELD = 1 << 20, 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words long and frequent enough."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.ascii_lower(pc.fill_null(batch.column("text"), "")), strict=True):
                own: Counter = Counter()
                for found in _runs(text.as_py()):
                    own.update(found)
                begin = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in own.items():
                    if len(run) >= letters:
                        h = zlib.crc32(run.encode(), begin)
                        if h % DROP == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                            if len(run) < letters:
                                continue
                        total[run] += n
                if len(total) >= HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def padded(word: str) -> str:
    return "^" * PAD + word + "$" * PAD


def frequent_grams(words: DataFrame, prune: int = PRUNE, dictionary: int = DICTIONARY) -> dict[str, int]:
    """The grams to extend, with their counts: ``dictionary`` at most."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column("word"):
                s = padded(word.as_py())
                for q in range(SHORTEST, LONGEST_GRAM + 1):
                    total.update([s[i : i + q] for i in range(len(s) - q + 1)])
                if len(total) >= HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    sums = materialize(words.select("word").mapInArrow(apply, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    places = sums.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in sums.where(F.col("n") > max(prune, places // dictionary)).collect()}  # fewer than ``dictionary`` rows


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """The word's grams as (begin, end) in the padded word, and how many of them an edit affects at most."""
    s = padded(word)
    n, reach, kept = len(s), 0, []
    for p in range(n - SHORTEST + 1):
        end = p + SHORTEST
        while end < n and end - p < LONGEST_GRAM and s[p:end] in frequent:
            end += 1
        if end > reach:
            kept.append((p, end))
            reach = end
    change = [0] * (n + LONGEST_GRAM + 1)
    for _, end in kept:
        change[max(0, end - LONGEST_GRAM)] += 1
        change[end] -= 1
    most = now = 0
    for i in range(n - PAD + 1):
        now += change[i]
        if i >= PAD:
            most = max(most, now)
    return kept, most


def parity(word: str) -> int:
    """A bit for each letter that the word holds an odd number of times (modulo 64); an edit changes two at most."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def gram_lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """Per word: word, n, letters, odd (``parity``), grams (rarest first), least (grams that a near word shares) and firsts, the grams to be listed."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                grams, least, firsts = [], [], []
                for word in part.column("word").to_pylist():
                    s, seen, found = padded(word), Counter(), []
                    kept, most = decompose(word, often)
                    if most >= len(kept):
                        raise ValueError("the padding is too short for words of so few letters")
                    for p, end in kept:
                        g = s[p:end]
                        found.append((often.get(g, 0), g, seen[g]))
                        seen[g] += 1
                    found.sort()
                    grams.append([f"{g}{k}" for _, g, k in found])
                    least.append(len(kept) - most)
                    firsts.append(grams[-1][: most + 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), part.column("n"), pc.utf8_length(part.column("word")).cast(pa.int32()), pa.array([parity(w) for w in part.column("word").to_pylist()], pa.int64()), pa.array(grams, pa.list_(pa.string())), pa.array(least, pa.int32()), pa.array(firsts, pa.list_(pa.string()))],
                    ["word", "n", "letters", "odd", "grams", "least", "firsts"],
                )

    return words.select("word", "n").mapInArrow(apply, "word string, n long, letters int, odd long, grams array<string>, least int, firsts array<string>")


def near_pairs(words: DataFrame, prune: int = PRUNE, dictionary: int = DICTIONARY) -> DataFrame:
    """(a, na, b, nb), once a pair: words at an edit distance of one."""
    lists = materialize(gram_lists(words, frequent_grams(words, prune, dictionary)))
    side = lists.select("word", "n", "letters", "odd", "grams", "least", F.explode("firsts").alias("gram"))
    a = side.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("letters").alias("la"), F.col("odd").alias("oa"), F.col("grams").alias("ga"), F.col("least").alias("ta"), "gram", F.explode(F.array(F.col("letters"), F.col("letters") + 1)).alias("size"))
    b = side.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letters").alias("size"), F.col("odd").alias("ob"), F.col("grams").alias("gb"), F.col("least").alias("tb"), "gram")
    both = F.array_intersect("ga", "gb")
    possible = ((F.col("la") < F.col("size")) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("oa").bitwiseXOR(F.col("ob"))) <= 2)
    candidate = (F.size(both) >= F.greatest("ta", "tb")) & (F.try_element_at(both, F.lit(1)) == F.col("gram"))
    # Nested, so that the planner keeps the cheap test before the merging of lists and that before the verification.
    near = F.when(possible, F.when(candidate, F.levenshtein("a", "b", 1) == 1).otherwise(False)).otherwise(False)
    return a.join(b, ["gram", "size"]).where(near).select("a", "na", "b", "nb")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of each (word, form): the end of its chain of forms, which must be free of circles."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("moved")))
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError("chains of forms did not end")


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, prune: int = PRUNE, dictionary: int = DICTIONARY) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = materialize(word_counts(docs, letters, occurrences))
    pairs = materialize(near_pairs(words, prune, dictionary))
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    is_form = -F.col("best.m") >= times * F.col("n")
    near = materialize(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    ends = roots(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the words of all documents."""
    return variants(table(spark, sf_dir, "documents"))
