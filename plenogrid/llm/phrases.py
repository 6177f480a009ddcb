"""Phrase mining: counts by broadcast double-array tries, scores by the weakest cut.

Level by level, from single words to phrases of four:

* the candidates of a level are Apriori-safe: all their parts are frequent;
* they become double-array tries of at most ``SHARD`` phrases (so a broadcast has at
  most about 2**19 phrases, some 60 MB), a word being two digits of ``BITS`` bits;
* tasks turn texts into arrays of word hashes, and numpy advances the states of all
  text positions at once, word by word; the accepting states are counted with
  bincount, and Spark sums the tasks' counts;
* where a candidate and the one that begins a word later both accept, the phrase one
  word longer is proposed; proposals are added up by Spark, and those that reach the
  support are the next level's candidates.

Each trie is one pass over the texts; texts are not shuffled, and the passes grow
with the number of frequent phrases over ``SHARD``.  Words are compared by 64-bit
hashes of language and spelling: two of 10**7 words of one corpus collide with a
probability of 3e-6.

Defined results: a null or empty text has no words; a null language is ``und``, as
the language of that name; repeated rows count again; ids and extra columns are
ignored; ties in score and count go by the phrase's bytes; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytehash as H
from .common import materialize, table

SUPPORT, LONGEST, COVER, TOP = 30, 4, 80, 2000
#: Phrases of one broadcast trie; with at most four words each, their words fit into two digits.
SHARD, BITS = 1 << 19, 11
WIDTH = 1 << BITS
#: Proposals that a task adds up before it hands them over.
HELD = 1 << 19
#: Parts of a language that are ranked apart before the language's best are.
PARTS = 64

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"]] = True
_CUT[10:14] = True
_SEPARATOR = _CUT.copy()
_SEPARATOR[[9, 32]] = True
_NAMES = ["h1", "h2", "h3", "h4"]


@dataclass
class Trie:
    """A double-array trie of phrases of one length; the state of a first word is its symbol."""

    symbols: np.ndarray  # sorted hashes of the words
    rows: np.ndarray  # symbols of each phrase
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # phrase of an accepting state, else -1

    def match(self, word: np.ndarray, link: np.ndarray) -> np.ndarray:
        """The phrase that begins at each position, -1 where none does; link[i]: i and i + 1 are neighbours."""
        sym = np.minimum(np.searchsorted(self.symbols, word), len(self.symbols) - 1).astype(np.int32)
        known = self.symbols[sym] == word
        at = np.flatnonzero(known)
        state = sym[at]
        for j in range(1, self.rows.shape[1]):
            at, state = (x[link[at + j - 1]] for x in (at, state))
            at, state = (x[known[at + j]] for x in (at, state))
            for shift in (BITS, 0):
                to = self.base[state] + ((sym[at + j] >> shift) & (WIDTH - 1))
                good = self.check[to] == state
                at, state = at[good], to[good]
        out = np.full(len(word), -1, np.int32)
        out[at] = self.accept[state]
        return out


def build(phrases: np.ndarray) -> Trie:
    """The trie of distinct phrases, given as an n x k array of word hashes."""
    symbols = np.unique(phrases)
    if len(symbols) > WIDTH * WIDTH:
        raise ValueError("too many words for two digits")
    rows = np.searchsorted(symbols, phrases).astype(np.int32)
    first = len(symbols) + WIDTH  # slots below hold the first words
    used, base, check = np.ones(first, bool), np.zeros(first, np.int32), np.full(first, -1, np.int32)
    state = rows[:, 0].astype(np.int64)
    draw = np.random.default_rng(len(symbols))

    def extended(n: int) -> None:
        nonlocal used, base, check
        used, base, check = np.append(used, np.zeros(n, bool)), np.append(base, np.zeros(n, np.int32)), np.append(check, np.full(n, -1, np.int32))

    for j in range(1, rows.shape[1]):
        for shift in (BITS, 0):
            edge, inverse = np.unique(state * WIDTH + ((rows[:, j] >> shift) & (WIDTH - 1)), return_inverse=True)
            parent, digit = edge // WIDTH, edge % WIDTH
            begin = np.flatnonzero(np.diff(parent, prepend=-1))
            size = np.diff(np.append(begin, len(parent)))
            extended(2 * len(edge) + WIDTH)
            slot = np.empty(len(edge), np.int64)
            many = np.flatnonzero(size > 1)
            for r in many[np.argsort(-size[many], kind="stable")].tolist():  # rows of many children come first, while there is room
                i, j2 = begin[r], begin[r] + size[r]
                tried = draw.integers(first, len(used) - WIDTH, 24)
                fits = np.flatnonzero(~used[tried[:, None] + digit[i:j2]].any(1))
                if len(fits):
                    b = tried[fits[0]]
                else:
                    b = len(used) - WIDTH
                    if used[b + digit[i:j2]].any():
                        b = len(used)
                        extended(2 * WIDTH)
                    else:
                        extended(WIDTH)
                slot[i:j2] = b + digit[i:j2]
                used[slot[i:j2]] = True
                base[parent[i]] = b
            one = begin[size == 1]
            free = first + np.flatnonzero(~used[first : len(used) - WIDTH])
            free = free[free >= first + WIDTH]
            if len(free) < len(one):
                short = len(one) - len(free)
                extended(short + WIDTH)
                free = first + WIDTH + np.flatnonzero(~used[first + WIDTH : len(used) - WIDTH])
            slot[one] = free[: len(one)]
            used[slot[one]] = True
            base[parent[one]] = slot[one] - digit[one]
            check[slot] = parent
            state = slot[inverse]
    extended(WIDTH)
    accept = np.full(len(used), -1, np.int32)
    accept[state] = np.arange(len(rows))
    return Trie(symbols, rows, base, check, accept)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(hashes, links, lower-case bytes, starts, ends, first word of each text, languages) of pieces of the batch."""
    langs = batch.column("lang").to_pylist()
    salt = {x: np.frombuffer(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0] for x in set(langs)}
    salts = np.array([salt[x] for x in langs], np.uint64)
    for lo, hi, buf, off in H.chunks(batch.column("text"), 1 << 20):
        low, s, e, first = H.words(buf, off, _SEPARATOR)
        word = H.mix(H.spans(H.prefix(low), s, e) + np.repeat(salts[lo:hi], np.diff(first)))
        cuts = np.zeros(len(low) + 1, np.int32)
        np.cumsum(_CUT[low], out=cuts[1:])
        link = np.zeros(len(word), bool)
        link[:-1] = cuts[s[1:]] == cuts[e[:-1]]
        ends = first[1:]
        link[ends[ends > 0] - 1] = False
        yield word, link, low, s, e, first, langs[lo:hi]


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to the tasks in batches of so few rows that a task's memory stays small; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h1, n): the occurrences of every word of a language."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, _, low, s, e, first, langs in _tokens(batch):
                h, at, n = np.unique(word, return_index=True, return_counts=True)
                of = np.searchsorted(first, at, "right") - 1
                text = low.tobytes()
                spelled = [text[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in of.tolist()], pa.string()), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "word", "h1", "n"])

    return docs.mapInArrow(apply, "lang string, word string, h1 long, n long").groupBy("lang", "word", "h1").agg(F.sum("n").alias("n"))


def _counting(trie, k: int, whole: bool, longest: int) -> Callable:
    """A task: counts of the trie's phrases (phrase, null, n), and of those one word longer that they allow (phrase, last word, n).

    Phrases are places in the trie, last words are as well where it is whole; else they are hashes.
    """

    def out(phrase: np.ndarray, last: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 1 << 17):
            part = slice(i, i + (1 << 17))
            words = pa.nulls(len(n[part]), pa.int64()) if last is None else pa.array(last[part])
            yield pa.RecordBatch.from_arrays([pa.array(phrase[part].astype(np.int32)), words, pa.array(n[part])], ["phrase", "last", "n"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        phrase, last = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((last, phrase))
        phrase, last = phrase[order], last[order]
        new = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (last[1:] != last[:-1]))) if len(phrase) else np.zeros(0, int)
        yield from out(phrase[new], last[new], np.diff(np.append(new, len(phrase))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        total, held, size = np.zeros(len(t.rows), np.int64), [], 0
        for batch in batches:
            for word, link, *_ in _tokens(batch):
                found = t.match(word, link)
                total += np.bincount(found[found >= 0], minlength=len(total))
                if k == longest or len(word) <= k:
                    continue
                # The phrase that begins a word later can be in another trie where this one isn't whole.
                good = (found[:-k] >= 0) & link[k - 1 : -1]
                if whole:
                    good &= found[1 : len(word) - k + 1] >= 0
                at = np.flatnonzero(good)
                last = word[at + k]
                held.append((found[at], np.searchsorted(t.symbols, last) if whole else last.view(np.int64)))
                size += len(at)
                if size >= HELD:
                    yield from added(held)
                    held, size = [], 0
        if held:
            yield from added(held)
        seen = np.flatnonzero(total)
        yield from out(seen, None, total[seen])

    return apply


def _spelled(trie, k: int, whole: bool) -> Callable:
    """Rows of ``_counting`` as (k, h1 .. h4, n), absent words 0."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for batch in batches:
            phrase, n = batch.column("phrase").to_numpy(), batch.column("n")
            longer = ~batch.column("last").is_null().to_numpy(zero_copy_only=False)
            last = batch.column("last").fill_null(0).to_numpy()
            hashes = np.zeros((len(phrase), LONGEST + 1), np.uint64)
            hashes[:, :k] = t.symbols[t.rows[phrase]]
            hashes[longer, k] = t.symbols[last[longer]] if whole else last[longer].view(np.uint64)
            columns = [pa.array(np.ascontiguousarray(hashes[:, j]).view(np.int64)) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([pa.array((k + longer).astype(np.int32)), *columns, n], ["k", *_NAMES, "n"])

    return apply


def frequencies(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): all words as in ``word_counts``; (k, h1 .. h4, n) of every phrase of 1 to ``longest`` words that stands ``support`` times, absent words 0."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with _small_batches(docs.sparkSession):
        return _frequencies(docs, support, longest, shard)


def _frequencies(docs: DataFrame, support: int, longest: int, shard: int) -> tuple[DataFrame, DataFrame]:
    words = materialize(word_counts(docs))
    level = words.where(F.col("n") >= support).select("h1")
    context, counted = docs.sparkSession.sparkContext, []
    for k in range(1, longest + 1):
        shards = -(-level.count() // shard)
        found = []
        for s in range(shards):
            mine = level.where(F.pmod(F.xxhash64(*level.columns), F.lit(shards)) == s).toArrow()  # about ``shard`` phrases
            trie = build(np.stack([c.to_numpy() for c in mine.columns], 1).view(np.uint64))
            shared, whole = context.broadcast(trie), shards == 1
            sums = docs.mapInArrow(_counting(shared, k, whole, longest), "phrase int, last long, n long").groupBy("phrase", "last").agg(F.sum("n").alias("n"))
            found.append(materialize(sums.where(F.col("n") >= support).mapInArrow(_spelled(shared, k, whole), "k int, h1 long, h2 long, h3 long, h4 long, n long")))
        if not found:
            break
        both = found[0]
        for more in found[1:]:
            both = both.unionByName(more)
        counted.append(both.where(F.col("k") == k))
        level = both.where(F.col("k") == k + 1).select(*_NAMES[: k + 1])
    if not counted:
        return words, docs.sparkSession.createDataFrame([], "k int, h1 long, h2 long, h3 long, h4 long, n long")
    phrases = counted[0]
    for more in counted[1:]:
        phrases = phrases.unionByName(more)
    return words, phrases


def _times(a: Column, factor: int) -> Column:
    """An exact product beyond 64 bits."""
    return a.cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")


def mine(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, cover: int = COVER, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, counted = frequencies(docs, support, longest, shard)
    f = materialize(counted.select("k", F.slice(F.array(*_NAMES), F.lit(1), F.col("k")).alias("w"), F.col("n").alias("f")))
    phrases = f.where("k >= 2").withColumnRenamed("f", "a")
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("w", "a", "cut", F.slice("w", F.lit(1), F.col("cut")).alias("left"), F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cut = cut.join(f.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(f.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    score = F.call_function("div", _times(F.col("a"), 2_000_000), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    scored = cut.groupBy("w").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("at"))
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> slice(w, i, m))))")
    inside = phrases.where("k >= 3").select(F.explode(spans).alias("w"), F.col("a").alias("longer")).groupBy("w").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, "w", "left").where(F.col("longer").isNull() | (_times(F.col("longer"), 100) < _times(F.col("a"), cover))).select("w", "a", "at")
    kept = materialize(kept)
    spelled = kept.select("w", F.posexplode("w").alias("i", "h1")).join(words.where(F.col("n") >= support).select("h1", "lang", "word"), "h1")
    spelled = spelled.groupBy("w").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # four words at most
    rows = kept.join(spelled, "w").select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)  # PARTS * top rows at most
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the phrases of all documents."""
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : list_slice(w, i, i + k - 1))) AS g
  FROM lists, range(1, 5) AS r(k)
), f AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30
), cuts AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2
), scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, (2000000 * CAST(c.a AS HUGEINT)) // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k)
  JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, len(c.g))
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS longer
  FROM f, range(2, 4) AS ms(m), range(1, 4) AS starts(i) WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL
), kept AS (
  SELECT c.*, array_to_string(c.g, ' ') AS phrase FROM chosen c LEFT JOIN inside s ON s.lang = c.lang AND s.g = c.g
  WHERE s.longer IS NULL OR 100 * CAST(s.longer AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""
