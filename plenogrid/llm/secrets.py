"""Secret scan with a trigram index.

Native: DataFrame functions only.

* Each rule's regular expression becomes a Boolean query over trigrams of the
  lower-case text: strings that must stand in a row give all their trigrams,
  alternatives any of theirs (``trigram_query``).
* The index is a table (segment, gram, keys): for each trigram that a rule asks for,
  the sorted keys of the documents that hold it, cut into segments of about
  ``SEGMENT`` keys, so that no list grows with the corpus.
* A query is answered segment by segment: conjunctions intersect posting lists,
  alternatives unite them.  The keys that are left are the rule's candidates.
* Candidates are joined with the texts and verified by the expression itself.  Only
  texts that hold the rarest trigram of a conjunction, by the lists' lengths, are
  sent to the join.
* A rule without mandatory trigrams scans all texts where they lie, without a join.

A key is 64 bits of a hash of id and text.  Should two rows share one, more texts
are verified; the result doesn't change.

Defined results: a null or empty text holds nothing and keeps its row; repeated rows
get equal results; a null id is passed through; extra columns are ignored; an empty
table gives an empty result; two rules' spans at one start come in the order of the
rules.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as C
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table


class Rule(NamedTuple):
    """Matches of ``regex``, leftmost and non-overlapping, whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules of the contract; a run of 32 or more is the same as a run that has 32 or more.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
]
# Published forms of credentials.
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@[A-Za-z0-9]"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
]
#: Documents of one part of the index, about.
SEGMENT = 4096
#: A set of strings beyond this size is given up for what was known of it.
STRINGS, CHOICES = 32, 4

#: A query is True, a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _all(queries: list[Query]) -> Query:
    found = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not found else found[0] if len(found) == 1 else ("and", *found)


def _any(queries: list[Query]) -> Query:
    found = list(dict.fromkeys(queries))
    if True in found:
        return True
    # Of two conjunctions of trigrams the one that asks for less stands for both.
    flat = {q: {q} if isinstance(q, str) else set(q[1:]) if q[0] == "and" and all(isinstance(x, str) for x in q[1:]) else None for q in found}
    found = [q for q in found if flat[q] is None or not any(o is not None and o < flat[q] for o in flat.values())]
    return found[0] if len(found) == 1 else ("or", *found)


def _of(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """The strings that a sequence can be, or None where they are too many, and the query of what it holds."""
    exact, run, queries = True, {""}, []
    for node in nodes:
        strings, query = _node(node)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        queries.append(_of(run))
        exact, run = False, strings if strings is not None else {""}
        queries.append(query)
    if exact:
        return run, _of(run)
    return None, _all([*queries, _of(run)])


def _node(node) -> tuple[set[str] | None, Query]:
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 2 * CHOICES:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= CHOICES else (None, True)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
            return set().union(*(s for s, _ in parts)), True
        return None, _any([_of(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most != C.MAXREPEAT and sum(len(strings) ** n for n in range(least, min(most, STRINGS) + 1)) <= STRINGS and most <= STRINGS:
            out, now = set(), {""}
            for n in range(most + 1):
                out |= now if n >= least else set()
                now = {a + b for a in now for b in strings}
            return out, True
        return None, query if least else True
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(regex: str) -> Query:
    """What trigrams of the lower-case text a match of the expression needs; True where none is mandatory."""
    return _sequence(parser.parse(regex))[1]


def grams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(grams(q) for q in query[1:]))


def rarest(query: Query, often: dict[str, int]) -> set[str]:
    """Trigrams one of which stands in every match, so few texts as possible with them."""
    if isinstance(query, str):
        return {query}
    parts = [rarest(q, often) for q in query[1:]]
    return set().union(*parts) if query[0] == "or" else min(parts, key=lambda p: (sum(often.get(g, 0) for g in p), sorted(p)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): k1 is the index's key, both tell rows apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"))


def build_index(docs: DataFrame, vocabulary: set[str], segment: int = SEGMENT) -> DataFrame:
    """(segment, gram, keys) of the given trigrams over rows of ``keyed``; written once."""
    segments = max(1, -(-docs.count() // segment))
    low = docs.select("k1", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in sorted(vocabulary)]))
    rows = low.select(F.pmod("k1", F.lit(segments)).alias("segment"), "k1", F.explode(held).alias("gram"))
    return materialize(rows.groupBy("segment", "gram").agg(F.sort_array(F.collect_set("k1")).alias("keys")))  # about ``segment`` keys at most


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(k1, rules): the documents whose posting lists answer the queries, and which."""
    none = F.array().cast("array<bigint>")

    def keys(q: Query) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("lists", F.lit(q)), none)
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, [keys(x) for x in q[1:]])

    def marked(q: Query, rule: int) -> Column:
        return F.transform(keys(q), lambda k: F.struct(k.alias("k1"), F.lit(rule).alias("rule")))

    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))  # a segment's lists of the vocabulary
    found = F.flatten(F.array(*[marked(q, i) for i, q in enumerate(queries)]))
    return lists.select(F.explode(found).alias("x")).groupBy("x.k1").agg(F.collect_set("x.rule").alias("rules"))


def _matches(rules: list[tuple[int, Rule]], asked: Column | None = None) -> Column:
    """One element a match: rule, its place among the rule's matches, code points before it since the last one, its own, the group's."""

    def lengths(zipped: Column, at: int) -> Column:
        return F.transform(zipped, lambda z, i: F.struct(F.lit(at).alias("rule"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["all"]).alias("size"), F.length(z["group"]).alias("held")))

    parts = []
    for k, (at, rule) in enumerate(rules):
        # Text between matches, matches and groups come from three passes of the same expression; positions are sums of their lengths.
        zipped = F.arrays_zip(
            F.split("text", rule.regex, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)).alias("all"), F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)).alias("group")
        )
        holds = F.rlike(F.col("text"), F.lit(rule.regex))
        if asked is not None:
            holds = F.array_contains(asked, F.lit(k)) & holds
        parts.append(F.when(holds, lengths(zipped, at)).otherwise(F.array().cast("array<struct<rule:int,i:int,gap:int,size:int,held:int>>")))
    return F.flatten(F.array(*parts))


def scan(docs: DataFrame, rules: list[Rule] = BASE + MORE, segment: int = SEGMENT) -> DataFrame:
    """Per row: doc_id and spans, an array of (start, rule, kind, end) in that order; code points, end exclusive, ``rule`` its place in the list."""
    docs = keyed(docs)
    queries = [trigram_query(r.regex) for r in rules]
    indexed = [(k, r) for k, r in enumerate(rules) if queries[k] is not True]
    scanned = [(k, r) for k, r in enumerate(rules) if queries[k] is True]
    empty = docs.select("k1", "k2", F.lit(None).cast("array<struct<rule:int,i:int,gap:int,size:int,held:int>>").alias("m")).where("false")
    found = empty
    if indexed:
        asked = [queries[k] for k, _ in indexed]
        index = build_index(docs, set().union(*(grams(q) for q in asked)), segment)
        often = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}  # one row a trigram of the rules
        needed = sorted(set().union(*(rarest(q, often) for q in asked)))
        low = docs.withColumn("low", F.lower("text"))
        sent = low.where(reduce(Column.__or__, [F.contains(F.col("low"), F.lit(g)) for g in needed])).select("k1", "k2", "text")
        found = found.unionByName(sent.join(candidates(index, asked), "k1").select("k1", "k2", _matches(indexed, F.col("rules")).alias("m")))
    if scanned:
        holds = reduce(Column.__or__, [F.rlike(F.col("text"), F.lit(r.regex)) for _, r in scanned])
        found = found.unionByName(docs.where(holds).select("k1", "k2", _matches(scanned).alias("m")))
    one = found.select("k1", "k2", F.explode("m").alias("m")).select("k1", "k2", "m.*").where("size is not null").distinct()
    so_far = Window.partitionBy("k1", "k2", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    one = one.withColumn("end", end).where(F.col("held") >= least).select("k1", "k2", F.struct((F.col("end") - F.col("size")).alias("start"), "rule", kind.alias("kind"), "end").alias("span"))
    spans = one.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("span")).alias("spans"))  # of one document
    none = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return docs.select("doc_id", "k1", "k2").join(spans, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the scan of all documents, base rules first."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")

    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(BASE + MORE):
        regex = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", r.regex.split(")", 1)[1].split(")")[0]) + ")" + r.regex.split(")", 2)[2] if r.regex.startswith("(?i)") else r.regex
        regex = regex.replace("'", "''")
        parts.append(f"SELECT row, {k} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array(t, '{regex}') AS gap, regexp_extract_all(t, '{regex}', 0) AS whole, regexp_extract_all(t, '{regex}', {r.group}) AS held FROM d WHERE regexp_matches(t, '{regex}')")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), m AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT row, rule, kind, least, unnest(range(1, len(whole) + 1)) AS i, gap, whole, held FROM m
), spans AS (
  SELECT row, rule, kind, list_sum(list_transform(gap[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x : length(x))), 0) AS start, length(whole[i]) AS size
  FROM placed WHERE length(held[i]) >= least
), joined AS (
  SELECT row, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (row)
"""


ORACLE = _oracle()
