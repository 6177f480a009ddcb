"""Licence scan: phrases, and an exact containment join with whole licence notices.

The blocks of a text are all its windows of words a quarter longer than a notice,
so that line ends, comment signs, clause numbers and full stops don't split one.
A window matches a notice when it contains at least ``THRESHOLD`` of the notice's
distinct words, and the phrases that tell the licence from its relatives (name,
variant, version) stand in it too.  The join is exact and filters before it
counts:

* one pass counts in how many documents each notice word stands, over all
  documents, and orders every notice's words from rare to common;
* prefix filter: a window that lacks all of the first n - ceil(t n) + 1 words of
  a notice can't contain enough of it; an inverted index of these words gives the
  notices to think of, and only the windows about such a word are candidates;
* length filter: nor can a window at a text's end with fewer than ceil(t n) words;
* positional filter: of the words from the rarest shared one on, enough must stand
  in the stretch of windows about it.

What is left is slid over word by word.  Notices are a parameter of fixed size;
texts are streamed, without a shuffle of them.

Defined results: a null or empty text has no words, empty labels and score 0;
repeated rows get equal results; a null id is passed through; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as H

# The phrases of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.8
# The usual notices of some licences: label, text and the phrases that tell the licence from its relatives.
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge", "rights to use copy modify merge publish distribute sublicense and or sell"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0",),
    ),
    (
        "cc-by-nc",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0",
        ("attribution noncommercial 4 0 international",),
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license v 2 0",),
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "lgpl-3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ("gnu lesser general public license", "version 3 of the license"),
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        ("gnu affero general public license", "version 3 of the license"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages",
        ("permission to use copy modify and or distribute this software", "hereby granted"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "cc-by-sa",
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
        ("attribution sharealike 4 0 international",),
    ),
]

def _hash(word: str) -> np.uint64:
    buf = np.frombuffer(word.encode(), np.uint8)
    return H.spans(H.prefix(buf), np.array([0]), np.array([len(buf)]))[0]


def _scan(column: pa.Array) -> Iterator[tuple]:
    """(first row, end row, lower-case bytes, word starts, ends, hashes, first word of each text)."""
    for lo, hi, buf, off in H.chunks(column):
        low, s, e, first = H.words(buf, off, H.LICENCE_SEPARATOR)
        yield lo, hi, low, s, e, H.spans(H.prefix(low), s, e), first


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each of the given words stands."""
    hashes = np.array([_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for lo, hi, _, _, _, word, first in _scan(batch.column("text")):
                at = np.minimum(np.searchsorted(hashes[order], word), len(order) - 1)
                hit = np.flatnonzero(hashes[order][at] == word)
                row = np.repeat(np.arange(hi - lo), np.diff(first))[hit]
                total += np.bincount(np.unique(row * len(order) + order[at[hit]]) % len(order), minlength=len(order))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(apply, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    found = {vocabulary[r["word"]]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in vocabulary}


def width(text: str) -> int:
    """Words of the windows that are held against a notice."""
    return 5 * len(text.split()) // 4


def needs(n: int, threshold: float) -> int:
    """How many of a notice's n distinct words a window must hold."""
    return ceil(threshold * n - 1e-9)


def _window(own: list[str], words: list[str], need: int, width: int, phrases: tuple[str, ...]) -> tuple[int, int, int] | None:
    """(shared, first, last) of the fullest window that holds ``need`` of the words and all phrases."""
    stands: list[list[tuple[int, int]]] = []
    for p in (p.split() for p in phrases):
        stands.append([(i, i + len(p) - 1) for i in range(len(own) - len(p) + 1) if own[i] == p[0] and own[i : i + len(p)] == p])
    if not all(stands):
        return None
    wanted, inside, best = set(words), {}, None
    at = [i for i, w in enumerate(own) if w in wanted]
    lo = 0
    for j in at:
        inside[own[j]] = inside.get(own[j], 0) + 1
        while at[lo] <= j - width:
            w = own[at[lo]]
            inside[w] -= 1
            if not inside[w]:
                del inside[w]
            lo += 1
        if len(inside) >= need and (best is None or len(inside) > best[0]) and all(any(at[lo] <= a and b <= j for a, b in s) for s in stands):
            best = len(inside), at[lo], j
    return best


def scan(docs: DataFrame, notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, asked for, matches.

    ``matches`` lists (label, first word, last word, containment) of the fullest
    matching window of each stretch of text.  ``score`` is the largest containment,
    1 where a phrase stands, else 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    widths = [width(text) for _, text, _ in notices]
    sets = [(label, sorted(set(text.split()))) for label, text, _ in notices]
    often = frequencies(docs, sorted({w for _, ws in sets for w in ws}))
    ordered = [(label, sorted(ws, key=lambda w: (often[w], w))) for label, ws in sets]
    needed = [needs(len(ws), threshold) for _, ws in ordered]
    leads: dict[str, list[int]] = {}
    for t, ((_, ws), need) in enumerate(zip(ordered, needed, strict=True)):
        for w in ws[: len(ws) - need + 1]:
            leads.setdefault(w, []).append(t)
    lead_words = sorted(leads)
    lead_hash = np.sort(np.array([_hash(w) for w in lead_words], np.uint64))
    notice_hash = [np.array([_hash(w) for w in ws], np.uint64) for _, ws in ordered]
    words_of = [(p.split(), np.array([_hash(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, low, s, e, word, first in _scan(batch.column("text")):
                n = hi - lo
                count, a, b = np.zeros(n, np.int64), [None] * n, [None] * n
                base: list[set] = [set() for _ in range(n)]
                more: list[set] = [set() for _ in range(n)]
                best, found = [0.0] * n, [[] for _ in range(n)]

                def spelled(i: int) -> str:
                    return low[s[i] : e[i]].tobytes().decode("utf-8", "replace")

                for ws, hs, label in words_of:
                    k = len(ws)
                    if len(word) < k:
                        continue
                    hit = word[: len(word) - k + 1] == hs[0]
                    for j in range(1, k):
                        hit &= word[j : len(word) - k + 1 + j] == hs[j]
                    for i in np.flatnonzero(hit).tolist():
                        r = int(np.searchsorted(first, i, "right")) - 1
                        if i + k > first[r + 1] or [spelled(i + j) for j in range(k)] != ws:
                            continue
                        count[r] += 1
                        i -= int(first[r])
                        a[r] = i if a[r] is None else min(a[r], i)
                        b[r] = i if b[r] is None else max(b[r], i)
                        base[r].add(label)
                        best[r] = 1.0
                if len(word):
                    at = np.minimum(np.searchsorted(lead_hash, word), len(lead_hash) - 1)
                    stretches: dict[tuple[int, int], list[list[int]]] = {}
                    for x in np.flatnonzero(lead_hash[at] == word).tolist():
                        r = int(np.searchsorted(first, x, "right")) - 1
                        for t in leads.get(spelled(x), ()):
                            i, j = max(int(first[r]), x - widths[t] + 1), min(int(first[r + 1]), x + widths[t])
                            known = stretches.setdefault((r, t), [])
                            if known and i <= known[-1][1]:
                                known[-1][1] = j
                            else:
                                known.append([i, j])
                    for (r, t), known in stretches.items():
                        label, ws = ordered[t]
                        for i, j in known:
                            if j - i < needed[t]:  # too short
                                continue
                            shared = np.isin(notice_hash[t], word[i:j])
                            if len(ws) - int(shared.argmax()) < needed[t] or shared.sum() < needed[t]:  # too few from the rarest shared one on
                                continue
                            hit = _window([spelled(x) for x in range(i, j)], ws, needed[t], widths[t], notices[t][2])
                            if hit:
                                more[r].add(label)
                                best[r] = max(best[r], hit[0] / len(ws))
                                found[r].append({"label": label, "first": i + hit[1] - int(first[r]), "last": i + hit[2] - int(first[r]), "containment": hit[0] / len(ws)})
                columns = [
                    batch.column("doc_id").slice(lo, n),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(count),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()),
                    pa.array(best, pa.float64()),
                ]
                if spans:
                    columns.append(pa.array(found, matches))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    matches = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(apply, schema + (", matches array<struct<label:string,first:bigint,last:bigint,containment:double>>" if spans else ""))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the scan of all documents."""
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    hits = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        hits.append(f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i : {test})) - 1 AS place, '{label}' AS label FROM d")
    notices, words_of, tells = [], [], []
    for t, (label, text, telling) in enumerate(NOTICES):
        ws = sorted(set(text.split()))
        notices.append(f"({t}, '{label}', {len(ws)}, {needs(len(ws), THRESHOLD)}, {width(text)})")
        words_of += [f"({t}, '{w}')" for w in ws]
        tells += [f"({t}, {k}, {p.split()!r})" for k, p in enumerate((telling * 2)[:2])]
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lower}, {words}) AS w FROM documents
), hits AS ({" UNION ALL ".join(hits)}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hits GROUP BY doc_id
), notices(t, label, n, need, width) AS (VALUES {", ".join(notices)}),
notice_words(t, word) AS (VALUES {", ".join(words_of)}),
tells(t, k, phrase) AS (VALUES {", ".join(tells)}),
possible AS (
  SELECT doc_id, t, w FROM d, (SELECT t, list(word) AS ws FROM notice_words GROUP BY t) JOIN notices USING (t) WHERE len(list_intersect(w, ws)) >= need
), spread AS (
  SELECT doc_id, t, w, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM possible
), placed AS (
  SELECT doc_id, t, word, pos,
         max(CASE WHEN k = 0 AND list_slice(w, pos - len(phrase) + 1, pos) = phrase THEN pos - len(phrase) + 1 END) AS tell0,
         max(CASE WHEN k = 1 AND list_slice(w, pos - len(phrase) + 1, pos) = phrase THEN pos - len(phrase) + 1 END) AS tell1
  FROM spread JOIN notice_words USING (t, word) JOIN tells USING (t) GROUP BY doc_id, t, word, pos
), windows AS (
  SELECT p.doc_id, p.t, p.pos, count(DISTINCT q.word) AS shared, max(q.tell0) AS tell0, max(q.tell1) AS tell1
  FROM placed p JOIN notices USING (t) JOIN placed q ON q.doc_id = p.doc_id AND q.t = p.t AND q.pos BETWEEN p.pos - width + 1 AND p.pos GROUP BY p.doc_id, p.t, p.pos
), more AS (
  SELECT doc_id, label, max(shared / n) AS score FROM windows JOIN notices USING (t)
  WHERE shared >= need AND tell0 >= pos - width + 1 AND tell1 >= pos - width + 1 GROUP BY doc_id, label
), labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT doc_id, label, 1.0 AS score, true AS base FROM hits UNION ALL SELECT doc_id, label, score, false FROM more) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


ORACLE = _oracle()
