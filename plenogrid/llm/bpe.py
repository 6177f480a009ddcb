"""Byte-level BPE encoding and decoding with a pair occurrence index.

A batch of texts is cut into its distinct pieces (the pattern of the byte-level
pre-tokenizer), whose bytes are laid out in one list.  An index maps each
mergeable pair to all places where it stands in that list.  Ranks that have
places are applied in ascending order: every place of the lowest rank is
merged, left to right, and the pairs that a merge makes are entered in the
lists of their own, always higher, ranks.  Pieces already seen by the task keep
their ids, so that a frequent piece is merged once.

The vocabulary file is a parameter; its bytes travel with the task.

Defined results: a null or empty text has no ids; strings of the special tokens
in a text become those tokens, as in the library; repeated rows get equal
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces whose ids a task keeps; it starts anew beyond.
KEPT_PIECES = 600_000
#: Bytes of text that are encoded together.
PIECE_BYTES = 2 << 20

_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_QUICK = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Numbers that are no decimal digits, and blanks of one engine only: where they stand the classes of ``re`` are not right.
_ODD = {"\x1c", "\x1d", "\x1e", "\x1f"}
_tables: list[re.Pattern] = []


def _ranges(holds) -> str:
    """The characters below U+10000 for which a test holds, as ranges of a class."""
    at = np.flatnonzero(np.diff([False, *(bool(holds(chr(c))) for c in range(0x10000)), False]))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in at.reshape(-1, 2).tolist())


def _compiled() -> list[re.Pattern]:
    """Patterns whose classes are tables of the characters below U+10000: what needs another pattern, and the pieces."""
    if not _tables:
        _ODD.update(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
        letters, digits = _ranges(lambda c: re.match(r"[^\W\d_]", c)), _ranges(lambda c: re.match(r"\d", c))
        _tables.append(re.compile(rf"[{_ranges(_ODD.__contains__)}\U00010000-\U0010ffff]"))
        _tables.append(re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{digits}]+| ?[^{_SPACE}{letters}{digits}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"))
    return _tables


def pieces(text: str) -> list[str]:
    """The pre-tokenizer's pieces of a text."""
    other, quick = _compiled()
    if not other.search(text):
        return quick.findall(text)
    if _ODD.isdisjoint(text):
        return _QUICK.findall(text)
    import regex

    if not hasattr(pieces, "full"):
        pieces.full = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    return pieces.full.findall(text)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, data: str) -> None:
        spec = json.loads(data)
        vocab: dict[str, int] = spec["model"]["vocab"]
        of = byte_symbols()
        back = {c: b for b, c in of.items()}
        self.byte_ids = np.array([vocab[of[b]] for b in range(256)], np.int64)
        self.merge: dict[int, int] = {}  # left id << 32 | right id -> rank
        self.left, self.right, self.made = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        self.pair_keys = np.array(sorted(self.merge), np.int64)
        self.pair_ranks = np.array([self.merge[k] for k in self.pair_keys.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        start = np.cumsum(size) - size
        laid = np.full(int(size.sum()), -1, np.int64)
        inside = np.ones(len(laid), bool)
        inside[start + size - 1] = False
        laid[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(laid)
        pair = laid[:-1] << 32 | laid[1:]
        at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        found = np.flatnonzero((self.pair_keys[at] == pair) & inside[:-1] & inside[1:])
        rank = self.pair_ranks[at[found]]
        order = np.argsort(rank, kind="stable")
        rank, found = rank[order], found[order].tolist()
        cut = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(rank)]
        # The pair occurrence index: rank -> places.
        places: dict[int, list[int]] = {int(rank[i]): found[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)}
        symbol = laid.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge, left, right, made = self.merge.get, self.left, self.right, self.made
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, c = left[rank], right[rank], made[rank]
            where = places.pop(rank)
            where.sort()
            for i in where:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = c, -2
                k = after[j]
                after[i] = k
                before[k] = i
                x = symbol[k]
                if x >= 0:
                    new = merge(c << 32 | x)
                    if new is not None:
                        if new in places:
                            places[new].append(i)
                        else:
                            heapq.heappush(active, new)
                            places[new] = [i]
                h = before[i]
                if h >= 0 and (x := symbol[h]) >= 0:
                    new = merge(x << 32 | c)
                    if new is not None:
                        if new in places:
                            places[new].append(h)
                        else:
                            heapq.heappush(active, new)
                            places[new] = [h]
        done = np.array(symbol, np.int64)
        alive = done >= 0
        count = np.add.reduceat(alive, start) if len(start) else np.zeros(0, np.int64)
        return done[alive].astype(np.int32), count

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Memo:
    """Ids of texts from the ids of their pieces; ``encode`` gives the ids of new pieces end to end and their numbers."""

    def __init__(self, encode, special: dict[str, int], cut: re.Pattern | None) -> None:
        self.encode, self.special, self.cut = encode, special, cut
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict = defaultdict(itertools.count().__next__)  # a new piece gets its number where it is first looked up
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for s in self.special:
            self.index[(s,)]
        self._add(np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def _add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids.astype(np.int32))

    def _keys(self, text: str) -> list:
        if not any(s in text for s in self.special):
            return pieces(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += pieces(text[at : m.start()])
            out.append((m[0],))
            at = m.end()
        return out + pieces(text[at:])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > KEPT_PIECES:
            self.clear()
        keys: list = []
        ends = []
        for t in texts:
            if t:
                keys += self._keys(t)
            ends.append(len(keys))
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        new = list(itertools.islice(reversed(self.index), len(self.index) - known))[::-1]
        try:
            for k in range(0, len(new), 50_000):
                self._add(*self.encode(new[k : k + 50_000]))
        except BaseException:
            self.clear()
            raise
        size = self.size[at]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.array([0, *ends])]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def text_lists(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Pieces of a text column of about ``size`` bytes (null: empty)."""
    from .bytehash import text_buffer

    _, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


_vocabularies: dict[str, tuple[Vocabulary, Memo]] = {}


def _loaded(data: str) -> tuple[Vocabulary, Memo]:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _vocabularies:
        v = Vocabulary(data)
        _vocabularies[key] = (v, Memo(v.encode_pieces, v.special, v.cut))
    return _vocabularies[key]


def read_vocabulary(name: str = VOCABULARY) -> str:
    """The vocabulary file's text: a path, or the name of one of the public files."""
    if "/" not in name:
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    with open(name, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per document: doc_id, ids (asked for), n_tokens, ids_sha256, decoded_sha256 and whether decoding gave the text back."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed file of about two MB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, memo = _loaded(shipped.value)
        for batch in batches:
            for lo, hi, texts in text_lists(batch.column("text")):
                found = memo.texts(texts)
                decoded = [vocab.decode(x) for x in found]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"]
                if ids:
                    columns.append(pa.array([x.tolist() for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + (", ids array<int>" if ids else "")
    return chosen.mapInArrow(apply, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = _loaded(shipped.value)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digests of the ids and of the decoded texts of all documents."""
    from .common import table

    return encode(table(spark, sf_dir, "documents"), ids=False).drop("same")
