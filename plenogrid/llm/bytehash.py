"""Vectorised hashing of byte strings and words, shared by the corpus operators.

Every function works on one numpy buffer that holds many texts end to end, so
that the cost per text stays small.  Hashes are 64 bits wide, depend on the
bytes alone and are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(buf: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """P with P[i] = sum of table[buf[j]] * base**j over j < i."""
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(table[buf] * powers(len(buf))[0], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], which depend on content and length alone."""
    inv = powers(len(p))[1]
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(_U))


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of the buffer."""
    if len(p) <= k:
        return np.zeros(0, _U)
    return mix((p[k:] - p[:-k]) * powers(len(p))[1][: len(p) - k] + _U(k))


def windowed_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i:i+w]) for every i."""
    step, m = 1, h
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = w - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about ``size`` bytes and at most ``rows`` texts; a text is never split."""
    buf, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1), lo + rows)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LICENCE_SEPARATOR = np.zeros(256, bool)
LICENCE_SEPARATOR[:0x30] = LICENCE_SEPARATOR[0x3A:0x61] = LICENCE_SEPARATOR[0x7B:0x80] = True


def words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each text and the total).

    Texts are kept apart by the cut at every offset.  With ``lower`` A-Z are
    made lower case first.
    """
    if lower:
        buf = _LOWER[buf]
    inside = ~separator[buf]
    starts, ends = inside.copy(), inside.copy()
    if len(buf) > 1:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return buf, s, e, np.searchsorted(s, off)


_ORDER = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text with fewer words has its whole sequence as its only shingle, one
    without words none.
    """
    n = len(word)
    if n >= k:
        s = np.zeros(n - k + 1, _U)
        for j in range(k):
            s += word[j : n - k + 1 + j] * _ORDER[j]
        s = mix(s + _U(k))
    else:
        s = np.zeros(0, _U)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _ORDER[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out
