"""Embedding near-deduplication with rotated binary codes and stored corrections.

Vectors of the same components are one class; only classes are compared.  A
class's unit vector is turned by random rotations, and the signs are its code
(the method of Gao and Long 2024).  Stored beside the code: f, the inner product of the unit vector and
its code, and the turned vector in eight bits a component.  For two classes
``<code of x, y> / f(x)`` estimates their cosine without bias; with D
dimensions it errs by more than ``sqrt(1 - cos^2) * sqrt(1 - f^2) / f * BOUND /
sqrt(D - 1)`` with vanishing probability.  Pairs whose bound lies below the
threshold are dropped, all others are recomputed from the vectors themselves in
double precision, so that no link below the threshold is reported.

Candidates share a band, some sign bits of the codes.  Bands have as many bits
as keep a bucket of unrelated classes at about ``BUCKET`` whatever their number
n, and there are as many bands as a pair at the threshold misses with a
probability of ``MISSED``; their number grows with n^0.22.  A bucket of many
classes is dealt as pairs of parts to several tasks; nothing is capped.

No row is made for a pair: a first pass over codes names, in each cell of a
bucket, the classes with a pair to recompute there; a second one gets their
vectors, recomputes and puts out one row per class and cell: the vectors it
links with and the smallest class that the cell's links reach.  A pair belongs
to the first band that it shares, so it is counted once.

Defined results: vectors that are null, zero or of another length than most, or
hold null or non-finite components, and rows without an id, link with nothing
and are kept; repeated rows count as vectors of their own, rows that repeat an
id with another vector share its component; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import components, materialize, shuffle_partitions

THRESHOLD, BOUND = 0.9, 5.0
#: Classes of one bucket that a task compares at once.
PART = 2048
#: Classes that unrelated vectors put into a bucket, and the share of pairs at the threshold that may miss every band.
BUCKET, MISSED = 256, 1e-5


def banding(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a band, bands) for n classes."""
    bits = min(30, max(4, round(math.log2(max(1, n) / BUCKET))))
    return bits, math.ceil(math.log(1 / MISSED) / (1 - math.acos(threshold) / math.pi) ** bits)


def _band_values(code: list[bytes], bits: int, bands: int) -> np.ndarray:
    """The bands of sign codes, one row each."""
    sign = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1)[:, : bits * bands]
    return sign.reshape(len(code), bands, bits) @ (1 << np.arange(bits, dtype=np.int32))


def _codes(dim: int, bits: int, bands: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = V.rotations(max(bands * bits, dim), dim, 29)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                y = V.unit(piece.column("vector"), dim) @ turn.T
                first = y[:, :dim]
                f = np.abs(first).sum(1) / np.sqrt(dim)
                scale = np.abs(first).max(1) / 127
                eight = np.rint(first / scale[:, None]).astype(np.int8)
                code = [c.tobytes() for c in np.packbits(y > 0, axis=1)]
                values = _band_values(code, bits, bands) + (np.arange(bands, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("rep"),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * bands), pa.array(values.ravel())),
                        pa.array(code, pa.binary()),
                        pa.array(f.astype(np.float32)),
                        pa.array(scale.astype(np.float32)),
                        pa.array([e.tobytes() for e in eight], pa.binary()),
                    ],
                    ["rep", "bands", "code", "f", "scale", "eight"],
                )

    return apply


def _by_cell(solve, names: list[str]):
    """A function of sorted batches that calls ``solve`` with the rows of each cell (bucket, i, j) as a table."""

    def key(batch: pa.RecordBatch, k: int) -> tuple:
        return tuple(batch.column(c)[k].as_py() for c in ("bucket", "i", "j"))

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cut = np.flatnonzero(np.any([np.diff(t.column(c).to_numpy()) != 0 for c in ("bucket", "i", "j")], axis=0)) + 1
        parts = [solve(t.slice(a, b - a)) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True) if b - a > 1]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Whole cells of the sort order go on; the last one waits for its rest.
            if not batch.num_rows:
                continue
            b, i, j = (batch.column(c).to_numpy() for c in ("bucket", "i", "j"))
            other = np.flatnonzero((b != b[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and key(held[-1], 0) != key(batch, 0)):
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return apply


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which rows of a cell are compared with which, and whether they are the same ones."""
    if t.column("i")[0].as_py() == t.column("j")[0].as_py():
        return (np.arange(t.num_rows),) * 2 + (True,)
    side = t.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _own(hit: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray, band: int) -> np.ndarray:
    """Of the pairs flagged in ``hit`` those whose first common band is this one."""
    x, y = np.nonzero(hit)
    for k in range(0, len(x), 100000):
        s = slice(k, k + 100000)
        other = (values[a[x[s]]] == values[b[y[s]]]).argmax(axis=1) != band
        hit[x[s][other], y[s][other]] = False
    return hit


def _to_recompute(dim: int, bits: int, bands: int, threshold: float):
    """The rows of a cell that have a pair whose cosine may reach the threshold."""
    margin = np.sqrt(1 - threshold**2) * BOUND / np.sqrt(max(1, dim - 1))

    def solve(t: pa.Table) -> list[np.ndarray]:
        rep, f, scale = (t.column(k).to_numpy() for k in ("rep", "f", "scale"))
        codes = t.column("code").to_pylist()
        sign = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(rep), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
        turned = np.frombuffer(b"".join(t.column("eight").to_pylist()), np.int8).reshape(len(rep), dim) * scale[:, None]
        a, b, whole = _sides(t)
        estimate = (sign[a] / np.float32(np.sqrt(dim))) @ turned[b].T / f[a][:, None]
        floor = threshold - margin * np.sqrt(np.maximum(1 - f[a] ** 2, 0)) / f[a] - 0.02  # 0.02: eight bits a component
        hit = estimate >= floor[:, None]
        if whole:
            hit &= np.tri(len(a), k=-1, dtype=bool).T
        bucket, i, j = (t.column(k)[0].as_py() for k in ("bucket", "i", "j"))
        if hit.any():
            hit = _own(hit, a, b, _band_values(codes, bits, bands), bucket >> 32)
        left, right = a[hit.any(axis=1)], b[hit.any(axis=0)]
        rows = np.union1d(left, right) if whole else np.concatenate([left, right])
        side = np.isin(rows, right).astype(np.int32) if not whole else np.zeros(len(rows), np.int32)
        return [np.full(len(rows), bucket, np.int64), np.full(len(rows), i, np.int32), np.full(len(rows), j, np.int32), side, rep[rows]]

    return _by_cell(solve, ["bucket", "i", "j", "side", "rep"])


def _reached(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number that links of rows 0.. and columns n.. reach from each row and each column."""
    n, m = hit.shape
    low = np.arange(n + m)
    while True:
        new = low.copy()
        new[n:] = np.minimum(new[n:], np.where(hit, new[:n, None], n + m).min(axis=0))
        new[:n] = np.minimum(new[:n], np.where(hit, new[None, n:], n + m).min(axis=1))
        np.minimum.at(new, low, new)  # what a class reaches, its former root reaches
        new = new[new]
        if (new == low).all():
            return low[:n], low[n:]
        low = new


def _counted(dim: int, bits: int, bands: int, threshold: float):
    """Per row of a cell with a link: how many vectors it links with there, and the smallest class that it reaches."""

    def solve(t: pa.Table) -> list[np.ndarray]:
        rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
        u = V.unit(t.column("vector"), dim)
        a, b, whole = _sides(t)
        cosine = u[a] @ u[b].T
        near = np.abs(cosine - threshold) < 1e-9  # decided in the order of a plain sum
        x, y = np.nonzero(near)
        hit = cosine >= threshold
        hit[x, y] = (u[a[x]] * u[b[y]]).sum(axis=1) >= threshold
        if whole:
            hit &= np.tri(len(a), k=-1, dtype=bool).T
        hit = _own(hit, a, b, _band_values(t.column("code").to_pylist(), bits, bands), t.column("bucket")[0].as_py() >> 32)
        if whole:
            hit |= hit.T
        # Each class of a part on its own has two nodes here, which reach the same classes.
        rows, columns = _reached(hit)
        low = np.full(len(a) + len(b), np.iinfo(np.int64).max)
        np.minimum.at(low, np.concatenate([rows, columns]), np.concatenate([rep[a], rep[b]]))
        out = [rep[a], low[rows], hit @ size[b]]
        if not whole:
            out = [np.concatenate(x) for x in zip(out, [rep[b], low[columns], hit.T @ size[a]], strict=True)]
        linked = out[2] > 0
        return [x[linked] for x in out]

    return _by_cell(solve, ["rep", "low", "others"])


def compare(classes: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, low, others) of classes (rep, vector, size): vectors of other classes linked with, and a smaller class linked through a cell; several rows a class."""
    n = shuffle_partitions(classes.sparkSession)
    bits, bands = banding(classes.count(), threshold)
    codes = materialize(classes.select("rep", "vector").mapInArrow(_codes(dim, bits, bands), "rep long, bands array<long>, code binary, f float, scale float, eight binary"))
    large = codes.select(F.explode("bands").alias("bucket")).groupBy("bucket").count().where(F.col("count") > PART)
    large = materialize(large.select(F.col("bucket").alias("at"), F.ceil(F.col("count") / PART).cast("int").alias("parts")))  # written, so that Spark knows its size
    banded = codes.select(F.explode("bands").alias("bucket"), "rep", "code", "f", "scale", "eight")
    dealt = banded.join(large, F.col("bucket") == F.col("at"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "code", "f", "scale", "eight")
    cells = dealt.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    named = materialize(cells.mapInArrow(_to_recompute(dim, bits, bands, threshold), "bucket long, i int, j int, side int, rep long"))
    known = classes.select("rep", "vector", "size").join(codes.select("rep", "code"), "rep")
    cells = named.join(known, "rep").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(_counted(dim, bits, bands, threshold), "rep long, low long, others long")


def links(classes: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) of classes (rep, vector), or of what they reach within a cell: enough of them for the components."""
    sized = classes.select("rep", "vector", F.lit(1).cast("long").alias("size"))
    return compare(sized, dim, threshold).where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id and kept."""
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    dim = V.common_length(rows, "vector")
    good = rows.where(F.col("vec_id").isNotNull() & V.usable(F.col("vector"), dim))
    classes = materialize(good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    found = materialize(compare(classes, dim, threshold))
    roots = components(found.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    others = found.groupBy(F.col("rep").alias("a")).agg(F.sum("others").alias("others"))
    solved = (
        classes.join(others, classes.rep == others.a, "left").join(roots, classes.rep == roots.node, "left")
        .select("vector", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    part = rows.join(solved, (rows.vector == solved.vector) & rows.vec_id.isNotNull(), "left").select("vec_id", "n_links", "root")
    return part.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: near_duplicates over all embeddings."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
