"""MinHash near-deduplication with odd sketches.

A document's set holds the distinct five-word shingles of its text (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); documents are linked when
``100 * |A & B| >= 75 * |A | B|``.

1. One pass over the texts makes, per document, the set's fingerprint, 120
   MinHash values cut into 30 bands of 4, and the *odd sketch*: 480 further
   MinHash samples toggle bits of a 2,048-bit map, so that the population count
   of two maps' XOR estimates how many samples differ.  At a similarity of 0.75 a pair
   misses every band about once in 90,000.
2. Documents with the same set become one class; only classes go on, so exact
   copies never meet in a bucket.
3. Each band bucket is a star around its smallest member.  Odd sketches and set
   sizes discard hopeless pairs, every member keeps its likeliest star, and
   these pairs are confirmed on the full sets.
4. The confirmed links give components.  In buckets that still hold several,
   the members outside the bucket's largest component are tried against one
   member of it, the likeliest over all buckets.
5. Buckets that hold several components even then are compared inside tasks:
   the members outside the largest component, in parts of ``PART``, meet all
   members, in parts too.  A first pass over sizes and sketches names the
   members that have a likely partner in such a cell; a second one streams
   their texts past the outsiders of the cell, counts shared shingles through
   an inverted list and emits a link only where it joins two components that
   the cell had not joined yet.  No row is made for a pair: both passes put out
   at most one row per member of a cell.

Afterwards every pair that shares a bucket is linked, refused or already in one
component, so no link is lost to the stars.  Equality of two sets is judged by
128 bits of hash sums over them, shingles by 64 bits.

Confirmation streams texts past the text of a star's centre; a large star is
dealt to several tasks with a copy of its centre each.

Defined results: null, empty and blank texts have no shingles and link with
nothing; fewer than five words form one shingle; rows without an id get no
component and are kept; rows that repeat an id share its component; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .common import components, materialize, shuffle_partitions

WORDS, BANDS, ROWS = 5, 30, 4
#: Samples and bits of an odd sketch; they estimate a similarity of 0.75 with a standard deviation of 0.022.
SAMPLES, SKETCH_BITS = 480, 2048
SIMILAR = (75, 100)
#: Pairs whose sketches say less are not confirmed; four standard deviations below the threshold.
SKETCH_FLOOR = 0.66
#: Members of a star that share one copy of its centre.
STAR = 64
#: Classes of a bucket that make one part of it.
PART = 256
_U = np.uint64
_A = H.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E6C63D0876A9A47)) | _U(1)
_C = H.mix(_A + _U(12345))
_A32 = H.mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)).astype(np.uint32) | np.uint32(1)
_C32 = (H.mix(_A32.astype(_U) + _U(777)) >> _U(32)).astype(np.uint32)


def _sets(batch_text: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for lo, hi, buf, off in H.chunks(batch_text, 1 << 20, 1500):
        low, s, e, first = H.words(buf, off)
        word = H.spans(H.prefix(low), s, e)
        yield lo, hi, H.shingles(word, first, WORDS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, sets in _sets(batch.column("text")):
            size = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(size)
            low = np.zeros((len(sets), BANDS * ROWS), _U)
            sample = np.zeros((SAMPLES, len(sets)), np.uint32)
            key = np.zeros((2, len(sets)), _U)
            if len(full):
                x = np.concatenate([sets[i] for i in full])
                at = np.cumsum(size[full]) - size[full]
                for j in range(BANDS * ROWS):
                    low[full, j] = np.minimum.reduceat(x * _A[j] + _C[j], at)
                short = (x >> _U(32)).astype(np.uint32)
                for j in range(SAMPLES):
                    sample[j, full] = np.minimum.reduceat(short * _A32[j] + _C32[j], at)
                key[0, full] = H.mix(np.add.reduceat(x, at) + size[full].astype(_U))
                key[1, full] = H.mix(np.add.reduceat(H.mix(x ^ _A[0]), at) + size[full].astype(_U))
            band = np.tile(H.mix(np.arange(BANDS, dtype=_U) + _U(99)), (len(sets), 1))
            for r in range(ROWS):
                band = H.mix(band + low[:, r::ROWS])
            bit = (H.mix(sample + (np.arange(SAMPLES, dtype=_U) << _U(32))[:, None]) % _U(SKETCH_BITS)).astype(np.int64)
            count = np.bincount((bit + np.arange(len(sets)) * SKETCH_BITS).ravel(), minlength=len(sets) * SKETCH_BITS)
            maps = count.reshape(len(sets), SKETCH_BITS)
            sketch = np.packbits((maps & 1).astype(np.uint8), axis=1).view(np.int64)

            def lists(m: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), lists(np.ascontiguousarray(band)), lists(np.ascontiguousarray(sketch))],
                ["doc_id", "n_shingles", "key1", "key2", "bands", "sketch"],
            )


def _estimate(a: str, b: str) -> Column:
    """The similarity that two odd sketches suggest."""
    words = SKETCH_BITS // 64
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))
    inner = 1.0 - 2.0 * differ / SKETCH_BITS
    flips = F.when(inner <= 0.02, F.lit(1e9)).otherwise(-SKETCH_BITS / 2 * F.log(F.greatest(inner, F.lit(0.02))))
    return 1.0 - flips / (2.0 * SAMPLES)


def _promising() -> Column:
    """Whether sizes (na, nb) and sketches (sa, sb) leave a pair."""
    num, den = SIMILAR
    return (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (_estimate("sa", "sb") >= SKETCH_FLOOR)


def _likeliest(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) that sizes and sketches leave, the likeliest one of each b."""
    side = classes.select("cid", "n_shingles", "sketch")
    both = (
        pairs.join(side.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(side.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    )
    likely = both.where(_promising()).select("a", "b", _estimate("sa", "sb").alias("estimate"))
    return materialize(likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, role): a centre (role 0), then the members that are held against it."""
    num, den = SIMILAR
    now, centres = None, []
    for batch in batches:
        a, salt, role, ids = (batch.column(k).to_pylist() for k in ("a", "salt", "role", "id"))
        left, right = [], []
        for lo, hi, sets in _sets(batch.column("text")):
            for i in range(lo, hi):
                own = sets[i - lo]
                if (a[i], salt[i]) != now:
                    now, centres = (a[i], salt[i]), []
                if role[i] == 0:
                    centres.append(own)
                    continue
                for c in centres:
                    if den * min(len(c), len(own)) < num * max(len(c), len(own)):
                        continue
                    same = len(np.intersect1d(c, own, assume_unique=True))
                    if den * same >= num * (len(c) + len(own) - same):
                        left.append(a[i])
                        right.append(ids[i])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets are similar enough."""
    n = shuffle_partitions(docs.sparkSession)
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    dealt = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    centres = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    routes = dealt.unionByName(centres)
    texts = docs.join(routes.hint("shuffle_hash"), docs.doc_id == routes.id).select("a", "salt", "role", "id", "text")
    return texts.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_confirm, "a long, b long").distinct()


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """((bucket, i, j), first row, end row) of the stretches of a sorted batch that lie in one cell."""
    key = [batch.column(k).to_numpy() for k in ("bucket", "i", "j")]
    cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
    ends = [0, *cut.tolist(), batch.num_rows]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        if hi > lo:
            yield tuple(int(k[lo]) for k in key), lo, hi


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _likely_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, a cell's outsiders (side 0) first: those that sizes and sketches leave with a partner in their cell."""
    num, den = SIMILAR
    most = SKETCH_BITS * (1 - np.exp(-(1 - SKETCH_FLOOR) * 2 * SAMPLES * 2 / SKETCH_BITS)) / 2  # differing bits at SKETCH_FLOOR
    now, held = None, []
    for batch in batches:
        side, cid, part, size = (batch.column(k).to_numpy() for k in ("side", "cid", "part", "n_shingles"))
        central = batch.column("central").to_numpy(zero_copy_only=False)
        sketch, bands = _matrix(batch.column("sketch")).view(np.uint64), _matrix(batch.column("bands"))
        out: list[list] = [[] for _ in range(6)]

        def put(cell: tuple[int, int, int], which: int, ids: np.ndarray, parts: np.ndarray) -> None:
            for k, v in enumerate((*cell, which)):
                out[k].append(np.full(len(ids), v, np.int64))  # noqa: B023
            out[4].append(ids)  # noqa: B023
            out[5].append(parts)  # noqa: B023

        for cell, lo, hi in _cells(batch):
            if cell != now:
                now, held = cell, []
            m = lo + int(np.searchsorted(side[lo:hi], 1))
            if m > lo:
                held.append([x[lo:m].copy() for x in (cid, part, size, sketch, bands)] + [np.zeros(m - lo, bool)])
            if m == hi or not held:
                continue
            if len(held) > 1:
                held = [[np.concatenate(x) for x in zip(*held, strict=True)]]
            a_id, a_part, a_size, a_sketch, a_bands, told = held[0]
            for k in range(m, hi, PART):
                s = slice(k, min(k + PART, hi))
                differ = np.zeros((len(a_id), s.stop - k), np.int64)
                for w in range(sketch.shape[1]):
                    differ += np.bitwise_count(a_sketch[:, w][:, None] ^ sketch[s, w][None, :])
                fit = (differ <= most) & (a_part[:, None] != part[s][None, :]) & (central[s][None, :] | (a_id[:, None] < cid[s][None, :]))
                fit &= den * np.minimum(a_size[:, None], size[s][None, :]) >= num * np.maximum(a_size[:, None], size[s][None, :])
                x, y = np.nonzero(fit)
                if len(x):  # a pair is compared in the least bucket that it shares
                    first = np.where(a_bands[x] == bands[s][y], a_bands[x], np.iinfo(np.int64).max).min(axis=1) == cell[0]
                    x, y = np.unique(x[first]), np.unique(y[first])
                    x = x[~told[x]]
                    told[x] = True
                    put(cell, 0, a_id[x], a_part[x])
                    put(cell, 1, cid[s][y], part[s][y])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), *(pa.array(c.astype(np.int32)) for c in columns[1:4]), pa.array(columns[4]), pa.array(columns[5])], ["bucket", "i", "j", "side", "cid", "part"]
        )


class _Joined:
    """Which components a cell's links have joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, a cell's outsiders first: a forest of the links between components of the cell."""
    num, den = SIMILAR
    now, held, index, joined = None, [], None, _Joined()
    for batch in batches:
        side, cid, part = (batch.column(k).to_numpy() for k in ("side", "cid", "part"))
        cells = list(_cells(batch))
        starts = {lo: cell for cell, lo, _ in cells}
        left, right = [], []
        for lo, hi, sets in _sets(batch.column("text")):
            for r in range(lo, hi):
                own = sets[r - lo]
                if r in starts and starts[r] != now:
                    now, held, index, joined = starts[r], [], None, _Joined()
                if side[r] == 0:
                    held.append((int(cid[r]), int(part[r]), own))
                    continue
                if not held:
                    continue
                if index is None:
                    hashes, owner = np.concatenate([h for _, _, h in held]), np.repeat(np.arange(len(held)), [len(h) for _, _, h in held])
                    order = np.argsort(hashes, kind="stable")
                    index = hashes[order], owner[order], np.array([len(h) for _, _, h in held])
                hashes, owner, sizes = index
                a, b = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                length = b - a
                at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
                same = np.bincount(owner[at], minlength=len(held))
                for k in np.flatnonzero(den * same >= num * (sizes + len(own) - same)).tolist():
                    if joined.join(held[k][1], int(part[r])):
                        left.append(held[k][0])
                        right.append(int(cid[r]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _placed(buckets: DataFrame, roots: DataFrame, side: DataFrame) -> DataFrame:
    """The buckets that hold several components: bucket, cid, part, largest, n_all, n_out and the class's columns."""
    placed = buckets.select("bucket", "cid").join(roots, F.col("cid") == F.col("node"), "left").select("bucket", "cid", F.coalesce("root", "cid").alias("part"))
    parts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    several = parts.groupBy("bucket").agg(
        F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("n_all"), (F.sum("n") - F.max("n")).alias("n_out")
    ).where("n_out > 0")
    return materialize(placed.join(several, "bucket").join(side, "cid"))


def _links_in_cells(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each bucket as far as its full sets do."""
    n = shuffle_partitions(placed.sparkSession)
    counted = placed.withColumn("central", F.col("part") == F.col("largest"))
    counted = counted.withColumns({"outer": F.ceil(F.col("n_out") / PART).cast("int"), "all": F.ceil(F.col("n_all") / PART).cast("int")})
    columns = ["bucket", "i", "j", "side", "cid", "part", "central", "n_shingles", "sketch", "bands"]
    outside = counted.where("not central").withColumns({"i": F.pmod(F.xxhash64("cid"), F.col("outer")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("all") - 1)), "side": F.lit(0)})
    inside = counted.withColumns({"j": F.pmod(F.xxhash64("cid", "bucket"), F.col("all")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("outer") - 1)), "side": F.lit(1)})
    cells = outside.select(columns).unionByName(inside.select(columns)).repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    likely = materialize(cells.mapInArrow(_likely_members, "bucket long, i int, j int, side int, cid long, part long").distinct())
    routed = texts.join(likely.hint("shuffle_hash"), texts.doc_id == likely.cid).select("bucket", "i", "j", "side", "cid", "part", "text")
    return routed.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = materialize(
        docs.mapInArrow(_features, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>")
    )
    known = docs.where("doc_id is not null")
    classes = materialize(
        marked.where("n_shingles > 0 and doc_id is not null").groupBy("key1", "key2")
        .agg(F.min("doc_id").alias("cid"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    )
    member = marked.where("n_shingles > 0 and doc_id is not null").select("doc_id", "key1", "key2").join(classes.select("key1", "key2", "cid"), ["key1", "key2"])

    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("cid").alias("star"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(banded.join(stars.select("bucket", "star"), "bucket"))
    # The texts that may have to be compared; the corpus is not shuffled again.
    texts = materialize(known.join(buckets.select(F.col("cid").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi"))
    pairs = buckets.where("cid <> star").select(F.col("star").alias("a"), F.col("cid").alias("b")).distinct()
    twice = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.collect_set("cid").alias("b")).where(F.size("b") > 1)
    twice = twice.select("a", F.explode("b").alias("b")).where("a <> b")  # an id with several texts ties their classes
    links = materialize(confirm(_likeliest(pairs, classes), texts).unionByName(twice))
    roots = components(links)

    side = classes.select("cid", "n_shingles", "sketch", "bands")
    placed = _placed(buckets, roots, side)
    if not placed.isEmpty():
        one = placed.where("part = largest").groupBy("bucket").agg(F.min_by("cid", F.xxhash64("cid", "bucket")).alias("a"))
        pairs = placed.where("part <> largest").select("bucket", F.col("cid").alias("b")).join(one, "bucket").select("a", "b").distinct()
        links = materialize(links.unionByName(confirm(_likeliest(pairs, classes), texts)))
        roots = components(links)
        placed = _placed(buckets, roots, side)
        links = materialize(links.unionByName(_links_in_cells(placed, texts)))
        roots = components(links)

    own = member.select("doc_id", "cid").distinct()
    own = own.join(roots, F.col("cid") == F.col("node"), "left").select("doc_id", F.coalesce("root", "cid").alias("found"))
    own = own.groupBy("doc_id").agg(F.min("found").alias("found"))
    return (
        marked.select("doc_id", "n_shingles").join(own, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; of rows that repeat an id, one."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    own = docs["doc_id"].cast("long")
    out = docs.join(kept.hint("shuffle_hash"), own == kept["__kept_id"], "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: near_duplicates over all documents."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
