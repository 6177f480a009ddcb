"""Suffix-array deduplication: remove every byte of a repeated 200-byte string.

Prefix doubling in Spark: start positions hold the rank of bytes that they share
with others; Spark sorts the pairs (rank so far, bytes beside), numbers those that
occur again, drops positions that became unique, and goes on with longer strings
until they have 200 bytes.

Doubling every byte of a corpus from its first byte on would shuffle many times
the corpus.  So ranks start at ``SEED`` = 64 bytes, where a 64-bit hash of the
bytes is the rank, and positions go in *blocks*, each of neighbouring starts, with
the rank of the bytes that all strings of the block have in common.  The first
blocks are *runs*: consecutive start positions of 200-byte strings whose leftmost
smallest 64-byte string is the same one.  Two equal 200-byte strings contain the
same smallest 64-byte string at the same place, so they can only lie in runs of
equal rank, and no string occurs twice within one run.

1. Runs whose rank occurs once are done.
2. Blocks that are equal in all that their strings cover repeat from end to end:
   their positions are found, and one of each content stays as a partner for
   others.  Equal runs are the first of these, copies of whole texts among them.
3. Other blocks of a shared rank are halved.  What the strings of a half have in
   common is longer by the other half; the pairs (rank, these bytes) are counted,
   sorted by range and reranked, and halves whose pair occurs once are done.
   From 64 bytes this goes over 132, 166, 183, ... to 200, in eight steps, where a
   block is one position.

Pairs are counted before they are shuffled, so a string that stands in millions
of texts is one row of a sort.  A repeat that begins or ends within a block
leaves one undecided block a step, so blocks are few: each carries only the bytes
that its strings do not share, half as many at each step.

Defined results: a null text is empty; texts under 200 bytes are kept whole;
repeated rows repeat each other, with or without an id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .common import materialize, shuffle_partitions

LENGTH, SEED = 200, 64


def _runs(length: int, seed: int):
    width = length - seed + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ids = batch.column("row_id").to_numpy()
            for lo, hi, buf, off in H.chunks(batch.column("text")):
                p = H.prefix(buf)
                h = H.grams(p, seed)
                if len(h) < width:
                    continue
                low = H.windowed_min(h, width)
                n = len(low)
                doc = np.repeat(np.arange(hi - lo), np.diff(off))[:n]
                whole = np.arange(n) + length <= off[1:][doc]
                last = np.ones(n, bool)
                last[:-1] = (h[: n - 1] == low[:-1]) | (low[1:] < low[:-1]) | ~whole[1:]
                first = np.ones(n, bool)
                first[1:] = last[:-1] | ~whole[:-1]
                a, b = np.flatnonzero(first & whole), np.flatnonzero(last & whole)
                at = b.copy()  # where the smallest string of the run stands: at its last start, or behind it
                for k in range(0, len(b), 20000):
                    some = np.flatnonzero(h[b[k : k + 20000]] != low[b[k : k + 20000]]) + k
                    at[some] += np.argmin(h[b[some][:, None] + np.arange(width)], axis=1)
                # What the strings of the two halves of the run have in common beside it.
                l, r = (width - 1) // 2 + 1, width - 1 - (width - 1) // 2
                before, behind = at - l >= a, at + seed + r <= b + length
                left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                left[before] = H.spans(p, at[before] - l, at[before])
                right[behind] = H.spans(p, at[behind] + seed, at[behind] + seed + r)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(low[a].view(np.int64)),
                        pa.array(H.spans(p, a, b + length).view(np.int64)),
                        pa.array(row_ids[lo:hi][doc[a]]),
                        pa.array((a - off[doc[a]]).astype(np.int64)),
                        pa.array((b - a + 1).astype(np.int32)),
                        pa.array((at - a).astype(np.int32)),
                        pa.array(left.view(np.int64), mask=~before),
                        pa.array(right.view(np.int64), mask=~behind),
                    ],
                    ["rank", "run_rank", "row_id", "start", "n_starts", "anchor", "left", "right"],
                )

    return apply


def _contexts(length: int):
    """Rows of a text with its blocks: a row for each block, with the bytes beside what its strings have in common, nearest first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = H.text_buffer(batch.column("text"))
            ids, blocks = batch.column("row_id").to_numpy(), batch.column("blocks")
            base, value = blocks.offsets.to_numpy(), blocks.values
            row = np.repeat(np.arange(len(blocks)), np.diff(base))
            parts = value.slice(base[0], base[-1] - base[0])
            lo, hi, a, b = (parts.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi", "a", "b"))
            at = off[:-1][row] + parts.field("at").to_numpy()
            ends = [x.tolist() for x in (at - b, at - lo, at + length - hi, at + length - a)]
            for k in range(0, len(row), 20000):
                some = slice(k, k + 20000)
                cuts = list(zip(*(e[some] for e in ends), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(parts.field(c)[some] for c in ("rank", "lo", "hi")),
                        pa.array(ids[row[some]]),
                        *(parts.field(c)[some] for c in ("at", "a", "b", "once")),
                        pa.array([buf[i:j][::-1].tobytes() for i, j, _, _ in cuts], pa.binary()),
                        pa.array([buf[i:j].tobytes() for _, _, i, j in cuts], pa.binary()),
                    ],
                    ["rank", "lo", "hi", "row_id", "at", "a", "b", "once", "left", "right"],
                )

    return apply


def _reranked(blocks: DataFrame, *pair: str) -> DataFrame:
    """Blocks whose pair occurs again, with the pair's place in sorted order as their new rank."""
    n = shuffle_partitions(blocks.sparkSession)
    again = blocks.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").select(*pair)
    again = materialize(again.repartitionByRange(n, *pair).sortWithinPartitions(*pair).withColumn("place", F.monotonically_increasing_id()))
    return blocks.join(again, list(pair)).drop(*pair).withColumnRenamed("place", "rank")


def _doubled(blocks: DataFrame) -> DataFrame:
    """(row_id, first, last) of the repeated positions of the blocks flagged ``once``.

    A block has the positions ``at - b`` to ``at - a`` of one text, of those that
    begin ``lo`` to ``hi`` bytes before the run's smallest string; ``rank`` stands
    for lo, hi and the bytes that all of these share; ``left`` and ``right`` are what
    its own positions cover beyond them.
    """
    found, position = [], ["row_id", (F.col("at") - F.col("b")).alias("first"), (F.col("at") - F.col("a")).alias("last")]
    columns = ["lo", "hi", "row_id", "at", "a", "b", "once", "left", "right"]
    while True:
        blocks = blocks.withColumn("covered", F.xxhash64("left", "right"))
        contents = materialize(blocks.groupBy("rank", "covered").agg(F.count("*").alias("n"), F.min(F.struct(*columns)).alias("one")))
        equal = blocks.where("once").join(contents.where("n > 1").select("rank", "covered"), ["rank", "covered"], "left_semi").select(*position)
        found.append(materialize(equal))  # so that the last plan is a scan of small files and not all the joins
        # One of each content goes on; ranks of one content, or with nothing left to find, are done.
        rest = contents.select("rank", "one.*", "n").withColumn("once", F.col("once") & (F.col("n") == 1)).drop("n")
        some = rest.groupBy("rank").agg(F.count("*").alias("n"), F.bool_or("once").alias("open")).where("n > 1 and open").select("rank")
        rest = rest.join(some, "rank", "left_semi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))

        def cut(c: str, first, size) -> Column:
            return F.substring(F.col(c), first, size)

        lo, hi, a, b, mid = (F.col(c) for c in ("lo", "hi", "a", "b", "mid"))
        low_b, high_a = F.least(b, mid), F.greatest(a, mid + 1)
        halves = F.array(
            F.struct(F.lit(0).alias("half"), lo.alias("lo"), mid.alias("hi"), a.alias("a"), low_b.alias("b"), cut("right", F.lit(1), hi - mid).alias("more"), cut("left", F.lit(1), low_b - lo).alias("left"), cut("right", hi - mid + 1, mid - a).alias("right")),
            F.struct(F.lit(1).alias("half"), (mid + 1).alias("lo"), hi.alias("hi"), high_a.alias("a"), b.alias("b"), cut("left", F.lit(1), mid + 1 - lo).alias("more"), cut("left", mid + 2 - lo, b - mid - 1).alias("left"), cut("right", F.lit(1), hi - high_a).alias("right")),
        )
        halves = rest.select("rank", "row_id", "at", "once", F.explode(halves).alias("h")).select("rank", "row_id", "at", "once", "h.*").where("a <= b").withColumn("more", F.xxhash64("more"))
        blocks = materialize(_reranked(materialize(halves), "rank", "half", "more").select("rank", *columns))
        if blocks.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _removal(length: int, keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = H.text_buffer(batch.column("text"))
            spans = batch.column("spans")
            base = spans.offsets.to_numpy()
            value = spans.values
            first, last = (value.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
            size, removed, count, digest, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                text = buf[off[i] : off[i + 1]]
                gone = n = 0
                if base[i + 1] > base[i]:
                    a, b = first[base[i] : base[i + 1]], last[base[i] : base[i + 1]] + length
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    n = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    text = text[~out]
                size.append(int(off[i + 1] - off[i]))
                removed.append(gone)
                count.append(n)
                digest.append(hashlib.sha256(text.tobytes()).hexdigest())
                if keep_text:
                    kept.append(text.tobytes().decode("utf-8", "ignore"))
            columns = [batch.column("row_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept_text"]
            rest = [k for k in batch.schema.names if k not in ("row_id", "text", "spans")]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k) for k in rest)], [*names, *rest])

    return apply


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: its other columns, n_bytes, n_removed, n_spans, kept_sha256 and, asked for, kept_text.

    Spans are judged on the input bytes.  ``kept_text`` joins the kept bytes; a
    character of which only some bytes went is dropped from it.
    The other columns come back as one struct, ``row``.  The result is written to the shared folder.
    """
    spark = docs.sparkSession
    seed = min(SEED, max(1, length // 3))
    n = shuffle_partitions(spark)
    others = [c for c in docs.columns if c.lower() != text.lower()]
    own = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))).alias("row"),
    )
    # The text is shuffled once; both later joins with it find it bucketed.  The table is dropped when the result is written.
    name = f"texts_{uuid.uuid4().hex}"
    own.repartition(n, "row_id").write.bucketBy(n, "row_id").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    runs = texts.select("row_id", "text").mapInArrow(_runs(length, seed), "rank long, run_rank long, row_id long, start long, n_starts int, anchor int, left long, right long")
    again = materialize(runs.groupBy("rank").count().where("count > 1").select("rank"))
    runs = materialize(runs.join(again, "rank"))
    equal = runs.groupBy("rank", "run_rank").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "start", "n_starts", "anchor", "left", "right")).alias("one")).select("rank", "run_rank", "n", "one.*")
    equal = materialize(equal)
    whole = runs.join(equal.where("n > 1").select("rank", "run_rank"), ["rank", "run_rank"], "left_semi").select(
        "row_id", F.col("start").alias("first"), (F.col("start") + F.col("n_starts") - 1).alias("last")
    )
    # The two halves of each run: starts up to ``mid`` bytes before its smallest string, and starts before these.
    rest, mid = length - seed, (length - seed) // 2
    a, b = F.col("anchor") - F.col("n_starts") + 1, F.col("anchor")
    at = (F.col("start") + F.col("anchor")).alias("at")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("right").alias("more"), F.lit(0).alias("lo"), F.lit(mid).alias("hi"), a.alias("a"), F.least(b, F.lit(mid)).alias("b")),
        F.struct(F.lit(1).alias("half"), F.col("left").alias("more"), F.lit(mid + 1).alias("lo"), F.lit(rest).alias("hi"), F.greatest(a, F.lit(mid + 1)).alias("a"), b.alias("b")),
    )
    halves = equal.select("rank", "row_id", at, (F.col("n") == 1).alias("once"), F.explode(halves).alias("h")).select("rank", "row_id", "at", "once", "h.*").where("a <= b")
    blocks = materialize(_reranked(halves, "rank", "half", "more"))
    blocks = blocks.groupBy("row_id").agg(F.collect_list(F.struct("rank", "lo", "hi", "at", "a", "b", "once")).alias("blocks"))
    schema = "rank long, lo int, hi int, row_id long, at long, a int, b int, once boolean, left binary, right binary"
    blocks = materialize(texts.select("row_id", "text").join(blocks.hint("shuffle_hash"), "row_id").mapInArrow(_contexts(length), schema))
    single = _doubled(blocks)
    spans = whole.unionByName(single)
    spans = spans.groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), "row_id", "left").select(
        "row_id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")).alias("spans"), "row"
    )
    kept = ", kept_text string" if keep_text else ""
    schema = f"row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}, row {own.schema['row'].dataType.simpleString()}"
    out = materialize(joined.mapInArrow(_removal(length, keep_text), schema).drop("row_id"))
    spark.sql(f"DROP TABLE {name}")
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``, and ``n_chars`` counted anew where there is such a column."""
    out = remove_repeats(docs, keep_text=True)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the digest of remove_repeats over all documents."""
    from .common import table

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
