"""Nearest neighbours by largest inner product, with collision-counting hashing.

Vectors are dealt to blocks of nearly one length: the lengths within a block
differ by at most ``RATIO``.  Each vector gets one further component that brings
all to the largest length in its block; queries get a zero there and are scaled
to that length, which leaves their order of rows as it is; then the nearest by
distance are those of the largest inner product.  A block's index is,
for each of ``PROJECTIONS`` random directions, the array of its vectors'
projections in sorted order.  A query lays a window around its own projection
in every array; a vector *collides* where it lies in the window.  Windows widen
by virtual rehashing, the wider window adding only its two new rims, until
enough vectors have collided ``COLLISIONS`` of all times; these are verified with
their exact inner products, and the best of a block go on to the merge.

Vectors that don't collide often enough are not looked at, so the result is
approximate: see the README for the measured recall and share of verified rows.
Every vector is indexed in full.  Queries, a stated set, meet all blocks in
groups; a task holds one block and one group of queries, both of bounded size,
and builds the block's index, a hundredth of the group's work, where it is used.

Defined results: vectors that are null, zero or of another length than most, or
hold null or non-finite components, and rows without an id, take no part; with
fewer candidates than k all are returned; ties go to the smaller id; repeated
rows are candidates of their own, but not of a query with their id; of query
rows that repeat an id the smallest vector asks; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import materialize

PROJECTIONS, COLLISIONS = 192, 0.8
#: Share of a block that is verified for each query at least, and never fewer than five times k.
VERIFIED = 0.03
#: First half-width of a window in standard deviations of a projection, and the factor between two widths.
FIRST, WIDEN = 1.5, 1.04
#: Rows and queries of a task; the largest of a block's lengths is at most so many times the smallest.
BLOCK, QUERIES, RATIO = 8192, 4096, 1.25


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.x = x
        square = np.square(x).sum(1)
        self.longest = float(np.sqrt(square.max())) * (1 + 1e-9)
        self.directions = V.rotations(PROJECTIONS, x.shape[1] + 1, seed)
        rest = np.sqrt(np.maximum(self.longest**2 - square, 0))
        p = (np.column_stack([x, rest]) @ self.directions.T).T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, 1)
        self.spread = float(np.median(p.std(axis=1))) or 1.0

    def candidates(self, q: np.ndarray, k: int):
        """For each query the rows that collided often enough."""
        n = len(self.x)
        need = min(n, max(5 * k, int(np.ceil(VERIFIED * n))))
        if need == n or not np.isfinite(self.longest):
            yield from (np.arange(n) for _ in q)
            return
        own = (q * (self.longest / np.sqrt(np.square(q).sum(1, keepdims=True)))) @ self.directions[:, :-1].T
        often = int(COLLISIONS * PROJECTIONS)
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def edge(t: int) -> tuple[np.ndarray, np.ndarray]:
            while len(edges) <= t:
                w = FIRST * self.spread * WIDEN ** len(edges) if len(edges) < 100 else np.inf
                lo = np.stack([np.searchsorted(s, own[:, j] - w, "left") for j, s in enumerate(self.sorted)], 1)
                hi = np.stack([np.searchsorted(s, own[:, j] + w, "right") for j, s in enumerate(self.sorted)], 1)
                edges.append((lo, hi))
            return edges[t]

        for i in range(len(q)):
            count = np.zeros(n, np.int64)
            lo0 = hi0 = None
            for t in range(101):
                lo, hi = (e[i].tolist() for e in edge(t))
                if lo0 is None:
                    rims = [o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]
                    if 2 * (sum(hi) - sum(lo)) > self.order.size:  # fewer lie outside
                        rims = [x for o, a, b in zip(self.order, lo, hi, strict=True) for x in (o[:a], o[b:])]
                        count, rims = PROJECTIONS - np.bincount(np.concatenate(rims), minlength=n), []
                else:
                    rims = [o[a:b] for o, a, b in zip(self.order, lo, lo0, strict=True) if a < b]
                    rims += [o[a:b] for o, a, b in zip(self.order, hi0, hi, strict=True) if a < b]
                if rims:
                    count += np.bincount(np.concatenate(rims), minlength=n)
                found = np.flatnonzero(count >= often)
                if len(found) >= need:
                    break
                lo0, hi0 = lo, hi
            yield found


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows."""
    spark = rows.sparkSession
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dim = V.common_length(rows, "vector")
    rows = rows.where(F.col("vec_id").isNotNull() & V.usable(F.col("vector"), dim))
    # Blocks of nearly one length: the classes of the logarithm are counted, which gives each its blocks.
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, v: t + v * v))
    rows = rows.withColumn("class", F.floor(F.log(length) / math.log(RATIO)))
    asking = materialize(rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")))
    nq = asking.count()
    counts = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # some thousand lengths differ by RATIO at most
    schema = "query_id long, rank int, vec_id long, score double"
    if not counts or not nq:
        return spark.createDataFrame([], schema)
    groups, first, plan = -(-nq // QUERIES), 0, []
    for c in sorted(counts, key=lambda c: (c is None, c)):
        plan.append((c, first, -(-counts[c] // BLOCK)))
        first += plan[-1][2]
    plan = F.broadcast(spark.createDataFrame(plan, "of long, first int, blocks int"))  # a row a class
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())
    block = (F.col("first") + F.pmod(salt, F.col("blocks"))).cast("int")
    left = rows.join(plan, F.col("class").eqNullSafe(F.col("of"))).select("vec_id", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = asking.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"))

    def within(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            ids, x = vectors.column("vec_id").to_numpy(), V.matrix(vectors.column("vector"), dim)
            asked, q = queries.column("vec_id").to_numpy(), V.matrix(queries.column("vector"), dim)
            for i, found in enumerate(Index(x).candidates(q, k + 1)):
                found = found[ids[found] != asked[i]]
                score = (x[found] * q[i]).sum(axis=1)
                if len(found) > k:
                    least = -np.partition(-score, k - 1)[k - 1]
                    keep = score >= least
                    found, score = found[keep], score[keep]
                best = np.lexsort((ids[found], -score))[:k]
                out[0] += [asked[i]] * len(best)
                out[1] += ids[found[best]].tolist()
                out[2] += score[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(within, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the 20 nearest of every vector whose id is divisible by 20."""
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
