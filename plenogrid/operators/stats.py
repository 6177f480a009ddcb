"""Robust statistics per group: moments, the quantile family, histograms, density intervals.

All functions take a table with group columns ``by`` and a value column, ignore
values that are null or not finite, and return a row per group unless they say
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import finite
from ..steps import written


def clean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("v")).where(finite(F.col("v")))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, skewness, excess kurtosis, extremes, and counts of what was left out."""
    v = F.col(value).cast("double")
    ok = F.when(finite(v), v)
    n = F.count(ok)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"),
        F.when(n >= 3, F.skewness(ok)).alias("skewness"), F.when(n >= 4, F.kurtosis(ok)).alias("kurtosis"),
        F.min(ok).alias("min"), F.max(ok).alias("max"),
        F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
    )


#: Zero-based index into the sorted values, from their number n.
RULES = {
    "nearest": lambda n, p: F.floor((n - 1) * p + 0.5),
    "truncating": lambda n, p: F.floor((n - 1) * p),
    "upper_median": lambda n, p: F.floor(n / 2),
}


def ranked(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, v, copies, i, n): distinct values with the zero-based place of their first copy in the group."""
    return placed(clean(df, by, value).groupBy(*by, "v").agg(F.count("*").alias("copies")), by)


#: Rows of totals, one a group and part, that are broadcast to the values; more are merged with them.
FEW = 100_000


def _running(by: Sequence[str]):
    """For mapInArrow: rows sorted by group and value get what comes before them in their group and part."""

    def changes(a: pa.Array) -> np.ndarray:
        """Where a key differs from the one before; nulls are equal, and so are numbers that are none."""
        here, before = a.slice(1), a.slice(0, len(a) - 1)
        if pa.types.is_nested(a.type):
            fields = a.flatten() if pa.types.is_struct(a.type) else []
            return np.logical_or.reduce([pc.not_equal(pc.is_null(here), pc.is_null(before)).to_numpy(zero_copy_only=False), *map(changes, fields)]) if fields else np.array([x != y for x, y in zip(here.to_pylist(), before.to_pylist(), strict=True)], bool)
        differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        differ = differ | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
        if pa.types.is_floating(a.type):
            none = [pc.fill_null(pc.is_nan(x), False).to_numpy(zero_copy_only=False) for x in (here, before)]
            differ &= ~(none[0] & none[1])
        return differ

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            copies = batch.column("copies").to_numpy()
            begins = np.zeros(batch.num_rows, bool)
            keys = batch.select(list(by))
            for c in by:
                begins[1:] |= changes(keys.column(c))
                if last is not None:
                    begins[0] |= changes(pa.concat_arrays([last.column(c), keys.column(c).slice(0, 1)]))[0]
            before = np.cumsum(copies) - copies
            first = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))
            inner = np.where(first >= 0, before - before[np.maximum(first, 0)], before + total)
            last, total = keys.slice(batch.num_rows - 1), int(inner[-1] + copies[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner), pa.array(np.full(batch.num_rows, part, np.int64))], [*batch.schema.names, "inner", "part"])

    return apply


def placed(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, v, copies, i, n) of values that are counted already (by, v, copies).

    A group is never sorted in one task, nor is a value compared with all marks of
    a sketch: groups and values are dealt to parts by their range and numbered in
    the order they are sorted in, and the running totals of the parts give each
    its first place.  The numbered values are written once, since two parts of the
    plan must see the same ranges.
    """
    c = counted.select(*by, "v", F.col("copies").cast("long").alias("copies")).repartitionByRange(*by, "v").sortWithinPartitions(*by, "v")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema]
    c = written(c.mapInArrow(_running(by), ", ".join([*kinds, "inner long", "part long"])))
    parts = c.groupBy(*by, "part").agg(F.sum("copies").alias("here"))
    every = Window.partitionBy(*by)
    start = F.sum("here").over(every.orderBy("part")) - F.col("here")
    parts = written(parts.select(*by, "part", start.alias("start"), F.sum("here").over(every).alias("n")))
    parts = F.broadcast(parts) if parts.limit(FEW + 1).count() <= FEW else parts.hint("merge")
    return c.join(parts, [*by, "part"]).select(*by, "v", "copies", (F.col("start") + F.col("inner")).alias("i"), "n")


def at_places(r: DataFrame, by: Sequence[str], places: dict[str, Column]) -> DataFrame:
    """Values at the zero-based places, from ``ranked``."""
    aggs = [F.max(F.when((F.col("i") <= c) & (c < F.col("i") + F.col("copies")), F.col("v"))).alias(k) for k, c in places.items()]
    return r.groupBy(*by).agg(F.first("n").alias("n"), *aggs)


def between_places(r: DataFrame, by: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """(by, n, names): linear interpolation between the neighbours of (n - 1) p, from ``ranked``."""
    at = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in ps.items()}
    ends = at_places(r, by, {f"{k}_{e}": f(x) for k, x in at.items() for e, f in (("lo", F.floor), ("hi", F.ceil))})
    return ends.select(*by, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (x - F.floor(x))).alias(k) for k, x in at.items()])


def with_mad(r: DataFrame, by: Sequence[str], m: DataFrame) -> DataFrame:
    """``m``, which has the groups' median, with the median distance from it as mad; from ``ranked``, without a group in one task.

    ``m``, a row a group, is written, so that Spark knows its size.
    """
    m = written(m)
    j = r.join(m.select(*by, "median"), list(by)) if by else r.crossJoin(m.select("median"))
    far = j.groupBy(*by, F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("copies").alias("copies"))
    mad = between_places(placed(far, by), by, {"mad": 0.5}).drop("n")
    return m.join(mad, list(by)) if by else m.crossJoin(mad)


def quantile(df: DataFrame, by: Sequence[str], value: str, p: float, rule: str = "nearest") -> DataFrame:
    """A sample value by the rule's index."""
    return at_places(ranked(df, by, value), by, {"q": RULES[rule](F.col("n"), p)}).select(*by, "q")


def interpolated(df: DataFrame, by: Sequence[str], value: str, *ps: float) -> DataFrame:
    """Linear interpolation between neighbours at (n - 1) p."""
    return between_places(ranked(df, by, value), by, {f"q{round(p * 1000)}": p for p in ps}).drop("n")


def streaming_quantile(df: DataFrame, by: Sequence[str], value: str, p: float, accuracy: int = 1_000_000) -> DataFrame:
    """One pass and bounded state by a mergeable sketch; its rank error is n / accuracy."""
    return clean(df, by, value).groupBy(*by).agg(F.percentile_approx("v", F.lit(p), F.lit(accuracy)).alias("q"))


def histogram_plan(df: DataFrame, by: Sequence[str], value: str, least: int = 64, most: int = 65536, r: DataFrame | None = None) -> DataFrame:
    """(by, n, lo, hi, bins, width) of the Freedman-Diaconis rule, Scott's where the quartiles coincide, then the range."""
    r = ranked(df, by, value) if r is None else r
    q = at_places(r, by, {"q1": RULES["nearest"](F.col("n"), 0.25), "q3": RULES["nearest"](F.col("n"), 0.75)})
    m = clean(df, by, value).groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    return bins_of(q.join(m, list(by)) if by else q.crossJoin(m), by, least, most)


def bins_of(g: DataFrame, by: Sequence[str], least: int = 64, most: int = 65536) -> DataFrame:
    """The plan of a histogram from (by, n, q1, q3, lo, hi, sd)."""
    cube = F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    span = F.col("hi") - F.col("lo")
    h = F.when(F.col("q3") > F.col("q1"), 2 * (F.col("q3") - F.col("q1")) * cube).when(F.col("sd") > 0, 3.5 * F.col("sd") * cube).otherwise(span / 256)
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.try_divide(span, h))))
    g = g.withColumn("bins", F.when(span > 0, bins).otherwise(1))
    return g.select(*by, "n", "q1", "q3", "lo", "hi", "bins", F.when(span > 0, span / F.col("bins")).otherwise(1.0).alias("width"))


def histogram(df: DataFrame, by: Sequence[str], value: str, plan: DataFrame | None = None) -> DataFrame:
    """(by, bin, count) of the bins that hold something; edge bins take what lies outside.

    The plan, a row a group, is written: as part of the plan above it Spark would not
    know it for small, and sort each group in one task to meet its row.
    """
    plan = written(histogram_plan(df, by, value)) if plan is None else plan
    return binned(clean(df, by, value).withColumn("copies", F.lit(1)), by, plan)


def binned(counted: DataFrame, by: Sequence[str], plan: DataFrame) -> DataFrame:
    """The histogram of values that are counted already (by, v, copies)."""
    plan = plan.select(*by, "lo", "width", "bins")
    c = counted.select(*by, "v", "copies")
    c = c.join(plan, list(by)) if by else c.crossJoin(plan)
    k = F.least(F.col("bins") - 1, F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / F.col("width"))))
    return c.groupBy(*by, k.alias("bin")).agg(F.sum("copies").alias("count"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("bins").alias("bins"))


def histogram_mode(h: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fullest bin, first of equals, moved by the parabola through it and its neighbours."""
    best = h.groupBy(*by).agg(F.max_by(F.struct("bin", "count", "lo", "width"), F.struct("count", -F.col("bin"))).alias("b"))
    side = h.select(*by, F.col("bin").alias("k"), F.col("count").alias("c"))
    j = best.select(*by, "b.*").join(side, list(by)) if by else best.select("b.*").crossJoin(side)
    j = j.groupBy(*by, "bin", "count", "lo", "width").agg(
        F.coalesce(F.max(F.when(F.col("k") == F.col("bin") - 1, F.col("c"))), F.lit(0)).alias("before"), F.coalesce(F.max(F.when(F.col("k") == F.col("bin") + 1, F.col("c"))), F.lit(0)).alias("after")
    )
    bend = F.col("before") - 2 * F.col("count") + F.col("after")
    shift = F.coalesce(F.try_divide(0.5 * (F.col("before") - F.col("after")), bend), F.lit(0.0))
    return j.select(*by, "bin", (F.col("lo") + (F.col("bin") + 0.5 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), shift))) * F.col("width")).alias("mode"))


def hdi_histogram(h: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """A10: the fewest neighbouring bins that hold the share; of equals the one that ends first.

    For each bin that can begin an interval only its first sufficient end
    matters.  The totals that beginnings ask for and the running totals of the
    ends are put in one falling order, in which the least end so far is the one
    asked for.  A group has 65,536 bins at most.
    """
    w = Window.partitionBy(*by).orderBy("bin")
    h = h.withColumn("cum", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy(*by)))
    target = F.col("cum") - F.col("count") + F.ceil(F.col("n") * share)
    none = F.lit(None).cast("long")
    ends = h.select(*by, F.col("cum").cast("long").alias("at"), F.lit(0).alias("asks"), F.col("bin").alias("to"), none.alias("bin"), "lo", "width")
    asks = h.select(*by, target.cast("long").alias("at"), F.lit(1).alias("asks"), none.alias("to"), "bin", "lo", "width")
    falling = Window.partitionBy(*by).orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = ends.unionByName(asks).withColumn("end", F.min("to").over(falling)).where("asks = 1 and end is not null")
    best = j.groupBy(*by).agg(F.min(F.struct((F.col("end") - F.col("bin")).alias("w"), F.col("end").alias("e"), F.col("bin").alias("b"), "lo", "width")).alias("x"))
    return best.select(*by, (F.col("x.lo") + F.col("x.b") * F.col("x.width")).alias("hdi_lo"), (F.col("x.lo") + (F.col("x.e") + 1) * F.col("x.width")).alias("hdi_hi"))


def hdi_exact(df: DataFrame, by: Sequence[str], value: str, share: float, r: DataFrame | None = None) -> DataFrame:
    """The shortest interval of sample values that holds ceil(share n) of them, the first of equals.

    Values are numbered by ``ranked``; of equal ones only the first can begin the
    shortest interval.  The places that beginnings ask for and the first places
    of the values are merged in cells of places; what a cell's first rows ask for
    comes from the last value of the cells before, so no group is in one task.
    """
    r = ranked(df, by, value) if r is None else r
    wide = F.greatest(F.lit(1), F.ceil(F.col("n") / 1024))
    goal = F.col("i") + F.ceil(F.col("n") * share) - 1
    none = F.lit(None).cast("double")
    ends = r.select(*by, F.floor(F.col("i") / wide).alias("cell"), F.col("i").alias("at"), F.lit(0).alias("asks"), F.col("v").alias("v2"), none.alias("v"), "i")
    asks = r.where(goal < F.col("n")).select(*by, F.floor(goal / wide).alias("cell"), goal.alias("at"), F.lit(1).alias("asks"), none.alias("v2"), "v", "i")
    last = ends.groupBy(*by, "cell").agg(F.max("v2").alias("last"))
    last = last.select(*by, F.col("cell").alias("before"), "last")
    every = asks.select(*by, "cell").distinct()
    # At most 1,024 cells a group.
    carried = every.join(last, list(by)) if by else every.crossJoin(last)
    carried = carried.where("before < cell").groupBy(*by, "cell").agg(F.max("last").alias("carried"))
    merged = Window.partitionBy(*by, "cell").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = ends.unionByName(asks).withColumn("v2", F.max("v2").over(merged)).where("asks = 1").join(carried, [*by, "cell"], "left")
    j = j.withColumn("v2", F.coalesce("v2", "carried"))
    return j.groupBy(*by).agg(F.min(F.struct((F.col("v2") - F.col("v")).alias("w"), F.col("i"), "v", "v2")).alias("x")).select(*by, F.col("x.v").alias("hdi_lo"), F.col("x.v2").alias("hdi_hi"))


def report(df: DataFrame, by: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """Moments, quartiles, histogram mode, density intervals and fences in one row per group.

    The table is read twice, for the moments and for the distinct values; the rest
    comes from these.  The ranked values, the bins and the few rows that describe
    them are written once, since several parts read them.
    """
    m = written(moments(df, by, value))
    r = written(ranked(df, by, value))
    n = F.col("n")
    q = written(at_places(r, by, {k: RULES["nearest"](n, p) for k, p in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))}))
    ends = m.select(*by, F.col("min").alias("lo"), F.col("max").alias("hi"), F.coalesce("std", F.lit(0.0)).alias("sd"))
    g = q.select(*by, "n", F.col("q25").alias("q1"), F.col("q75").alias("q3"))
    plan = written(bins_of(g.join(ends, list(by)) if by else g.crossJoin(ends), by))
    h = written(binned(r, by, plan))
    parts = [
        m, q.drop("n"), plan.select(*by, "bins", "width"), histogram_mode(h, by).select(*by, "mode"),
        hdi_histogram(h, by, share).select(*by, F.col("hdi_lo").alias("hdi_bin_lo"), F.col("hdi_hi").alias("hdi_bin_hi")), hdi_exact(df, by, value, share, r),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by)) if by else out.crossJoin(p)
    iqr = F.col("q75") - F.col("q25")
    return out.withColumn("fence_lo", F.col("q25") - 1.5 * iqr).withColumn("fence_hi", F.col("q75") + 1.5 * iqr)


def hdi_filtered(df: DataFrame, by: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """Moments of the values within the exact interval."""
    c = clean(df, by, value)
    e = written(hdi_exact(df, by, value, share))  # a row a group, as in ``histogram``
    c = c.join(e, list(by)) if by else c.crossJoin(e)
    return moments(c.where("v between hdi_lo and hdi_hi"), by, "v")


def mad_band(df: DataFrame, by: Sequence[str], value: str, k: float = 3.0, min_band: float = 1e-4) -> DataFrame:
    """Median +- k * 1.4826 * MAD; below 8 values the extremes; the band is at least ``min_band`` wide."""
    r = written(ranked(df, by, value))
    m = between_places(r, by, {"median": 0.5, "least": 0.0, "most": 1.0})
    j = with_mad(r, by, m)
    half = k * 1.4826 * F.col("mad")
    j = j.withColumn("lo", F.when(F.col("n") < 8, F.col("least")).otherwise(F.col("median") - half)).withColumn("hi", F.when(F.col("n") < 8, F.col("most")).otherwise(F.col("median") + half))
    wide = F.greatest(F.lit(min_band), F.lit(1e-4))
    narrow = F.col("hi") - F.col("lo") < wide
    mid = (F.col("lo") + F.col("hi")) / 2
    return j.select(*by, "n", "median", "mad", F.when(narrow, mid - wide / 2).otherwise(F.col("lo")).alias("lo"), F.when(narrow, mid + wide / 2).otherwise(F.col("hi")).alias("hi"))


def kde(df: DataFrame, by: Sequence[str], value: str, points: int = 64) -> DataFrame:
    """(by, k, x, density) of a Gaussian kernel with Silverman's bandwidth on a grid from the least to the largest value."""
    c = clean(df, by, value)
    p = c.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    c = c.groupBy(*by, "v").agg(F.count("*").alias("copies"))  # equal values add up before they meet the grid
    h = 1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    p = p.select(*by, "n", "lo", "hi", F.when(h > 0, h).otherwise(1e-3).alias("h"))
    p = written(p)  # a row a group, as in ``histogram``
    j = c.join(p, list(by)) if by else c.crossJoin(p)
    j = j.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    x = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1)
    u = (x - F.col("v")) / F.col("h")
    g = j.groupBy(*by, F.col("k").cast("long").alias("k"), x.alias("x")).agg(F.sum(F.col("copies") * F.exp(-0.5 * u * u)).alias("s"), F.first("n").alias("n"), F.first("h").alias("h"))
    return g.select(*by, "k", "x", (F.col("s") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def kde_interval(df: DataFrame, by: Sequence[str], value: str, mass: float = 0.85, points: int = 64) -> DataFrame:
    """The mode, and the extent of the densest grid points that hold the mass."""
    d = kde(df, by, value, points)
    w = Window.partitionBy(*by).orderBy(F.desc("density"), "k")
    d = d.withColumn("before", F.sum("density").over(w) - F.col("density")).withColumn("all", F.sum("density").over(Window.partitionBy(*by)))
    mode = F.max_by("x", F.struct("density", -F.col("k")))
    return d.groupBy(*by).agg(mode.alias("mode"), F.min(F.when(F.col("before") < mass * F.col("all"), F.col("x"))).alias("lo"), F.max(F.when(F.col("before") < mass * F.col("all"), F.col("x"))).alias("hi"))


def fixed_bin_mode(df: DataFrame, by: Sequence[str], value: str, lo: float = 0.0, hi: float = 4.0, width: float = 0.01) -> DataFrame:
    """Lower edge of the fullest bin in [lo, hi], the first of equals."""
    c = clean(df, by, value).where(F.col("v").between(lo, hi))
    b = c.groupBy(*by, F.floor((F.col("v") - lo) / width).alias("bin")).agg(F.count("*").alias("count"))
    return b.groupBy(*by).agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin"), F.max("count").alias("count")).select(*by, "bin", "count", (lo + F.col("bin") * width).alias("mode"))


def otsu(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Threshold of a 256-level histogram that separates two classes best, the first of equals."""
    h = df.groupBy(*by, F.floor(value).alias("t")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("t")
    every = Window.partitionBy(*by)
    h = h.withColumn("n0", F.sum("c").over(w)).withColumn("s0", F.sum(F.col("c") * F.col("t")).over(w)).withColumn("n", F.sum("c").over(every)).withColumn("s", F.sum(F.col("c") * F.col("t")).over(every))
    w0 = F.col("n0") / F.col("n")
    u0, u1 = F.col("s0") / F.col("n0"), F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("n0"))
    between = F.coalesce(w0 * (1 - w0) * (u0 - u1) * (u0 - u1), F.lit(0.0))
    h = h.withColumn("between", F.round(between, 6))
    return h.groupBy(*by).agg(F.max_by("t", F.struct("between", -F.col("t"))).alias("threshold"), F.max("between").alias("between"))


def min_max(df: DataFrame, by: Sequence[str], value: str, seeded: bool = False) -> DataFrame:
    """(v - min) / (max - min), 0 where they are equal; ``seeded`` lets 0 count among the values."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    if seeded:
        lo, hi = F.least(F.lit(0.0), lo), F.greatest(F.lit(0.0), hi)
    return df.withColumn("normal", F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0)))


def binned_quantiles(df: DataFrame, by: Sequence[str], value: str, *ps: float, width: float = 0.5) -> DataFrame:
    """Centre of the first bin whose running total reaches ceil(p n)."""
    b = clean(df, by, value).groupBy(*by, F.floor(F.col("v") / width).alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("bin")
    b = b.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return b.groupBy(*by).agg(*[((F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * p), F.col("bin"))) + 0.5) * width).alias(f"p{round(p * 100)}") for p in ps])


def patch_stats(df: DataFrame, by: Sequence[str], value: str, least: int = 8) -> DataFrame:
    """Median, MAD and the span from the 10 % to the 90 % quantile of groups of at least ``least`` values; a group is a patch, of bounded size."""
    c = clean(df, by, value)
    m = c.groupBy(*by).agg(F.median("v").alias("median"), F.count("*").alias("n"), (F.percentile("v", F.lit(0.9)) - F.percentile("v", F.lit(0.1))).alias("span")).where(F.col("n") >= least)
    mad = c.join(m.select(*by, "median"), list(by)).groupBy(*by).agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    return m.join(mad, list(by)).select(*by, "n", "median", "mad", "span")


def library(df: DataFrame, by: Sequence[str], value: str, other: str) -> DataFrame:
    """Covariance, correlation, X84 and quartile thresholds, signal-to-noise ratio."""
    c = df.select(*by, F.col(value).cast("double").alias("v"), F.col(other).cast("double").alias("u")).where(finite(F.col("v")) & finite(F.col("u")))
    g = c.groupBy(*by).agg(F.covar_pop("v", "u").alias("covariance"), F.corr("v", "u").alias("correlation"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    r = written(ranked(c, by, "v"))
    q = with_mad(r, by, between_places(r, by, {"median": 0.5, "q1": 0.25, "q3": 0.75}).drop("n"))
    return g.join(q, list(by)).select(
        *by, "covariance", "correlation", (F.col("median") + 5.2 * F.col("mad")).alias("x84"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("quartile_limit"),
        (20 * F.log10(F.try_divide(F.col("mean"), F.col("sd")))).alias("snr"),
    )


def signal_measures(df: DataFrame, by: Sequence[str], value: str, other: str) -> DataFrame:
    """N, the ratios of signal and of peak signal to the noise of ``other`` against ``value`` in decibels, and the bandwidth of a Gaussian kernel.

    Without any difference both ratios are infinite, without any signal 0.
    """
    c = df.select(*by, F.col(value).cast("double").alias("v"), F.col(other).cast("double").alias("u")).where(finite(F.col("v")) & finite(F.col("u")))
    g = c.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("signal"), F.sum((F.col("v") - F.col("u")) * (F.col("v") - F.col("u"))).alias("noise"),
        F.greatest(F.lit(0.0), F.max("v"), F.max("u")).alias("peak"), F.stddev_pop("v").alias("sd"),
    )

    def decibels(x: Column, noise: Column) -> Column:
        return F.when(noise <= 0, F.lit(float("inf"))).when(x <= 0, 0.0).otherwise(10 * F.log10(x / noise))

    return g.select(*by, "n", decibels(F.col("signal"), F.col("noise")).alias("snr"), decibels(F.col("peak") * F.col("peak"), F.col("noise") / F.col("n")).alias("psnr"), (F.pow(4 / (3.0 * F.col("n")), F.lit(0.2)) * F.col("sd")).alias("bandwidth"))
