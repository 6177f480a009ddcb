"""Fitting virtual depth to metric depth: segmentation, robust fits, error reports.

The model is gt = (c1 v + c2) / (1 - c0 v), linear in its coefficients as
gt = c0 gt v + c1 v + c2.  A fit needs a handful of sums per segment, so it is
one aggregation with partial sums, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written
from .stats import between_places, placed, ranked

#: Width of the grid on which virtual depths are segmented; it bounds the length of the fold.
GRID = 1e-3


def fit(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least squares on centred sums; null coefficients where they are not determined."""
    a = F.col("gt") * F.col("vd")
    t = df.withColumn("a", a)
    g = t.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_pop("a").alias("saa"), F.covar_pop("a", "vd").alias("sab"), F.var_pop("vd").alias("sbb"), F.covar_pop("a", "gt").alias("say"), F.covar_pop("vd", "gt").alias("sby"),
        F.avg("a").alias("ma"), F.avg("vd").alias("mb"), F.avg("gt").alias("my"),
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    c0 = F.when(F.abs(det) > 1e-12 * F.col("saa") * F.col("sbb"), F.try_divide(F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab"), det))
    c1 = F.when(F.abs(det) > 1e-12 * F.col("saa") * F.col("sbb"), F.try_divide(F.col("sby") * F.col("saa") - F.col("say") * F.col("sab"), det))
    g = g.withColumn("c0", c0).withColumn("c1", c1)
    return g.select(*by, "n", "c0", "c1", (F.col("my") - F.col("c0") * F.col("ma") - F.col("c1") * F.col("mb")).alias("c2"))


def predicted(vd: Column, c0: Column, c1: Column, c2: Column) -> Column:
    """F07."""
    return F.try_divide(c1 * vd + c2, 1 - c0 * vd)


def segments(df: DataFrame, size: int = 16, span: float = 0.04, far: float = 0.18, least: int = 8) -> DataFrame:
    """(seg_id, vd_min, vd_max, n): greedy cuts of the sorted virtual depths.

    A value starts a segment if the current one has ``size`` samples and would
    span ``span``, or has ``least`` and would span more than ``far``; a last
    segment of fewer than ``least`` joins the one before.  Equal values stay
    together: samples are counted on a grid first, so the fold runs over the
    grid's cells and not over samples.
    """
    cells = df.groupBy(F.round(F.col("vd") / GRID).cast("long").alias("k")).agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct("k", "c")))
    # The segment that still grows is kept apart from the finished ones, which are copied only at a cut.
    zero = F.expr("cast(named_struct('done', array(), 'last', null) as struct<done:array<struct<a:bigint,b:bigint,n:bigint>>,last:struct<a:bigint,b:bigint,n:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        width = (x["k"] - last["a"]) * GRID
        cut = F.coalesce(((last["n"] >= size) & (width >= span - 1e-9)) | ((width > far + 1e-9) & (last["n"] >= least)), F.lit(True))
        new = F.struct(x["k"].alias("a"), x["k"].alias("b"), x["c"].alias("n"))
        more = F.struct(last["a"].alias("a"), x["k"].alias("b"), (last["n"] + x["c"]).alias("n"))
        done = F.when(cut & last.isNotNull(), F.concat(acc["done"], F.array(last))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(cut, new).otherwise(more).alias("last"))

    s = cells.agg(F.aggregate(order, zero, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["last"])), lambda g: g.isNotNull())).alias("s")).select(F.posexplode("s").alias("seg_id", "g")).select("seg_id", "g.*")
    total = F.max("seg_id").over(Window.partitionBy())
    s = s.withColumn("last", total)
    s = s.withColumn("seg_id", F.when((F.col("seg_id") == F.col("last")) & (F.col("n") < least) & (F.col("last") > 0), F.col("seg_id") - 1).otherwise(F.col("seg_id")))
    return s.groupBy("seg_id").agg((F.min("a") * GRID).alias("vd_min"), (F.max("b") * GRID).alias("vd_max"), F.sum("n").alias("n"))


def stitched(segs: DataFrame, least: float = 1e-4) -> DataFrame:
    """Neighbouring ends meet in the middle; a segment is at least ``least`` wide.  A few rows, so one window over all is small."""
    w = Window.orderBy("seg_id")
    lo = F.coalesce((F.lag("vd_max").over(w) + F.col("vd_min")) / 2, F.col("vd_min"))
    hi = F.coalesce((F.lead("vd_min").over(w) + F.col("vd_max")) / 2, F.col("vd_max"))
    return segs.withColumn("lo", lo).withColumn("hi", hi).withColumn("hi", F.greatest(F.col("hi"), F.col("lo") + least))


def located(df: DataFrame, segs: DataFrame) -> DataFrame:
    """The segment [lo, hi) of each sample, the last one closed; null outside.

    A segment stands in every cell of the grid that it touches, and a sample
    meets the one or two segments of its own cell in an equi-join.
    """
    last = F.max("seg_id").over(Window.partitionBy())  # over segments, whose number the grid bounds
    cells = segs.select("seg_id", "lo", "hi", (F.col("seg_id") == last).alias("closed"), F.explode(F.sequence(F.floor(F.col("lo") / GRID), F.floor(F.col("hi") / GRID))).alias("cell"))
    cells = written(cells)
    holds = (F.floor(df["vd"] / GRID) == cells["cell"]) & (df["vd"] >= cells["lo"]) & ((df["vd"] < cells["hi"]) | (cells["closed"] & (df["vd"] <= cells["hi"])))
    return df.join(cells, holds, "left").drop("lo", "hi", "closed", "cell")


def robust_fit(df: DataFrame, by: Sequence[str], floor: float = 800.0, least: int = 3) -> DataFrame:
    """Fit, drop residuals beyond max(floor, 3 max(MAD, 1)), fit again; the first fit stays where fewer than ``least`` are left."""
    df = written(df.select(*by, "vd", "gt"))
    first = written(fit(df, by))
    j = df.join(first.drop("n"), list(by))
    j = j.withColumn("r", F.abs(F.col("gt") - predicted(F.col("vd"), F.col("c0"), F.col("c1"), F.col("c2"))))
    j = written(j.select(*by, "vd", "gt", "r"))
    gate = between_places(ranked(j, by, "r"), by, {"median": 0.5}).select(*by, F.greatest(F.lit(floor), 3 * F.greatest(F.col("median"), F.lit(1.0))).alias("gate"))
    kept = j.join(written(gate), list(by)).where("r <= gate").select(*by, "vd", "gt")
    again = fit(kept, by)
    out = first.join(again.select(*by, F.col("n").alias("n2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("c2").alias("d2")), list(by), "left")
    ok = F.coalesce((F.col("n2") >= least) & F.col("d0").isNotNull(), F.lit(False))
    return out.select(*by, "n", F.coalesce("n2", F.lit(0)).alias("used"), *[F.when(ok, F.col(d)).otherwise(F.col(c)).alias(c) for c, d in (("c0", "d0"), ("c1", "d1"), ("c2", "d2"))])


def unimodal(df: DataFrame, by: Sequence[str], width: float = 2500.0, purity: float = 0.58, gap: float = 0.10, least: int = 12) -> DataFrame:
    """Groups of at least ``least`` samples whose fullest depth bin holds most and leads the second clearly."""
    b = df.groupBy(*by, F.floor(F.col("gt") / width).alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(F.desc("c"), "bin")
    b = b.withColumn("k", F.row_number().over(w))
    g = b.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.when(F.col("k") == 1, F.col("c"))).alias("best"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("c"))), F.lit(0)).alias("second"))
    ok = (F.col("n") >= least) & (F.col("best") / F.col("n") >= purity) & ((F.col("best") - F.col("second")) / F.col("n") >= gap)
    return g.select(*by, "n", (F.col("best") / F.col("n")).alias("purity"), ok.cast("int").alias("unimodal"))


def unimodal_fit(df: DataFrame, by: Sequence[str], weak: int = 8, **gate: float) -> DataFrame:
    """The robust fit of groups whose depths are unimodal; groups that keep fewer than ``weak`` samples are dropped."""
    df = written(df.select(*by, "vd", "gt"))
    good = unimodal(df, by, **gate).where("unimodal = 1").select(*by)
    return robust_fit(df.join(good, list(by), "left_semi"), by).where(F.greatest("used", F.when(F.col("used") < 3, F.col("n")).otherwise(F.lit(0))) >= weak)


def error_report(df: DataFrame) -> DataFrame:
    """Per segment, and over all as segment null: n, MSE, RMSE, MAE, median error, and samples outside every segment.

    ``df`` has seg_id (null outside), gt and pred.
    """
    e = F.col("gt") - F.col("pred")
    t = df.select("seg_id", e.alias("e"))
    g = t.rollup("seg_id").agg(
        F.count("e").alias("n"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.count_if(F.col("e").isNull()).alias("outside"), F.grouping("seg_id").alias("total")
    )
    # The total is a group as well; its median is that of the segments' counted values.
    far = written(t.where("e is not null").groupBy("seg_id", F.abs("e").alias("v")).agg(F.count("*").alias("copies")))
    both = far.where("seg_id is not null").withColumn("total", F.lit(0)).unionByName(far.groupBy("v").agg(F.sum("copies").alias("copies")).withColumns({"seg_id": F.lit(None).cast(df.schema["seg_id"].dataType), "total": F.lit(1)}))
    key = F.struct("total", F.coalesce("seg_id", F.lit(-1)).alias("seg_id"))
    median = between_places(placed(both.select(key.alias("key"), "v", "copies"), ["key"]), ["key"], {"median": 0.5}).drop("n")
    g = g.withColumn("key", F.struct(F.col("total").cast("int").alias("total"), F.coalesce("seg_id", F.lit(-1)).alias("seg_id"))).join(median, "key", "left")
    return g.where("total = 1 or seg_id is not null").select("seg_id", "n", "mse", F.sqrt("mse").alias("rmse"), "mae", "median", "outside", F.col("total").cast("int").alias("total"))


def thinned(df: DataFrame, value: str, group: float = 1000.0, sub: float = 100.0, keep: int = 10) -> DataFrame:
    """The ``keep`` smallest values of every subgroup of every group."""
    g = F.floor(F.col(value) / group)
    s = F.floor((F.col(value) - g * group) / sub)
    t = df.withColumn("grp", g).withColumn("sub", s)
    return t.withColumn("place", F.row_number().over(Window.partitionBy("grp", "sub").orderBy(value))).where(F.col("place") <= keep)
