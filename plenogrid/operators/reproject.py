"""Reprojection between tiles: bilinear look-ups, cycle consistency, disparity filters.

A tile's pixels travel as one array.  Edges join two tile rows, and the look-up
at a computed place is an array access, so a pixel never takes part in a join
and its four corners are never exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SITE, TILE
from .grid import spikes

SIDE = 8
PAIR = [*TILE, "ntile_x", "ntile_y"]


def tiles(df: DataFrame, *values: str, side: int = SIDE) -> DataFrame:
    """(tile, px): one array of structs per tile, in row-major order; the grid must be dense."""
    cell = F.struct((F.col("y") * side + F.col("x")).cast("int").alias("i"), *values)
    return df.groupBy(*TILE).agg(F.array_sort(F.collect_list(cell)).alias("px"))


def bilinear(array: Column, index: Column, right: Column, down: Column, ax: Column, ay: Column, field: str) -> Column:
    """A field's value at a fractional place of an array in row-major order; null unless all four corners are valid."""

    def corner(at: Column) -> Column:
        return F.get(array, at).getField(field)

    return (1 - ax) * (1 - ay) * corner(index) + (1 - ax) * ay * corner(index + down) + ax * (1 - ay) * corner(index + right) + ax * ay * corner(index + right + down)


def reprojected(disparity: DataFrame, edges: DataFrame, unit: float, *values: str, side: int = SIDE, nearest: Sequence[str] = ()) -> DataFrame:
    """For each valid pixel and neighbour, the place q in the neighbour and what stands there.

    q = p + u d s, s = baseline / unit.  Columns: the pixel, its d and values,
    qx, qy, scale, and ``n_<name>`` for d and the values, or for the columns ``nearest``
    what stands at the rounded place; places outside the neighbour are left out.  An edge is one row with both tiles' pixels; the places
    are computed and looked up within it, and only results become rows.
    """
    names = list(dict.fromkeys(["d", *values]))
    held = [*names, *nearest]
    t = tiles(disparity.withColumn("d", F.when(F.col("d") > 0, F.col("d"))), *held, side=side)
    e = edges.select(*PAIR, "ux", "uy", (F.col("baseline") / unit).alias("scale"))
    j = e.join(t, TILE).join(t.select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("px").alias("npx")), ["ntile_x", "ntile_y"])

    def place(p: Column) -> Column:
        x, y = (p["i"] % side).cast("long"), F.floor(p["i"] / side)
        return F.struct(x.alias("x"), y.alias("y"), *[p[n].alias(n) for n in held], (x + F.col("ux") * p["d"] * F.col("scale")).alias("qx"), (y + F.col("uy") * p["d"] * F.col("scale")).alias("qy"))

    def corner(c: Column) -> Column:
        x0, y0 = F.floor(c["qx"]), F.floor(c["qy"])
        return F.struct(
            c.alias("c"), (y0 * side + x0).cast("int").alias("at"), (x0 < side - 1).cast("int").alias("right"), (side * (y0 < side - 1).cast("int")).alias("down"), (c["qx"] - x0).alias("ax"), (c["qy"] - y0).alias("ay")
        )

    def looked_up(k: Column) -> Column:
        c = k["c"]
        rounded = F.get("npx", (F.floor(c["qy"] + 0.5) * side + F.floor(c["qx"] + 0.5)).cast("int"))
        return F.struct(
            *[c[n].alias(n) for n in ("x", "y", *held, "qx", "qy")], *[bilinear(F.col("npx"), k["at"], k["right"], k["down"], k["ax"], k["ay"], n).alias(f"n_{n}") for n in names],
            *[rounded.getField(n).alias(f"n_{n}") for n in nearest],
        )

    cells = F.transform(F.filter("px", lambda p: p["d"].isNotNull()), place)
    cells = F.filter(cells, lambda c: c["qx"].between(0, side - 1) & c["qy"].between(0, side - 1))
    j = j.select(*PAIR, "ux", "uy", "scale", F.explode(F.transform(F.transform(cells, corner), looked_up)).alias("c"))
    return j.select(*TILE, "c.x", "c.y", "ntile_x", "ntile_y", *[f"c.{n}" for n in held], "c.qx", "c.qy", "ux", "uy", "scale", *[f"c.n_{n}" for n in held])


def cycle_errors(disparity: DataFrame, edges: DataFrame, unit: float, *values: str) -> DataFrame:
    """Distance between a pixel and its projection there and back."""
    r = reprojected(disparity, edges, unit, *values).where("n_d is not null")
    bx = F.col("qx") - F.col("ux") * F.col("n_d") * F.col("scale") - F.col("x")
    by = F.col("qy") - F.col("uy") * F.col("n_d") * F.col("scale") - F.col("y")
    return r.withColumn("error", F.sqrt(bx * bx + by * by))


def view_costs(disparity: DataFrame, pixel: DataFrame, edges: DataFrame, unit: float) -> DataFrame:
    """Photometric cost of each pixel and view: intensity difference at the reprojected place over 64, clamped to [0, 2]."""
    both = disparity.join(pixel.select(*SITE, "v"), SITE)
    r = reprojected(both, edges, unit, "v").where("n_v is not null")
    return r.select(*SITE, "ntile_x", "ntile_y", "d", F.least(F.lit(2.0), F.abs(F.col("v") - F.col("n_v")) / 64).alias("cost"), "scale")


def filter_reasons(disparity: DataFrame, edges: DataFrame, unit: float, max_cost: float = 1.8, max_error: float = 0.5, least: int = 2, spike: float = 1.0, spike_neighbours: int = 3) -> DataFrame:
    """Every pixel with a reason: invalid, cost, no_support, cycle, spike or kept.

    Tiles are judged on the input of all tiles (a snapshot), the spike stage on
    what the earlier stages kept.
    """
    d, cost = F.col("d"), F.col("cost")
    first = F.when(d.isNull() | F.isnan(d) | (d <= 0), "invalid").when(cost.isNull() | F.isnan(cost) | (cost < 0) | (cost > max_cost), "cost")
    sites = disparity.select(*SITE, "d", "cost", first.alias("early"))
    e = cycle_errors(disparity, edges, unit, "cost").where(F.col("n_cost").between(0, max_cost))
    support = e.groupBy(*SITE).agg(F.count("*").alias("support"), F.count_if(F.col("error") <= max_error).alias("good"))
    j = sites.join(support, SITE, "left")
    j = j.withColumn("stage", F.when(F.col("early").isNotNull(), F.col("early")).when(F.coalesce("support", F.lit(0)) < least, "no_support").when(F.col("good") < least, "cycle").otherwise("kept"))
    s = spikes(j.where("stage = 'kept'"), "d", spike, spike_neighbours).where("spike = 1").select(*SITE, "spike")
    return j.join(s, SITE, "left").select(*SITE, "d", "cost", F.when(F.col("spike") == 1, "spike").otherwise(F.col("stage")).alias("reason"))


def filter_counts(reasons: DataFrame) -> DataFrame:
    """A36."""
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def cycle_metrics(errors: DataFrame) -> DataFrame:
    """Per-pixel mean over views, then per tile and overall: pixels, mean, root mean square."""
    px = errors.groupBy(*SITE).agg(F.avg("error").alias("e"))
    g = px.rollup(*TILE).agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.grouping_id().alias("level"))
    return g.where("level in (0, 3)").drop("level")


def completeness(errors: DataFrame, sites: DataFrame, limit: float = 0.5, k: int = 2) -> DataFrame:
    """Share of a tile's pixels with at least k views within the limit, with one, and with any view at all."""
    px = errors.groupBy(*SITE).agg(F.count("*").alias("views"), F.count_if(F.col("error") <= limit).alias("good"))
    j = sites.select(*SITE).join(px, SITE, "left")

    def share(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False))) / F.count("*")

    return j.groupBy(*TILE).agg(share(F.col("good") >= k).alias("joint"), share(F.col("good") >= 1).alias("single"), share(F.col("views") >= 1).alias("covered"))


def error_map(errors: DataFrame, most: float = 3.0, limit: float = 0.5) -> DataFrame:
    """Per-pixel median over at least two views, then n, mean, root mean square, p90 and the count within the limit of those up to ``most``."""
    px = errors.groupBy(*SITE).agg(F.median("error").alias("e"), F.count("*").alias("n")).where("n >= 2").where(F.col("e") <= most)
    return px.groupBy(*TILE).agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.percentile("e", F.lit(0.9)).alias("p90"), F.count_if(F.col("e") <= limit).alias("within"))


def left_right_check(disparity: DataFrame, edges: DataFrame, unit: float, limit: float = 1.0, least: int = 2, most: int = 8) -> DataFrame:
    """Pixels with at least ``least`` of ``most`` neighbours that agree within the limit at the rounded target."""
    r = reprojected(disparity, edges, unit)
    w = Window.partitionBy(*SITE).orderBy("ntile_y", "ntile_x")
    r = r.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    r = r.withColumn("tx", F.floor(F.col("qx") + 0.5)).withColumn("ty", F.floor(F.col("qy") + 0.5))
    there = disparity.where("d > 0").select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("d").alias("there"))
    j = r.join(there, ["ntile_x", "ntile_y", "tx", "ty"]).where(F.abs(F.col("d") - F.col("there")) <= limit)
    return j.groupBy(*SITE).agg(F.count("*").alias("agree")).where(F.col("agree") >= least)


def photo_residual(disparity: DataFrame, pixel: DataFrame, edges: DataFrame, unit: float) -> DataFrame:
    """difference of z-scores within 3 x 3 patches; of plain intensities where a patch is cut or flat."""
    from .grid import window_moments

    m = window_moments(pixel, 1).where("n = 9 and std > 1e-3").select(*SITE, F.col("mean").alias("m"), F.col("std").alias("s"))
    both = disparity.join(pixel.select(*SITE, "v"), SITE).join(m, SITE, "left")
    r = reprojected(both, edges, unit, "v", nearest=("m", "s")).where("n_v is not null")
    z = F.abs((F.col("v") - F.col("m")) / F.col("s") - (F.col("n_v") - F.col("n_m")) / F.col("n_s"))
    return r.select(*SITE, "ntile_x", "ntile_y", F.coalesce(z, F.abs(F.col("v") - F.col("n_v")) / 255).alias("residual"))


def gradient_buckets(errors: DataFrame, gradient: DataFrame, width: float = 10.0, most: int = 50) -> DataFrame:
    """Mean error by bucket of the gradient magnitude."""
    px = errors.groupBy(*SITE).agg(F.avg("error").alias("e")).join(gradient, SITE)
    return px.groupBy(F.least(F.lit(most), F.floor(F.col("sobel") / width)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg("e").alias("mean"))


def top_k_cost(costs: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k least costs, and how many views are at or below the k-th, ties included."""
    w = Window.partitionBy(*SITE)
    c = costs.withColumn("c", F.round("cost", 9)).withColumn("place", F.row_number().over(w.orderBy("c", "ntile_y", "ntile_x")))
    c = c.withColumn("kth", F.max(F.when(F.col("place") <= k, F.col("c"))).over(w))
    return c.groupBy(*SITE).agg(F.avg(F.when(F.col("place") <= k, F.col("cost"))).alias("mean"), F.count_if(F.col("c") <= F.col("kth")).alias("chosen"))


def weighted_cost(costs: DataFrame, weight: Column) -> DataFrame:
    """sum(w c) / sum(w), 2 where nothing weighs."""
    return costs.groupBy(*SITE).agg(F.coalesce(F.try_divide(F.sum(weight * F.col("cost")), F.sum(weight)), F.lit(2.0)).alias("cost"))


def blur_cost(cost: Column, blur: Column, other: Column) -> Column:
    """A26."""
    d = blur - other
    return cost + 0.8 * (1 - F.exp(-0.007368 * d * d))


def softmin_view(costs: DataFrame, ld: float = 1.0, lc: float = 1.0) -> DataFrame:
    """The view of the largest exp(-ld rank_d / N) exp(-lc rank_c / N); ranks count smaller ones, the first of equals wins."""
    w = Window.partitionBy(*SITE)
    c = costs.withColumn("dr", F.round("scale", 9)).withColumn("cr", F.round("cost", 9))
    c = c.withColumn("rd", F.rank().over(w.orderBy("dr")) - 1).withColumn("rc", F.rank().over(w.orderBy("cr")) - 1).withColumn("n", F.count("*").over(w))
    s = F.exp(-ld * F.col("rd") / F.col("n")) * F.exp(-lc * F.col("rc") / F.col("n"))
    c = c.withColumn("s", F.round(s, 9))
    best = c.groupBy(*SITE).agg(F.max_by(F.struct("ntile_x", "ntile_y", "s"), F.struct("s", -F.col("ntile_y"), -F.col("ntile_x"))).alias("b"))
    return best.select(*SITE, "b.ntile_x", "b.ntile_y", F.col("b.s").alias("score"))


def best_virtual_depth(costs: DataFrame, unit: float, centre: float = 0.2, spread: float = 8.0) -> DataFrame:
    """Virtual depth of the view with the largest (1 - cost) * exp(-(d - centre)^2 / spread), equals to nine places by key."""
    d = F.col("d") * F.col("scale")
    c = costs.withColumn("s", (1 - F.col("cost")) * F.exp(-(d - centre) * (d - centre) / spread))
    best = c.groupBy(*SITE).agg(F.max_by(F.struct("d", "s"), F.struct(F.round("s", 9), -F.col("ntile_y"), -F.col("ntile_x"))).alias("b"))
    return best.select(*SITE, (unit / F.col("b.d")).alias("vd"), F.col("b.s").alias("score"))


def view_draws(costs: DataFrame, draws: int = 15, limit: float = 0.8) -> DataFrame:
    """How often each view is drawn from the distribution of its weights.

    A view weighs exp(-c^2 / 0.18) times a prior of 0.9 below the cost limit
    and 0.1 above; W19 turns weights into running shares.  Draws are spread
    evenly over the unit interval from an offset that depends on the pixel's
    place, instead of a clock-seeded generator.
    """
    w = Window.partitionBy(*SITE)
    weight = F.exp(-F.col("cost") * F.col("cost") / 0.18) * F.when(F.col("cost") < limit, 0.9).otherwise(0.1)
    c = costs.withColumn("w", weight)
    cdf = F.sum("w").over(w.orderBy("ntile_y", "ntile_x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(w)
    c = c.withColumn("hi", F.round(cdf, 9)).withColumn("lo", F.round(cdf - F.col("w") / F.sum("w").over(w), 9))
    offset = ((31 * F.col("tile_x") + 17 * F.col("tile_y") + 7 * F.col("x") + 3 * F.col("y")) % 97) / 97.0
    # Draw k lies at (k + offset) / draws: count those in (lo, hi].
    n = F.floor(F.col("hi") * draws - offset) - F.floor(F.col("lo") * draws - offset)
    return c.select(*SITE, "ntile_x", "ntile_y", F.greatest(F.lit(0), n).cast("long").alias("drawn")).where("drawn > 0")
