"""Multi-view operators: classic fusion, cross-view proposals, planar priors, region growing, sample selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import project, unproject
from ..schema import SITE, TILE
from ..steps import written
from .grid import SIDE, at_centre, inside, median_of, on_tiles, scatter, square


def fuse_views(depths: DataFrame, pairs: DataFrame, cameras: DataFrame, pixels: float = 2.0, share: float = 0.01, angle: float = 0.174533, least: int = 2) -> DataFrame:
    """Points of reference pixels that at least ``least`` source views confirm.

    ``depths`` is (image, x, y, depth, nx, ny, nz, v), ``pairs`` (ref, src) and
    ``cameras`` (image, k, r, t) with arrays of 9, 9 and 3 numbers.  The place in
    the source view is a computed key, so each view is an equi-join.  A view
    confirms where the way back ends within ``pixels``, the depth differs by less
    than ``share`` and the normals by less than ``angle``.  Point, normal and value
    are means over the confirming views and the reference.  All pixels are judged
    on the input, none is marked as used.
    """
    d = depths.where("depth > 0").join(cameras, "image")
    K, R, T = F.col("k"), F.col("r"), F.col("t")
    there = cameras.select(F.col("image").alias("src"), F.col("k").alias("sk"), F.col("r").alias("sr"), F.col("t").alias("st"))
    w = unproject(F.col("x"), F.col("y"), F.col("depth"), K, R, T)
    ref = d.withColumns({f"w{i}": c for i, c in enumerate(w)})
    r = ref.withColumnRenamed("image", "ref").join(pairs, "ref").join(there, "src")
    u, v, _ = project([F.col(f"w{i}") for i in range(3)], F.col("sk"), F.col("sr"), F.col("st"))
    r = r.withColumn("sx", F.floor(u + 0.5)).withColumn("sy", F.floor(v + 0.5))
    seen = ref.select(F.col("image").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), *[F.col(f"w{i}").alias(f"q{i}") for i in range(3)], *[F.col(c).alias(f"s{c}") for c in ("nx", "ny", "nz", "v")])
    j = r.drop("sk", "sr", "st").join(seen, ["src", "sx", "sy"])
    bu, bv, bz = project([F.col(f"q{i}") for i in range(3)], K, R, T)
    j = j.withColumns({"bu": bu, "bv": bv, "bz": bz, "turn": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((F.col(f"n{a}") * F.col(f"sn{a}") for a in "xyz"), F.lit(0.0)))))})
    ok = (F.hypot(F.col("bu") - F.col("x"), F.col("bv") - F.col("y")) < pixels) & (F.abs(F.col("bz") - F.col("depth")) / F.col("depth") < share) & (F.col("turn") < angle)
    own = {"px": "w0", "py": "w1", "pz": "w2", "nx": "nx", "ny": "ny", "nz": "nz", "v": "v"}
    other = {"px": "q0", "py": "q1", "pz": "q2", "nx": "snx", "ny": "sny", "nz": "snz", "v": "sv"}
    # Within a pixel's rows its own columns are all the same.
    g = j.where(ok).groupBy("ref", "x", "y").agg(F.count("*").alias("n"), *[((F.sum(other[k]) + F.first(own[k])) / (F.count("*") + 1)).alias(k) for k in own])
    return g.where(F.col("n") >= least)


def proposals(reprojected: DataFrame, disparity: DataFrame) -> DataFrame:
    """The disparity of the cheapest neighbour pixel that a site reprojects to, rounded to its pixel."""
    r = reprojected.withColumn("tx", F.floor(F.col("qx") + 0.5)).withColumn("ty", F.floor(F.col("qy") + 0.5))
    there = disparity.where("d > 0").select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("d").alias("pd"), F.col("cost").alias("pc"))
    j = r.select(*SITE, "ntile_x", "ntile_y", "tx", "ty").join(there, ["ntile_x", "ntile_y", "tx", "ty"])
    return j.groupBy(*SITE).agg(F.min_by(F.struct("pd", "pc"), F.struct(F.round("pc", 9), "ntile_y", "ntile_x")).alias("b")).select(*SITE, F.col("b.pd").alias("d"), F.col("b.pc").alias("cost"))


def planar_prior(disparity: DataFrame, block: int = 4) -> DataFrame:
    """Disparities of the planes through the cheapest pixel of each block.

    A tile's four supports span two triangles along the diagonal from the
    upper right to the lower left; each pixel takes the plane of its side.
    Tiles without four supports have no prior.
    """
    b = (F.floor(F.col("y") / block) * 2 + F.floor(F.col("x") / block)).cast("int")
    best = disparity.where("d is not null").groupBy(*TILE, b.alias("b")).agg(F.min_by(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "d"), F.struct(F.round("cost", 9), "y", "x")).alias("p"))
    t = best.groupBy(*TILE).agg(*[F.max(F.when(F.col("b") == k, F.col("p"))).alias(f"s{k}") for k in range(4)]).where("s0 is not null and s1 is not null and s2 is not null and s3 is not null")
    j = disparity.select(*SITE).join(t, TILE)

    def side(ax: Column, ay: Column) -> Column:
        return (F.col("s2.x") - F.col("s1.x")) * (ay - F.col("s1.y")) - (F.col("s2.y") - F.col("s1.y")) * (ax - F.col("s1.x"))

    own = side(F.col("x"), F.col("y")) * side(F.col("s0.x"), F.col("s0.y")) >= 0
    j = j.select(*SITE, "s1", "s2", F.when(own, F.col("s0")).otherwise(F.col("s3")).alias("c"))
    ux, uy, ud = (F.col(f"s1.{a}") - F.col(f"c.{a}") for a in ("x", "y", "d"))
    vx, vy, vd = (F.col(f"s2.{a}") - F.col(f"c.{a}") for a in ("x", "y", "d"))
    det = ux * vy - uy * vx
    px, py = F.col("x") - F.col("c.x"), F.col("y") - F.col("c.y")
    a, b2 = F.try_divide(px * vy - py * vx, det), F.try_divide(ux * py - uy * px, det)
    return j.select(*SITE, (F.col("c.d") + a * ud + b2 * vd).alias("prior")).where("prior is not null")


def _triangles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners (i, j, k), in order, of all triangles of the points whose circle holds no other point inside; whole coordinates, so all signs are exact."""
    t = np.array(list(combinations(range(len(x)), 3)), np.int64).reshape(-1, 3)
    px, py = x[t], y[t]
    turn = (px[:, 1] - px[:, 0]) * (py[:, 2] - py[:, 0]) - (py[:, 1] - py[:, 0]) * (px[:, 2] - px[:, 0])
    t, px, py, turn = t[turn != 0], px[turn != 0], py[turn != 0], turn[turn != 0]
    ax, ay = px[:, None, :] - x[None, :, None], py[:, None, :] - y[None, :, None]
    q = ax * ax + ay * ay
    inside = sum(q[..., i] * (ax[..., j] * ay[..., k] - ax[..., k] * ay[..., j]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
    return t[~(inside * np.sign(turn)[:, None] > 0).any(1)]


def delaunay_prior(disparity: DataFrame, block: int = 3, good: float = 2.0, side: int = SIDE) -> DataFrame:
    """(site, a, b, c, prior) of the pixels inside the Delaunay triangulation of a tile's supports: d = a x + b y + c through the corners.

    A support is the cheapest valid pixel of a block, if it costs less than
    ``good``.  Where points on one circle leave the triangulation open, a pixel
    takes the triangle whose corners come first, row by row.  A tile has a support
    a block at most, and nothing else meets in a task.
    """
    own = disparity.where(F.col("d").isNotNull() & (F.col("cost") < good))
    best = own.groupBy(*TILE, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.min_by(F.struct("y", "x", "d"), F.struct(F.round("cost", 9), "y", "x")).alias("p"))
    supports = best.groupBy(*TILE).agg(F.array_sort(F.collect_list("p")).alias("p")).where(F.size("p") >= 3)
    py, px = (w.ravel() for w in np.mgrid[:side, :side])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tx, ty, p in zip(*(batch.column(c).to_pylist() for c in ("tile_x", "tile_y", "p")), strict=True):
                x, y, d = np.array([e["x"] for e in p], np.int64), np.array([e["y"] for e in p], np.int64), np.array([e["d"] for e in p])
                t = _triangles(x, y)
                if not len(t):
                    continue
                (x0, x1, x2), (y0, y1, y2), (d0, d1, d2) = (v[t].T for v in (x, y, d))
                turn = (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)
                a, b = ((d1 - d0) * (y2 - y0) - (d2 - d0) * (y1 - y0)) / turn, ((d2 - d0) * (x1 - x0) - (d1 - d0) * (x2 - x0)) / turn
                c = d0 - a * x0 - b * y0
                hit = np.ones((len(t), len(px)), bool)
                for (ax, ay), (bx, by) in (((x0, y0), (x1, y1)), ((x1, y1), (x2, y2)), ((x2, y2), (x0, y0))):
                    hit &= ((bx - ax)[:, None] * (py - ay[:, None]) - (by - ay)[:, None] * (px - ax[:, None])) * np.sign(turn)[:, None] >= 0
                at, first = np.flatnonzero(hit.any(0)), hit.argmax(0)
                f = first[at]
                columns = [px[at], py[at], a[f], b[f], c[f], a[f] * px[at] + b[f] * py[at] + c[f]]
                yield pa.RecordBatch.from_arrays([pa.array([tx] * len(at), pa.int64()), pa.array([ty] * len(at), pa.int64()), *(pa.array(v) for v in columns)], ["tile_x", "tile_y", "x", "y", "a", "b", "c", "prior"])

    return supports.mapInArrow(apply, "tile_x long, tile_y long, x long, y long, a double, b double, c double, prior double")


def grown(df: DataFrame, seeds: DataFrame, gate: float = 0.3, rounds: int | None = None) -> DataFrame:
    """(site, step) of pixels reached from the seeds over neighbours that differ by at most the gate.

    Grows until a round adds no pixel, or for ``rounds`` rounds where that is given.  Regions stay in their tile, whose pixels all lie within the radius
    of 18 that the method allows.
    """
    def work(there: np.ndarray, d: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        step = np.where(np.isnan(start), -1, 0)
        last, r = start, 0
        while rounds is None or r < rounds:
            r += 1
            near = np.pad(last, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
            seen = [near[:, 1:-1, :-2], near[:, 1:-1, 2:], near[:, :-2, 1:-1], near[:, 2:, 1:-1]]
            new = np.any([np.abs(d - n) <= gate for n in seen], axis=0) & (step < 0)
            if not new.any():
                break
            step[new] = r
            last = np.where(new, d, np.nan)
        return {"step": step, "keep": step >= 0}

    none = F.lit(None).cast("double")
    both = df.where("d is not null").select(*SITE, "d", none.alias("start")).unionByName(seeds.select(*SITE, none.alias("d"), F.col("d").alias("start")))
    return on_tiles(both.groupBy(*SITE).agg(F.max("d").alias("d"), F.max("start").alias("start")), ["d", "start"], work, "step bigint")


def edge_proxies(df: DataFrame, bad: DataFrame, radius: int = 2, alike: float = 20.0) -> DataFrame:
    """For each bad edge pixel the disparity of the pixel in its square that is most like it in intensity, nearer ones first.

    ``df`` is (site, v, d) with null where there is no trusted disparity, ``bad``
    the sites to repair.  Pixels that differ by more than ``alike`` are no proxies.
    """
    sources = df.where("d is not null").select(*SITE, "d", F.col("v").alias("u"))
    s = scatter(sources, square(radius, centre=False)).join(df.select(*SITE, "v"), SITE).join(bad.select(*SITE), SITE, "left_semi")
    far = F.abs(F.col("u") - F.col("v"))
    s = s.where(far <= alike)
    key = F.struct(far, (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("q"), "dy", "dx")
    return s.groupBy(*SITE).agg(F.min_by(F.struct("d", "dx", "dy"), key).alias("p")).select(*SITE, "p.d", F.col("p.dx").cast("long").alias("dx"), F.col("p.dy").cast("long").alias("dy"))


def edges_repaired(df: DataFrame, bad: DataFrame, radius: int = 2, alike: float = 20.0) -> DataFrame:
    """I06, propagation: (site, d, round) of the bad pixels that proxies reach; repaired pixels serve as proxies in the next round, until none is added."""
    now, found = df.select(*SITE, "v", "d"), None
    for r in count(1):
        new = written(edge_proxies(now, bad, radius, alike).select(*SITE, "d", F.lit(r).alias("round")))
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            return found
        bad = written(bad.join(new.select(*SITE), SITE, "left_anti"))
        now = written(now.join(new.select(*SITE, F.col("d").alias("new")), SITE, "left").select(*SITE, "v", F.coalesce("d", "new").alias("d")))


def spaced(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: int, distance: float) -> DataFrame:
    """Of each group the first in ``order`` that lies ``distance`` or more from those taken before, ``keep`` at most, numbered from 1.

    A round takes one of each group and drops what is too near to it, so rounds
    are as many as samples, and a group is never in one task.
    """
    rest, found = df.select(*by, "x", "y", *[c for c in order if c not in ("x", "y", *by)]), None
    for k in range(1, keep + 1):
        rest = written(rest)
        taken = rest.groupBy(*by).agg(F.min(F.struct(*order, F.col("x").alias("_x"), F.col("y").alias("_y"))).alias("t"))
        taken = written(taken.select(*by, F.col("t._x").alias("px"), F.col("t._y").alias("py"), *[F.col(f"t.{c}").alias(c) for c in order if c not in ("x", "y")]))
        pick = taken.select(*by, F.lit(k).alias("place"), F.col("px").alias("x"), F.col("py").alias("y"), *[c for c in order if c not in ("x", "y")])
        found = pick if found is None else found.unionByName(pick)
        j = rest.join(taken.select(*by, "px", "py"), list(by))
        rest = j.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) >= distance).select(rest.columns)
    return found


def selected_samples(df: DataFrame, mad: float = 0.08, span: float = 0.8, bins: int = 8, most: int = 24) -> DataFrame:
    """Stable pixels, spread over disparity bins and grid cells.

    Gates on the MAD and the span of the 3 x 3 patch; the penalty is mad + span
    / 4; a bin takes its cells in turn, the least penalty of each first.
    """
    s = scatter(df.where("d is not null").select(*SITE, "d"), square(1)).where(inside()).groupBy(*SITE).agg(at_centre(F.col("d")).alias("d"), F.collect_list("d").alias("p")).where("d is not null")
    s = s.where(F.size("p") >= 5).withColumn("m", median_of(F.col("p")))
    s = s.withColumn("mad", median_of(F.transform("p", lambda v: F.abs(v - F.col("m"))))).withColumn("span", F.array_max("p") - F.array_min("p")).where((F.col("mad") <= mad) & (F.col("span") <= span))
    edge = s.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    s = s.crossJoin(F.broadcast(edge))  # one row
    s = s.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("d") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))))
    s = s.withColumn("cx", F.floor(F.col("tile_x") / 5)).withColumn("cy", F.floor(F.col("tile_y") / 5)).withColumn("penalty", F.round(F.col("mad") + F.col("span") / 4, 9))
    s = s.withColumn("turn", F.row_number().over(Window.partitionBy("bin", "cx", "cy").orderBy("penalty", "tile_y", "tile_x", "y", "x"))).where(F.col("turn") <= most)
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("bin").orderBy("turn", "cy", "cx"))).where(F.col("place") <= most)
    return s.select("bin", "place", *SITE, "d", "penalty")


def remapped(df: DataFrame, cx: float, cy: float, k1: float) -> DataFrame:
    """(gx, gy, v): each place takes the pixel at centre + (1 + k1 r^2) (place - centre), rounded."""
    dx, dy = F.col("gx") - cx, F.col("gy") - cy
    f = 1 + k1 * (dx * dx + dy * dy)
    to = df.select("gx", "gy", F.floor(cx + f * dx + 0.5).alias("sx"), F.floor(cy + f * dy + 0.5).alias("sy"))
    return to.join(df.select(F.col("gx").alias("sx"), F.col("gy").alias("sy"), "v"), ["sx", "sy"]).select("gx", "gy", "v")
