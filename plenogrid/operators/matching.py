"""Matching by relaxation of disparity planes.

Every pixel of every micro-image holds a plane, d(x, y) = a x + b y + c, its cost
and the views that support it.  A step is a Spark join: each tile gets the
current planes of its neighbours, and the tiles of a task are updated together in
arrays.  A tile is a row of bounded size, nothing else meets in a task, and every
step is written, so that a lost executor repeats one step.

A step updates the black or the white pixels of all tiles from the state before:

* the cost of a plane in a view is one minus the bilaterally weighted correlation
  of the pixel's patch with the patch that the plane maps it to, from 0 to 2;
* eight neighbourhoods, near and far in four directions, propose the plane of
  their cheapest pixel;
* views are drawn fifteen times from what those proposals cost there, times a
  prior that counts in which of the four adjacent pixels a view is chosen (I02);
* the cheapest plane by the drawn weights stays: the own one, the eight proposed
  ones, those that the chosen views' pixels hold, carried over to this tile, and
  five perturbed ones (I03);
* with a coarser level's result as seed, a valid seed comes back where cost and
  supporting views together speak no more against it than against the found plane (I04);
* cost and views are then taken anew from the best few views of the final plane.

Random numbers are hashes of the tile, the pixel, the step and their place, so a
step that runs again gives the same planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SITE, TILE
from ..steps import written
from .reproject import tiles

# Fixed values of the method.
DRAWS, PRIOR, WORST = 15, (0.1, 0.9), 2.0
GOOD, GOOD_FALL, BAD = 0.8, 90.0, 1.2
TEMPERATURE, DOUBT = 0.18, 0.32
JITTER, TURN, SEED_TURN = 0.02, 0.02 * np.pi, 0.015 * np.pi
SEED_JITTER = 0.15
#: Cost that one more supporting view makes up for, when a coarser level's plane is held against the one found.
VIEW_WORTH = 0.02
#: Patches that are held against a view together; their arrays stay in a core's cache.
PAIRS = 512
#: Views are bits of a signed 64-bit number.
MOST_VIEWS = 63


@dataclass(frozen=True)
class Settings:
    """Side of a tile, patch radius, supporting views, range of disparities, distance of adjacent lenses, bilateral widths."""

    side: int = 8
    radius: int = 2
    top: int = 5
    least: float = 0.5
    most: float = 4.0
    unit: float = 12.0
    near: float = 5.0
    alike: float = 30.0


def uniform(tile: np.ndarray, pixel: np.ndarray, step: int, place: int) -> np.ndarray:
    """Numbers in [0, 1) from (tile number, pixel, step, place)."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = tile.astype(u) * u(0x9E3779B97F4A7C15) + pixel.astype(u) * u(0xC2B2AE3D27D4EB4F) + u(step * 1000 + place) * u(0x165667B19E3779F9)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            x = (x ^ (x >> u(shift))) * u(factor)
    return (x >> u(11)).astype(np.float64) / 2.0**53


@dataclass
class Scene:
    """The tiles of a batch: intensities (tile, y, x), and per view its shift a unit of disparity and its intensities."""

    image: np.ndarray
    shift: np.ndarray
    view: np.ndarray
    there: np.ndarray
    number: np.ndarray
    s: Settings

    @cached_property
    def patches(self) -> tuple[np.ndarray, ...]:
        """Per pixel of a tile: places of its patch; per pixel of each tile: intensities and weights there; the views with their last row and column twice."""
        s, r = self.s, self.s.radius
        i, j = (w.ravel() for w in np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1)))
        p = np.arange(s.side**2)
        x, y = p % s.side, p // s.side
        rx, ry = x[:, None] + i, y[:, None] + j
        inside = (rx >= 0) & (rx < s.side) & (ry >= 0) & (ry < s.side)
        ref = self.image[:, np.clip(ry, 0, s.side - 1), np.clip(rx, 0, s.side - 1)]
        own = self.image[:, y, x]
        weight = np.where(inside, np.exp(-np.hypot(i, j) / (2 * s.near**2) - np.abs(ref - own[:, :, None]) / (2 * s.alike**2)), 0.0)
        m = len(self.image) * s.side**2
        return rx.astype(float), ry.astype(float), ref.reshape(m, -1), weight.reshape(m, -1), np.pad(self.view, ((0, 0), (0, 0), (0, 1), (0, 1)), mode="edge").ravel()

    def costs(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, plane: np.ndarray, wanted: np.ndarray | bool = True) -> np.ndarray:
        """Cost of each pixel's plane (n, 3) in each view; the worst one where a view is not wanted."""
        s = self.s
        d0 = (plane[:, 0] * x + plane[:, 1] * y + plane[:, 2])[:, None]
        px, py = x[:, None] + self.shift[t, :, 0] * d0, y[:, None] + self.shift[t, :, 1] * d0
        seen = (px >= 0) & (px < s.side) & (py >= 0) & (py < s.side) & self.there[t] & wanted
        cost = np.full(seen.shape, WORST)
        row, v = np.nonzero(seen)
        for lo in range(0, len(row), PAIRS):
            i, j = row[lo : lo + PAIRS], v[lo : lo + PAIRS]
            cost[i, j] = self._correlated(t[i], (y * s.side + x)[i], j, plane[i])
        return cost

    def _correlated(self, t: np.ndarray, p: np.ndarray, v: np.ndarray, plane: np.ndarray) -> np.ndarray:
        """Cost of planes of pixels p in one view each."""
        s, (places_x, places_y, refs, weights, views) = self.s, self.patches
        at, shift = t * s.side**2 + p, self.shift[t, v]
        rx, ry, a = places_x[p], places_y[p], refs[at]
        d = plane[:, :1] * rx + plane[:, 1:2] * ry + plane[:, 2:]
        qx, qy = shift[:, :1] * d, shift[:, 1:] * d
        qx += rx
        qy += ry
        w = weights[at] * ((qx >= 0) & (qx < s.side) & (qy >= 0) & (qy < s.side))
        np.clip(qx, 0, s.side - 1, out=qx)
        np.clip(qy, 0, s.side - 1, out=qy)
        x0, y0 = qx.astype(np.int64), qy.astype(np.int64)
        qx -= x0
        qy -= y0
        width = s.side + 1
        y0 *= width
        y0 += x0
        y0 += ((t * self.view.shape[1] + v) * width**2)[:, None]
        bx, by = 1 - qx, 1 - qy
        src, below = views.take(y0), views[width:].take(y0)
        src *= bx
        src += qx * views[1:].take(y0)
        src *= by
        below *= bx
        below += qx * views[width + 1 :].take(y0, mode="clip")
        below *= qy
        src += below
        total = w.sum(1)
        safe = np.maximum(total, 1e-300)
        wa, wb = w * a, w * src
        ma, mb = wa.sum(1) / safe, wb.sum(1) / safe
        cov = (wa * src).sum(1) / safe - ma * mb
        wa *= a
        wb *= src
        va, vb = wa.sum(1) / safe - ma * ma, wb.sum(1) / safe - mb * mb
        flat = (total <= 1e-6) | (va < 1e-5) | (vb < 1e-5)
        return np.where(flat, WORST, np.clip(1 - cov / np.sqrt(np.where(flat, 1.0, va * vb)), 0.0, WORST))

    def supported(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean cost over the best views, and which views cost no more than the last of them."""
        c = self.costs(t, x, y, plane)
        ranked = np.sort(c, axis=1)
        k = np.minimum((c < WORST).sum(1), self.s.top)
        first = np.arange(c.shape[1]) < k[:, None]
        mean = np.where(k > 0, np.where(first, ranked, 0.0).sum(1) / np.maximum(k, 1), WORST)
        last = ranked[np.arange(len(c)), np.maximum(k - 1, 0)]
        return mean, (c <= last[:, None]) & (k > 0)[:, None]


def through(x: np.ndarray, y: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The plane of disparity d at (x, y) with the given normals."""
    a, b = -n[:, 0] / n[:, 2], -n[:, 1] / n[:, 2]
    return np.stack([a, b, d - a * x - b * y], 1)


def normal_of(plane: np.ndarray) -> np.ndarray:
    n = np.stack([-plane[:, 0], -plane[:, 1], np.ones(len(plane))], 1)
    return n / np.sqrt((n * n).sum(1, keepdims=True))


def random_normal(u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    r = 0.99 * np.sqrt(u1)
    return np.stack([r * np.cos(2 * np.pi * u2), r * np.sin(2 * np.pi * u2), np.sqrt(1 - r * r)], 1)


def turned(n: np.ndarray, by: float, u: list[np.ndarray]) -> np.ndarray:
    """Normals moved by up to ``by`` along each axis."""
    n = n + by * (2 * np.stack(u, 1) - 1)
    n[:, 2] = np.maximum(n[:, 2], 1e-3)
    return n / np.sqrt((n * n).sum(1, keepdims=True))


def directions(side: int) -> list[list[tuple[int, int]]]:
    """The eight neighbourhoods as offsets: near, then far, of up, down, left and right."""
    out = []
    for ax, ay in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        fan = [(ax, ay)] + [(ax * (2 + i) + e * i * (ax == 0), ay * (2 + i) + e * i * (ay == 0)) for i in (0, 1) for e in (-1, 1)]
        out.append(fan)
        out.append([(3 * ax, 3 * ay), (4 * ax, 4 * ay)])
    return out


def begin(sc: Scene, seed: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes, costs and views of all pixels: random ones, or what a valid seed, moved or turned a little, gives where that is cheaper."""
    s, m = sc.s, len(sc.image)
    t, p = (w.ravel() for w in np.meshgrid(np.arange(m), np.arange(s.side**2), indexing="ij"))
    x, y = p % s.side, p // s.side
    u = lambda k: uniform(sc.number[t], p, 0, k)
    plane = through(x, y, s.least + u(0) * (s.most - s.least), random_normal(u(1), u(2)))
    cost, chosen = sc.supported(t, x, y, plane)
    if seed is not None:
        planes, costs, views = (v.reshape(len(t), *v.shape[2:]) for v in seed)
        d = planes[:, 0] * x + planes[:, 1] * y + planes[:, 2]
        valid = (d >= s.least) & (d <= s.most) & (costs < 1.0) & (views.sum(1) >= 3)
        n = normal_of(planes)
        moved = np.clip(d * (1 + (u(3) - 0.5) * 2 * SEED_JITTER), s.least, s.most)
        for tried in (planes, through(x, y, moved, n), through(x, y, d, turned(n, SEED_TURN, [u(4), u(5), u(6)]))):
            c, v = sc.supported(t, x, y, tried)
            better = valid & (c < cost)
            plane, cost, chosen = np.where(better[:, None], tried, plane), np.where(better, c, cost), np.where(better[:, None], v, chosen)
    shape = (m, s.side**2)
    return plane.reshape(*shape, 3), cost.reshape(shape), chosen.reshape(*shape, -1)


def _evidence(cost: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """What speaks against a plane: its cost, less what its views are worth."""
    return cost - VIEW_WORTH * chosen.sum(1)


def update(sc: Scene, plane, cost, chosen, others, step: int, seed=None):
    """The state after one step; ``others`` (tile, view, pixel, 3) are the neighbours' planes."""
    s, m = sc.s, len(sc.image)
    t, p = (w.ravel() for w in np.meshgrid(np.arange(m), np.arange(s.side**2), indexing="ij"))
    x, y = p % s.side, p // s.side
    turn = ((x + y) % 2 == step % 2) & sc.there[t].any(1)
    t, p, x, y = t[turn], p[turn], x[turn], y[turn]
    n, k = len(t), sc.view.shape[1]
    u = lambda j: uniform(sc.number[t], p, step + 1, j)
    # What the eight neighbourhoods propose, and what it costs in each view.
    proposed, flags, prices = [], [], []
    for number, offsets in enumerate(directions(s.side)):
        best, at = np.full(n, np.inf), np.zeros(n, int)
        for dx, dy in offsets:
            ok = (x + dx >= 0) & (x + dx < s.side) & (y + dy >= 0) & (y + dy < s.side)
            q = np.where(ok, (y + dy) * s.side + x + dx, 0)
            c = np.where(ok, cost[t, q], np.inf)
            at, best = np.where(c < best, q, at), np.minimum(best, c)
        flag, found = np.isfinite(best), plane[t, at]
        price = sc.costs(t, x, y, found, flag[:, None])
        if number % 2:  # where there is no far one, the near one stands for it
            found, price, flag = np.where(flag[:, None], found, proposed[-1]), np.where(flag[:, None], price, prices[-1]), flag | flags[-1]
        proposed.append(found)
        flags.append(flag)
        prices.append(price)
    # Views are drawn.
    prior = np.zeros((n, k))
    for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        ok = (x + dx >= 0) & (x + dx < s.side) & (y + dy >= 0) & (y + dy < s.side)
        q = np.where(ok, (y + dy) * s.side + x + dx, 0)
        prior += np.where(ok[:, None], np.where(chosen[t, q], PRIOR[1], PRIOR[0]), 0.0)
    limit = GOOD * np.exp(-((step // 2) ** 2) / GOOD_FALL)
    every, on = np.stack(prices), np.stack(flags)[:, :, None]
    good = (every < limit) & on
    number, bad = good.sum(0), ((every > BAD) & on).sum(0)
    mean = np.where(good, np.exp(-(every**2) / TEMPERATURE), 0.0).sum(0) / np.maximum(number, 1)
    share = np.where(bad >= 3, 0.0, np.where(number > 2, mean, np.exp(-(limit**2) / DOUBT))) * prior * sc.there[t]
    total = share.sum(1, keepdims=True)
    cdf = np.cumsum(share, 1) / np.where(total > 0, total, 1.0)
    weight = np.zeros((n, k))
    for draw in range(DRAWS):
        hit = (cdf > u(10 + draw)[:, None]) & (total > 0)
        first = hit.argmax(1)
        weight[np.arange(n), first] += hit.any(1)
    weight = np.where(weight.sum(1, keepdims=True) > 0, weight, sc.there[t].astype(float))

    def weighed(c: np.ndarray) -> np.ndarray:
        return (weight * c).sum(1) / weight.sum(1)

    drawn = weight > 0  # what the others cost has no weight
    best = plane[t, p]
    price = weighed(sc.costs(t, x, y, best, drawn))

    def take(tried: np.ndarray, c: np.ndarray, ok: np.ndarray | bool = True) -> None:
        nonlocal best, price
        better = ok & (c < price)
        best, price = np.where(better[:, None], tried, best), np.where(better, c, price)

    for tried, flag, c in zip(proposed, flags, prices, strict=True):
        take(tried, weighed(c), flag)
    for v in range(k):  # what the views hold at the place that the best plane maps to
        sx, sy = sc.shift[t, v, 0], sc.shift[t, v, 1]
        d = best[:, 0] * x + best[:, 1] * y + best[:, 2]
        qx, qy = np.floor(x + sx * d + 0.5), np.floor(y + sy * d + 0.5)
        ok = (weight[:, v] > 0) & (qx >= 0) & (qx < s.side) & (qy >= 0) & (qy < s.side)
        held = others[t, v, np.where(ok, qy * s.side + qx, 0).astype(int)]
        low = 1 - held[:, 0] * sx - held[:, 1] * sy  # d(p) = held(p + s d(p)), solved for d(p)
        ok &= np.isfinite(held).all(1) & (np.abs(low) > 1e-6)
        tried = np.where(ok[:, None], held / np.where(ok, low, 1.0)[:, None], best)
        take(tried, weighed(sc.costs(t, x, y, tried, drawn & ok[:, None])), ok)
    d, normal = best[:, 0] * x + best[:, 1] * y + best[:, 2], normal_of(best)
    span = s.most - s.least
    far = np.where(price < 0.1, d + 2 * (u(30) - 0.5), s.least + u(30) * span)
    tries = [
        through(x, y, s.least + u(31) * span, random_normal(u(32), u(33))), through(x, y, d, random_normal(u(34), u(35))), through(x, y, d, turned(normal, TURN, [u(36), u(37), u(38)])),
        through(x, y, far, normal), through(x, y, d * (1 + JITTER * (2 * u(39) - 1)), normal),
    ]
    for tried in tries:
        take(tried, weighed(sc.costs(t, x, y, tried, drawn)))
    if seed is not None:
        held, old, views = seed[0][t, p], seed[1][t, p], seed[2][t, p]
        d = held[:, 0] * x + held[:, 1] * y + held[:, 2]
        valid = (d >= s.least) & (d <= s.most) & (old < 1.0) & (views.sum(1) >= 3)
        back = valid & (_evidence(*sc.supported(t, x, y, held)) <= _evidence(*sc.supported(t, x, y, best)))
        best = np.where(back[:, None], held, best)
    plane, cost, chosen = plane.copy(), cost.copy(), chosen.copy()
    plane[t, p] = best
    cost[t, p], chosen[t, p] = sc.supported(t, x, y, best)
    return plane, cost, chosen


STATE = "plane array<double>, cost array<double>, chosen array<bigint>"
#: Tiles that are updated together.
TOGETHER = 64


def _listed(column: pa.Array, name: str | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a column of lists: the row and the place in its list of each element, and the elements (or a field of theirs)."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    values = column.flatten()
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), values if name is None else pc.struct_field(values, name)


def _numbers(column: pa.Array, width: int, missing: float) -> np.ndarray:
    """Rows of ``width`` numbers; null ones hold ``missing``."""
    out = np.full((len(column), width), missing, column.type.value_type.to_pandas_dtype())
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _scene(batch: pa.RecordBatch, s: Settings) -> Scene:
    m, n = batch.num_rows, s.side**2
    row, place, image = _listed(batch.column("views"), "image")
    k = max(1, int(place.max(initial=0)) + 1)
    if k > MOST_VIEWS:
        raise ValueError(f"a tile has {k} views; {MOST_VIEWS} fit into its state")
    at = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile_x", "tile_y")]
    sc = Scene(_numbers(batch.column("image"), n, 0.0).astype(float).reshape(m, s.side, s.side), np.zeros((m, k, 2)), np.zeros((m, k, s.side, s.side)), np.zeros((m, k), bool), at[1] * 1_000_003 + at[0], s)
    for c, name in enumerate(("sx", "sy")):
        sc.shift[row, place, c] = _listed(batch.column("views"), name)[2].to_numpy(zero_copy_only=False)
    sc.view[row, place] = _numbers(image, n, 0.0).reshape(-1, s.side, s.side)
    sc.there[row, place] = True
    return sc


def _unpacked(batch: pa.RecordBatch, k: int, s: Settings, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Planes, costs and views of rows; costs of 2 where a row has none."""
    if f"{prefix}plane" not in batch.schema.names:
        return None
    n = s.side**2
    plane, cost, bits = (_numbers(batch.column(prefix + c), w, missing) for c, w, missing in (("plane", 3 * n, 0.0), ("cost", n, WORST), ("chosen", n, 0)))
    return plane.reshape(-1, n, 3), cost, (bits[:, :, None] >> np.arange(k)) & 1 > 0


def _stepped(s: Settings, step: int | None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                sc = _scene(batch, s)
                k, n = sc.view.shape[1], s.side**2
                seed = _unpacked(batch, k, s, "seed_")
                if step is None:
                    plane, cost, chosen = begin(sc, seed)
                else:
                    others = np.full((batch.num_rows, k, n, 3), np.nan)
                    row, place, held = _listed(batch.column("planes"), "plane")
                    others[row, place] = _numbers(held, 3 * n, np.nan).reshape(-1, n, 3)
                    plane, cost, chosen = update(sc, *_unpacked(batch, k, s), others, step, seed)
                bits = (chosen.astype(np.int64) << np.arange(k)).sum(2)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.size // len(v)), pa.int32()), pa.array(v.ravel())) for v in (plane, cost, bits)]
                yield pa.RecordBatch.from_arrays([batch.column("tile_x").cast(pa.int64()), batch.column("tile_y").cast(pa.int64()), *lists], ["tile_x", "tile_y", "plane", "cost", "chosen"])

    return apply


def relax(pixel: DataFrame, edges: DataFrame, s: Settings = Settings(), rounds: int = 3, seed: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(tile, plane, cost, chosen) after ``rounds`` of both colours.

    A tile has ``MOST_VIEWS`` views at most, more raise an error; ``pixel`` must be dense.
    ``seed`` is such a state of the same size, from a coarser level.
    """
    images = tiles(pixel.select(*SITE, "v"), "v", side=s.side).select(*TILE, F.transform("px", lambda e: e["v"]).alias("image"))
    there = images.select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("image"))
    e = edges.select(*TILE, "ntile_x", "ntile_y", (F.col("ux") * F.col("baseline") / s.unit).alias("sx"), (F.col("uy") * F.col("baseline") / s.unit).alias("sy")).join(there, ["ntile_x", "ntile_y"])
    views = F.array_sort(F.collect_list(F.struct("ntile_y", "ntile_x", "sx", "sy", "image"))).alias("views")
    scenes = images.join(e.groupBy(*TILE).agg(views), TILE, "left")
    if seed is not None:
        scenes = scenes.join(seed.select(*TILE, *[F.col(c).alias(f"seed_{c}") for c in ("plane", "cost", "chosen")]), TILE, "left")
    # The work is in the tasks, not in the rows, so small tables are dealt to all of them too.
    n = int(pixel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scenes = written(scenes)
    schema = "tile_x bigint, tile_y bigint, " + STATE
    now = written(scenes.repartition(n, *TILE).mapInArrow(_stepped(s, None), schema))
    near = scenes.select(*TILE, F.explode("views").alias("v")).select(*TILE, "v.ntile_y", "v.ntile_x")
    for step in range(2 * rounds):
        held = now.select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), "plane")
        planes = near.join(held, ["ntile_x", "ntile_y"], "left").groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("ntile_y", "ntile_x", "plane"))).alias("planes"))
        now = written(scenes.join(now, TILE).join(planes, TILE, "left").repartition(n, *TILE).mapInArrow(_stepped(s, step), schema))
    return now


def prior_seed(planes: DataFrame, side: int = 8) -> DataFrame:
    """I05, second matching: (site, a, b, c) as a seed for ``relax``; pixels without a plane get one that never counts as valid."""
    cell = F.struct((F.col("y") * side + F.col("x")).cast("int").alias("i"), F.array("a", "b", "c").alias("plane"))
    g = planes.groupBy(*TILE).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))  # a tile's pixels
    every = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at("m", i))
    g = g.withColumn("p", every)
    none = F.array(*[F.lit(0.0)] * 3)
    return g.select(
        *TILE, F.flatten(F.transform("p", lambda p: F.coalesce(p, none))).alias("plane"), F.transform("p", lambda p: F.when(p.isNull(), F.lit(WORST)).otherwise(0.0)).alias("cost"), F.transform("p", lambda p: F.lit(7).cast("long")).alias("chosen")
    )


def upsampled(state: DataFrame, side: int) -> DataFrame:
    """A state of tiles of half the side, its planes carried to ``side``: a disparity doubles, each pixel serves a block of four."""
    x, y = F.col("i") % side, F.floor(F.col("i") / side)
    half = (F.floor(y / 2) * (side // 2) + F.floor(x / 2)).cast("int")
    p = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i")).withColumn("h", half)
    at = [F.get("plane", 3 * F.col("h") + k) for k in range(3)]
    cell = F.struct("i", F.array(at[0], at[1], 2 * at[2]).alias("plane"), F.get("cost", F.col("h")).alias("cost"), F.get("chosen", F.col("h")).alias("chosen"))
    g = p.groupBy(*TILE).agg(F.array_sort(F.collect_list(cell)).alias("p"))
    return g.select(*TILE, F.flatten(F.transform("p", lambda e: e["plane"])).alias("plane"), F.transform("p", lambda e: e["cost"]).alias("cost"), F.transform("p", lambda e: e["chosen"]).alias("chosen"))


def two_levels(pixel: DataFrame, edges: DataFrame, s: Settings = Settings(), rounds: tuple[int, int] = (3, 6)) -> DataFrame:  # noqa: B008
    """Relaxation of halved images from random planes, then of the images themselves with that as seed."""
    small = pixel.groupBy(*TILE, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.avg("v").alias("v"))
    coarse = Settings(s.side // 2, max(1, s.radius // 2), s.top, s.least / 2, s.most / 2, s.unit, s.near, s.alike)
    return relax(pixel, edges, s, rounds[1], upsampled(relax(small, edges, coarse, rounds[0]), s.side))


def sites(state: DataFrame, side: int) -> DataFrame:
    """(site, d, cost, views): the disparity of each pixel's plane at the pixel, its cost and its number of supporting views."""
    j = state.select(*TILE, "plane", F.posexplode(F.arrays_zip("cost", "chosen")).alias("i", "e"))
    x, y = F.col("i") % side, F.floor(F.col("i") / side)
    d = F.get("plane", 3 * F.col("i")) * x + F.get("plane", 3 * F.col("i") + 1) * y + F.get("plane", 3 * F.col("i") + 2)
    return j.select(*TILE, x.cast("long").alias("x"), y.cast("long").alias("y"), d.alias("d"), F.col("e.cost").alias("cost"), F.bit_count("e.chosen").cast("long").alias("views"))
