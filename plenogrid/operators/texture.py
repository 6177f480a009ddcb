"""Texture measures that need a whole tile at once, as numbers or as maps, and clustering of blur values.

Tiles have a fixed number of pixels, so a grouped function sees a small bounded
array; groups are spread over the tasks by tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TILE
from ..steps import written
from .guide import Area, in_blocks, sized, step
from .reproject import tiles
from .stats import between_places, ranked

SIDE = 8


def _per_tile(df: DataFrame, measures, names: Sequence[str], value: str = "v") -> DataFrame:
    """One row per tile with the measures of its image, computed on batches of whole tiles."""

    def apply(batches):
        for batch in batches:
            v = batch.column("img").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIDE, SIDE)
            yield pa.RecordBatch.from_arrays([batch.column("tile_x"), batch.column("tile_y"), *(pa.array(np.asarray(c, np.float64)) for c in measures(v))], ["tile_x", "tile_y", *names])

    img = tiles(df, value).select(*TILE, F.transform("px", lambda p: p[value]).alias("img")).where(F.size("img") == SIDE * SIDE)
    return img.mapInArrow(apply, "tile_x long, tile_y long, " + ", ".join(f"{n} double" for n in names))


def _per_pixel(df: DataFrame, measure, name: str, side: int = SIDE, value: str = "v", together: int = 64) -> DataFrame:
    """(site, name): a map of each tile's image of ``side`` x ``side`` pixels, computed for some tiles at a time."""

    def apply(batches):
        y, x = (w.ravel() for w in np.mgrid[:side, :side])
        for batch in batches:
            for k in range(0, batch.num_rows, together):
                piece = batch.slice(k, together)
                v = piece.column("img").flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
                tile = [np.repeat(piece.column(c).to_numpy(), side * side) for c in ("tile_x", "tile_y")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, tile), pa.array(np.tile(x, len(v))), pa.array(np.tile(y, len(v))), pa.array(np.asarray(measure(v), np.float64).ravel())], ["tile_x", "tile_y", "x", "y", name])

    img = tiles(df, value, side=side).select(*TILE, F.transform("px", lambda p: p[value]).alias("img")).where(F.size("img") == side * side)
    return img.mapInArrow(apply, f"tile_x long, tile_y long, x long, y long, {name} double")


def _sobel(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along x and y over the last two axes; what lies outside is reflected about the border pixel."""
    p = np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1), (1, 1)], mode="reflect")
    down, right = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :], p[..., :, :-2] + 2 * p[..., :, 1:-1] + p[..., :, 2:]
    return down[..., 2:] - down[..., :-2], right[..., 2:, :] - right[..., :-2, :]


def sobel_windows(df: DataFrame, window: int = 15, side: int = SIDE) -> DataFrame:
    """Mean of |gx| + |gy| over the window about each pixel; the image is mirrored at its border, each window for itself again."""
    r = window // 2

    def measure(v):
        padded = np.pad(v, ((0, 0), (r, r), (r, r)), mode="symmetric")
        gx, gy = _sobel(np.lib.stride_tricks.sliding_window_view(padded, (window, window), axis=(1, 2)))
        return (np.abs(gx) + np.abs(gy)).mean(axis=(3, 4))

    return _per_pixel(df, measure, "richness", side, together=16)


def gabor_windows(df: DataFrame, size: int = 21, sigma: float = 5.0, theta: float = 45.0, wavelength: float = 10.0, phase: float = 90.0, side: int = SIDE) -> DataFrame:
    """Response of each pixel to one Gabor kernel.

    Kernel places run from -1 to 1 without the last row and column, sigma is in
    shares of the size, angles are in degrees; what lies outside is reflected
    about the border pixel.
    """
    r, t = (size - 1) // 2, np.deg2rad(theta)
    y, x = np.mgrid[-r : r + 1, -r : r + 1] / r
    u, w = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
    kernel = np.exp(-0.5 * (u * u + w * w) / (sigma / size) ** 2) * np.cos(2 * np.pi * u / wavelength + np.deg2rad(phase))
    kernel[-1, :] = kernel[:, -1] = 0.0

    def measure(v):
        padded = np.pad(v, ((0, 0), (r, r), (r, r)), mode="reflect")
        return np.einsum("nijab,ab->nij", np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(1, 2)), kernel)

    return _per_pixel(df, measure, "response", side)


def circular_codes(df: DataFrame, radius: int = 2, points: int = 16, side: int = SIDE) -> DataFrame:
    """The sum of 2^n over the points of a circle that are brighter than its centre, scaled to 255; pixels whose circle is cut keep their value.

    Of the four pixels about a point the two mixed ones have each other's weight,
    as the method defines it.
    """

    def measure(v):
        out, inner = v.copy(), slice(radius, side - radius - 1)
        c = v[:, inner, inner]
        code = np.zeros_like(c)
        for n in range(points):
            dx, dy = radius * np.cos(2 * np.pi * n / points), -radius * np.sin(2 * np.pi * n / points)
            dx, dy = (round(d) if abs(d - round(d)) < 1e-9 else d for d in (dx, dy))
            x1, y1, x2, y2 = (int(f(d)) for f, d in ((np.floor, dx), (np.floor, dy), (np.ceil, dx), (np.ceil, dy)))
            tx, ty = dx - x1, dy - y1

            def at(a, b):
                return v[:, radius + b : side - radius - 1 + b, radius + a : side - radius - 1 + a]

            around = at(x1, y1) * (1 - tx) * (1 - ty) + at(x1, y2) * tx * (1 - ty) + at(x2, y1) * (1 - tx) * ty + at(x2, y2) * tx * ty
            code += (around > c + 1e-9) * 2.0**n
        out[:, inner, inner] = code / (2.0**points - 1) * 255
        return out

    return _per_pixel(df, measure, "code", side)


def high_frequency(df: DataFrame, radius: float = 2.0) -> DataFrame:
    """Share of the spectrum's energy further than ``radius`` from its centre; the mean is left out."""

    def measures(v):
        p = np.abs(np.fft.fftshift(np.fft.fft2(v - v.mean(axis=(1, 2), keepdims=True)), axes=(1, 2))) ** 2
        k = np.arange(SIDE) - SIDE // 2
        far = np.hypot(k[:, None], k[None, :]) > radius
        total = p.sum(axis=(1, 2))
        return [np.divide(p[:, far].sum(axis=1), total, out=np.zeros(len(v)), where=total > 0)]

    return _per_tile(df, measures, ["high_frequency"])


def gabor(df: DataFrame, size: int = 7, sigma: float = 2.0, wavelength: float = 4.0, angles: int = 4) -> DataFrame:
    """Mean absolute response to real Gabor kernels, the largest over the angles."""

    def measures(v):
        r = size // 2
        y, x = np.mgrid[-r : r + 1, -r : r + 1]
        padded = np.pad(v, ((0, 0), (r, r), (r, r)), mode="reflect")
        view = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(1, 2))
        best = np.zeros(len(v))
        for k in range(angles):
            t = np.pi * k / angles
            u = x * np.cos(t) + y * np.sin(t)
            kernel = np.exp(-(x * x + y * y) / (2 * sigma * sigma)) * np.cos(2 * np.pi * u / wavelength)
            kernel -= kernel.mean()
            best = np.maximum(best, np.abs(np.einsum("nijab,ab->nij", view, kernel)).mean(axis=(1, 2)))
        return [best]

    return _per_tile(df, measures, ["gabor"])


def binary_patterns(df: DataFrame, radius: float = 2.0, points: int = 16) -> DataFrame:
    """Mean of the uniform-pattern code, the number of brighter points on a circle, sampled bilinearly, where its signs change at most twice; points + 1 elsewhere."""

    def measures(v):
        r = int(np.ceil(radius))
        c = v[:, r:-r, r:-r]
        h, w = c.shape[1:]
        bits = []
        for k in range(points):
            dy, dx = radius * np.sin(2 * np.pi * k / points), radius * np.cos(2 * np.pi * k / points)
            y0, x0 = int(np.floor(dy + 1e-9)), int(np.floor(dx + 1e-9))
            fy, fx = dy - y0, dx - x0

            def at(a, b):
                return v[:, r + y0 + a : r + y0 + a + h, r + x0 + b : r + x0 + b + w]  # noqa: B023

            s = 0.0
            for a, wy in ((0, 1 - fy), (1, fy)):
                for b, wx in ((0, 1 - fx), (1, fx)):
                    if wy * wx > 1e-9:
                        s = s + wy * wx * at(a, b)
            bits.append(s >= c - 1e-9)
        bits = np.stack(bits)
        changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
        code = np.where(changes <= 2, bits.sum(axis=0), points + 1)
        return [code.mean(axis=(1, 2))]

    return _per_tile(df, measures, ["pattern"])


def _gradients(v):
    gy, gx = np.gradient(v, axis=(1, 2))
    return np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi)


def orientation_entropy(df: DataFrame, bins: int = 9) -> DataFrame:
    """W12 within a tile: entropy of the gradient directions, weighted by magnitude."""

    def measures(v):
        m, a = _gradients(v)
        k = np.minimum(bins - 1, (a / np.pi * bins).astype(int))
        h = np.stack([(m * (k == b)).sum(axis=(1, 2)) for b in range(bins)], 1)
        p = np.divide(h, h.sum(1, keepdims=True), out=np.zeros_like(h), where=h.sum(1, keepdims=True) > 0)
        return [-(p * np.log(np.where(p > 0, p, 1))).sum(1)]

    return _per_tile(df, measures, ["entropy"])


# Fixed values of the windowed direction histograms: cells of 4 pixels, blocks of 4 x 4 cells, windows of 5 x 5 blocks, a step of a cell.
CELL, BLOCK, BLOCKS, DIRECTIONS = 4, 4, 5, 6
CLIP, SOFT, RENORM, NOTHING = 0.2, 0.1, 1e-3, 1e-6


def direction_windows(image: DataFrame) -> DataFrame:
    """(frame, x, y, entropy, richness) of the 32 x 32 windows of whole images, every 4 pixels; richness is the entropy stretched to 0 .. 255 within a frame.

    ``image`` is (frame, x, y, v), tiles side by side, so windows reach over their
    borders.  A pixel's magnitude is shared by the two directions next to its own;
    cells, blocks and windows are sums of sums: a block's histogram is scaled, cut at
    ``CLIP`` and scaled again, its entropy is that of its numbers, and a window adds
    the entropies of its blocks, each of which is computed once for all windows.
    The image is taken in the blocks of ``guide``, with the pixels that the windows
    which begin in one reach to.
    """
    around, reach = (1, 1), CELL * (BLOCK + BLOCKS - 2)
    after = (reach + 1, reach + 1)

    def measured(rows: pa.Table) -> pa.Table:
        steps = ([(1, 0), (-1, 0), (0, 1), (0, -1)], {"gx": ("v", [1, -1, 0, 0]), "gy": ("v", [0, 0, 1, -1])}, dict)
        area = Area.of(rows, ["v"], around, after).passed(steps, around, around)
        gx, gy, n = area.values["gx"], area.values["gy"], area.there.shape[0] // CELL
        at = np.mod(np.arctan2(gy, gx), np.pi) / np.pi * DIRECTIONS - 0.5
        m, first = np.sqrt(gx * gx + gy * gy), np.floor(at).astype(int)
        place = np.arange(n * CELL) // CELL
        cell = (place[:, None] * n + place) * DIRECTIONS
        votes = ((first, m * (1 - at + first)), (first + 1, m * (at - first)))
        h = sum(np.bincount((cell + k % DIRECTIONS).ravel(), v.ravel(), n * n * DIRECTIONS) for k, v in votes).reshape(n, n, DIRECTIONS)
        full = area.there.reshape(n, CELL, n, CELL).all((1, 3))

        def squares(a: np.ndarray, side: int) -> np.ndarray:
            return np.lib.stride_tricks.sliding_window_view(a, (side, side), (0, 1))

        v = squares(h, BLOCK).reshape(n - BLOCK + 1, n - BLOCK + 1, -1)
        v = np.minimum(v / (np.sqrt((v * v).sum(2, keepdims=True)) + BLOCK * BLOCK * DIRECTIONS * SOFT), CLIP)
        v = v / (np.sqrt((v * v).sum(2, keepdims=True)) + RENORM)
        e = np.where(v > NOTHING, -v * np.log(np.maximum(v, NOTHING)), 0.0).sum(2)
        wy, wx = np.nonzero(squares(squares(full, BLOCK).all((2, 3)), BLOCKS).all((2, 3)))
        entropy = squares(e, BLOCKS).sum((2, 3))[wy, wx]
        frame = rows.column("frame").take(pa.array(np.zeros(len(wx), np.int64)))
        return pa.Table.from_arrays([frame, pa.array(area.x0 + CELL * wx), pa.array(area.y0 + CELL * wy), pa.array(entropy)], ["frame", "x", "y", "entropy"])

    t = sized(image.select("frame", "x", "y", "v"))
    kind = image.schema["frame"].dataType.simpleString()
    w = step(in_blocks(t, ["v"], around, after, measured, f"frame {kind}, x long, y long, entropy double"))  # the ends are taken from it too
    ends = w.groupBy("frame").agg(F.min("entropy").alias("lo"), F.max("entropy").alias("hi"))
    stretched = F.coalesce(F.try_divide((F.col("entropy") - F.col("lo")) * 255, F.col("hi") - F.col("lo")), F.lit(0.0))
    return w.join(F.broadcast(ends), "frame").select("frame", "x", "y", "entropy", stretched.alias("richness"))


def tamura(df: DataFrame, bins: int = 16) -> DataFrame:
    """Contrast std / kurtosis^(1/4), and the variance of the direction histogram's shares."""

    def measures(v):
        d = v - v.mean(axis=(1, 2), keepdims=True)
        m2, m4 = (d**2).mean(axis=(1, 2)), (d**4).mean(axis=(1, 2))
        contrast = np.divide(m2, np.sqrt(np.sqrt(m4)), out=np.zeros(len(v)), where=m4 > 0)
        m, a = _gradients(v)
        k = np.minimum(bins - 1, (a / np.pi * bins).astype(int))
        h = np.stack([((k == b) & (m > 0)).sum(axis=(1, 2)) for b in range(bins)], 1)
        p = h / np.maximum(1, h.sum(1, keepdims=True))
        return [contrast, p.var(axis=1)]

    return _per_tile(df, measures, ["contrast", "direction_variance"])


def blur_levels(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """One-dimensional k-means of normalised values, started at evenly spaced quantiles.

    Lloyd steps are aggregations of k sums; only k centres come to the driver.
    """
    c = F.col(column)
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.withColumn("level", F.lit(None).cast("int"))
    t = written(df.withColumn("__n", (c - lo) / ((hi - lo) or 1.0)))  # every step reads it
    marks = {f"m{i}": (i + 0.5) / k for i in range(k)}
    first = between_places(ranked(t, [], "__n"), [], marks).first()  # one row
    centres = sorted({first[m] for m in marks})

    def nearest(cs):
        return F.array_position(F.array(*[F.abs(F.col("__n") - x) for x in cs]), F.array_min(F.array(*[F.abs(F.col("__n") - x) for x in cs]))).cast("int") - 1

    while True:  # the sum of squares falls with every step, so it settles
        got = {r["i"]: r["m"] for r in t.groupBy(nearest(centres).alias("i")).agg(F.avg("__n").alias("m")).collect()}  # k rows
        new = [got.get(i, x) for i, x in enumerate(centres)]
        if max(abs(a - b) for a, b in zip(new, centres, strict=True)) < 1e-9:
            break
        centres = new
    return t.withColumn("level", nearest(centres)).drop("__n")
