"""Lens, camera and plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(c: Column, eps: float = 1e-6) -> Column:
    """A denominator kept away from zero, with its sign."""
    return F.when(F.abs(c) >= eps, c).when(c < 0, F.lit(-eps)).otherwise(F.lit(eps))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """between two vectors; 0 where one is zero."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, n)))), F.lit(0.0))


def virtual_depth(disparity: Column, baseline: float, lens_gap: float | None = None) -> Column:
    """baseline / disparity, times gap / (gap + disparity) where the gap is given; null for none."""
    v = F.try_divide(F.lit(baseline), disparity)
    if lens_gap is not None:
        v = v * lens_gap / (lens_gap + disparity)
    return F.when(disparity > 0, v)


def virtual_point(x: Column, cx: Column, vd: Column) -> Column:
    """where the ray of a pixel meets its virtual depth, along one axis; ``x`` counts from the lens centre."""
    return cx + x * vd


def back_projection(vx: Column, cx: Column, vd: Column) -> Column:
    """the pixel of a virtual point under a lens."""
    return F.try_divide(vx - cx, vd)


def object_depth(vd: Column, focal: float, gap: float, distance: float) -> Column:
    """1 / (1 / f - 1 / (gap + vd * distance))."""
    return F.try_divide(F.lit(1.0), F.lit(1.0 / focal) - F.try_divide(F.lit(1.0), gap + vd * distance))


def metric_depth(vd: Column, c0: Column, c1: Column, c2: Column) -> Column:
    """(c1 v + c2) / (1 - c0 v); null where singular or negative."""
    low = 1 - c0 * vd
    d = F.try_divide(c1 * vd + c2, low)
    return F.when((F.abs(low) > 1e-9) & (d >= 0), d)


def image_distance(a: Column, focal: float) -> Column:
    """b of 1 / f = 1 / a + 1 / b."""
    return F.try_divide(F.lit(1.0), 1.0 / focal - F.try_divide(F.lit(1.0), a))


def project(p: list[Column], k: list[float], r: list[float], t: list[float]) -> tuple[Column, Column, Column]:
    """pixel and depth of a world point."""
    cam = [sum((p[j] * r[3 * i + j] for j in range(3)), F.lit(t[i])) for i in range(3)]
    u = F.try_divide(k[0] * cam[0] + k[2] * cam[2], cam[2])
    v = F.try_divide(k[4] * cam[1] + k[5] * cam[2], cam[2])
    return u, v, cam[2]


def unproject(u: Column, v: Column, depth: Column, k: list[float], r: list[float], t: list[float]) -> list[Column]:
    """world point of a pixel at a depth."""
    cam = [(u - k[2]) / k[0] * depth - t[0], (v - k[5]) / k[4] * depth - t[1], depth - t[2]]
    return [cam[0] * r[j] + cam[1] * r[3 + j] + cam[2] * r[6 + j] for j in range(3)]


def plane_at(nx: Column, ny: Column, nz: Column, d: Column, x: Column, y: Column, dx: Column, dy: Column) -> Column:
    """disparity at (x + dx, y + dy) of the plane through (x, y, d) with the given normal."""
    return d - (nx * dx + ny * dy) / safe(nz)


def geometric_map(cx: Column, cy: Column, ncx: Column, ncy: Column, x: Column, y: Column, d: Column, unit: float) -> dict[str, Column]:
    """where pixel (x, y) of a lens at (cx, cy) lies in the one at (ncx, ncy) for a disparity d, and what that implies.

    ``qx``, ``qy`` the place, ``d_real`` the root of the baseline's product with
    the way back (null where that is negative), ``baseline`` and the virtual depth
    ``vd`` = baseline / d_real.
    """
    bx, by = cx - ncx, cy - ncy
    baseline = F.hypot(bx, by)
    step = F.try_divide(d * (baseline / unit), baseline)
    qx, qy = x + bx * step, y + by * step
    product = bx * (x - qx) + by * (y - qy)
    d_real = F.when(product >= 0, F.sqrt(product))
    return {"qx": qx, "qy": qy, "d_real": d_real, "baseline": baseline, "vd": baseline / (d_real + 1e-7)}


def plane_through(p: list[list[Column]]) -> list[Column]:
    """unit normal and offset (a, b, c, d) with a x + b y + c z + d = 0 of three points, c not negative."""
    u, v = ([p[k][i] - p[0][i] for i in range(3)] for k in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    turn = F.when(n[2] < 0, -1.0).otherwise(1.0)
    n = [F.try_divide(c * turn, size) for c in n]
    return [*n, -(n[0] * p[0][0] + n[1] * p[0][1] + n[2] * p[0][2])]


def prior_weight(cost: Column, angle_term: Column, depth_term: Column) -> Column:
    """exp(-c^2 / 0.18) * (0.5 + exp(-angle) * exp(-depth))."""
    return F.exp(-cost * cost / 0.18) * (0.5 + F.exp(-angle_term) * F.exp(-depth_term))


def blur_sigma(radius: Column, scale: float = 0.5, most: float = 2.5) -> Column:
    """sigma of a blur radius, clamped."""
    return F.least(F.lit(most), F.greatest(F.lit(0.0), radius * scale))


def similar_depth(a: Column, b: Column, share: float = 0.01) -> Column:
    """|a - b| < share * a."""
    return F.abs(a - b) < share * a


def similar_normal(a: list[Column], b: list[Column], cosine: float = 0.996194698) -> Column:
    """the cosine of the angle between two normals is above that of five degrees."""
    dot, aa, bb = (sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0)) for p, q in ((a, b), (a, a), (b, b)))
    return F.try_divide(dot, F.sqrt(aa * bb)) > cosine


def triangle(p: list[list[Column]]) -> tuple[Column, Column]:
    """area of a triangle in space, and its quality, twice the area over the square of the longest edge."""
    u, v, w = ([p[i][k] - p[j][k] for k in range(3)] for i, j in ((1, 0), (2, 0), (1, 2)))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    longest = F.greatest(*[e[0] * e[0] + e[1] * e[1] + e[2] * e[2] for e in (u, v, w)])
    return area, F.coalesce(F.try_divide(2 * area, longest), F.lit(0.0))


def barycentric(px: Column, py: Column, t: list[tuple[Column, Column]]) -> list[Column]:
    """weights of a triangle's corners at a point; null for a flat triangle."""
    (ax, ay), (bx, by), (cx, cy) = t
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    w1 = F.try_divide((px - ax) * (cy - ay) - (cx - ax) * (py - ay), area)
    w2 = F.try_divide((bx - ax) * (py - ay) - (px - ax) * (by - ay), area)
    return [1 - w1 - w2, w1, w2]


def gray(r: Column, g: Column, b: Column) -> Column:
    """P11."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)


def crop_side(baseline: Column) -> Column:
    """P10: side of the square inside a circle of the baseline's diameter."""
    return F.floor(baseline * 0.707106781186).cast("long")


def clamp_cost(c: Column) -> Column:
    """P13."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), c))


# Linear RGB to XYZ, rows divided by the white point D65.
TO_XYZ = ((0.412453 / 0.950456, 0.357580 / 0.950456, 0.180423 / 0.950456), (0.212671, 0.715160, 0.072169), (0.019334 / 1.088754, 0.119193 / 1.088754, 0.950227 / 1.088754))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE L*a*b* of 8-bit sRGB, in the 8-bit scale: L times 255 / 100, a and b plus 128, rounded."""

    def linear(c: Column) -> Column:
        c = c / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (sum((c * w for c, w in zip(rgb, row, strict=True)), F.lit(0.0)) for row in TO_XYZ)

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return [F.floor(F.round(c, 6) + 0.5).cast("double") for c in (light * 255 / 100, 500 * (root(x) - root(y)) + 128, 200 * (root(y) - root(z)) + 128)]


def colour_distance(p: list[Column], q: list[Column]) -> Column:
    """Euclidean distance of two colours."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), F.lit(0.0)))
