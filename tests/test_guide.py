"""Whole-image operators against scalar code: colours, mirrored windows, distances, guided growth, spaced seeds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid.functions.scalar import lab
from plenogrid.operators import guide as G
from plenogrid.operators import mvs


def test_lab_of_known_colours(spark):
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20), (128, 128, 128): (137, 128, 128)}
    df = spark.createDataFrame(list(known), "r int, g int, b int")
    got = {(r["r"], r["g"], r["b"]): (r["l"], r["a"], r["bb"]) for r in df.select("*", *[c.alias(n) for c, n in zip(lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "bb"), strict=True)]).collect()}
    assert got == known


def image(spark, values, name="v"):
    return spark.createDataFrame([("f", x, y, float(values[y, x])) for y in range(values.shape[0]) for x in range(values.shape[1])], f"frame string, x long, y long, {name} double")


@pytest.mark.parametrize("shape", [(5, 7), (3, 3), (4, 2)])
def test_mirrored_windows(spark, shape):
    """Offsets up to the size of the image, a corner's mirror images included."""
    v = np.random.default_rng(1).integers(0, 99, shape).astype(float)
    places = [(dx, dy) for dy in (-1, 0, 1) for dx in range(-min(2, shape[1] - 1), min(2, shape[1] - 1) + 1)]
    w = list(range(1, len(places) + 1))
    got = G.filtered(G.sized(image(spark, v)), places, {"s": ("v", w), "n": ("v", [1.0] * len(places))}).collect()
    at = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    assert len(got) == v.size
    for r in got:
        seen = [v[at(r["y"] + dy, shape[0]), at(r["x"] + dx, shape[1])] for dx, dy in places]
        assert r["s"] == pytest.approx(sum(a * b for a, b in zip(seen, w, strict=True))) and r["n"] == pytest.approx(sum(seen))


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_distances(spark, share):
    v = (np.random.default_rng(3).random((23, 31)) < share).astype(float)
    y, x = np.nonzero(v)
    for r in G.distance(image(spark, v), F.col("v") > 0).collect():
        assert r["far"] == (pytest.approx(math.sqrt(min((y - r["y"]) ** 2 + (x - r["x"]) ** 2))) if len(x) else None)


def scalar_support(s, sx, sy, radius):
    """One seed, window by window, as described."""
    h, w = s["vd"].shape
    de = lambda a, b: float(np.sqrt(((s["lab"][a[1], a[0]] - s["lab"][b[1], b[0]]) ** 2).sum()))
    for r in range(1, radius + 1):
        box = [(x, y) for y in range(max(0, sy - r), min(h, sy + r + 1)) for x in range(max(0, sx - r), min(w, sx + r + 1))]
        valid = [p for p in box if not np.isnan(s["vd"][p[1], p[0]])]
        if len(valid) < 6:
            continue
        seed = (sx, sy)
        if seed not in valid:
            near = [(round((x - sx) ** 2 + (y - sy) ** 2 + 0.15 * de((sx, sy), (x, y)) ** 2, 9), y, x) for x, y in valid if (x - sx) ** 2 + (y - sy) ** 2 <= 9 and de((sx, sy), (x, y)) <= 18]
            if not near:
                continue
            seed = min(near)[:0:-1]
        ring = [s["vd"][y, x] for x, y in valid if abs(x - seed[0]) <= 1 and abs(y - seed[1]) <= 1]
        if len(ring) < 3:
            continue
        m = float(np.median(ring))
        band = max(0.02, 2.5 * max(float(np.median(np.abs(np.array(ring) - m))), 0.003))
        may = {p for p in valid if abs(s["vd"][p[1], p[0]] - m) <= band and de(seed, p) <= 21.6}
        if seed not in may:
            continue
        found, todo = {seed}, [seed]
        while todo:
            p = todo.pop()
            for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q in may and q not in found and abs(s["vd"][q[1], q[0]] - s["vd"][p[1], p[0]]) <= 1.6 * band:
                    edge = max(s["grad"][q[1], q[0]], s["grad"][p[1], p[0]]) > 45
                    if de(p, q) <= 16 and not (edge and de(p, q) > 11.2):
                        found.add(q)
                        todo.append(q)
        vd = [s["vd"][y, x] for x, y in found]
        if len(found) < 5 or math.hypot(np.mean([x for x, _ in found]) - sx, np.mean([y for _, y in found]) - sy) > 2 or np.quantile(vd, 0.9) - np.quantile(vd, 0.1) > 0.12:
            continue
        wide = {(x + i, y + j) for x, y in found for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))} & set(box)
        gt = [s["gt"][y, x] for x, y in wide if not np.isnan(s["gt"][y, x])]
        if not gt or (len(gt) >= 3 and np.quantile(gt, 0.9) - np.quantile(gt, 0.1) > 3000):
            continue
        return r, len(found), float(np.median(vd)), float(np.median(gt))
    return None


@pytest.mark.parametrize(("seed", "noise"), [(1, 0.004), (2, 0.02), (3, 0.08)])
def test_guided_support_against_scalar_code(spark, seed, noise):
    """Even and rough surfaces with many holes, seeds without a value, borders; supports of small and of wide windows."""
    r = np.random.default_rng(seed)
    h, w = 34, 41
    y, x = np.mgrid[:h, :w]
    s = {"vd": 4 + 0.01 * x + noise * r.standard_normal((h, w)) + 0.2 * ((x // 9 + y // 7) % 2), "gt": 20000 + 90.0 * x + 400 * r.standard_normal((h, w)), "grad": r.uniform(0, 60, (h, w))}
    s["vd"][r.random((h, w)) < 0.45] = np.nan
    s["gt"][r.random((h, w)) < 0.8] = np.nan
    s["lab"] = np.floor(np.stack([120 + 15 * ((x // 6) % 2) + 6 * r.standard_normal((h, w)), 128 + 2 * r.standard_normal((h, w)), 128 + 2 * r.standard_normal((h, w))], 2))
    value = lambda a: None if np.isnan(a) else float(a)
    rows = [("f", i, j, value(s["vd"][j, i]), value(s["gt"][j, i]), *map(float, s["lab"][j, i]), float(s["grad"][j, i])) for j in range(h) for i in range(w)]
    surface = spark.createDataFrame(rows, "frame string, x long, y long, vd double, gt double, l double, a double, b double, grad double")
    at = [(i, j) for i in range(0, w, 3) for j in range(0, h, 3)]
    got = {(q["x"], q["y"]): (q["radius"], q["n"], q["vd"], q["gt"]) for q in G.guided_support(spark.createDataFrame([("f", i, j) for i, j in at], "frame string, x long, y long"), surface).collect()}
    want = {p: v for p in at if (v := scalar_support(s, *p, G.RADIUS))}
    assert got.keys() == want.keys() and len(want) > 20
    for p, v in want.items():
        assert got[p] == pytest.approx(v), p
    assert max(v[0] for v in want.values()) >= 3


def test_guided_support_of_nothing(spark):
    kinds = "frame string, x long, y long, vd double, gt double, l double, a double, b double, grad double"
    seeds = spark.createDataFrame([("f", 0, 0)], "frame string, x long, y long")
    assert G.guided_support(seeds, spark.createDataFrame([], kinds)).count() == 0
    assert G.guided_support(seeds, spark.createDataFrame([("f", 0, 0, None, None, 1.0, 1.0, 1.0, 0.0)], kinds)).count() == 0


@pytest.mark.parametrize(("n", "per_bin"), [(3000, 24), (400, 3), (5, 24)])
def test_spaced_seeds_against_the_sequential_rule(spark, n, per_bin):
    r = random.Random(n)
    places = r.sample([(2 * i, 2 * j) for i in range(60) for j in range(45)], min(n, 2700))
    rows = [("f", x, y, 120, 90, r.choice([1.0, 2.0, 2.5, 3.0]) + r.random() / 9, round(r.random(), 2)) for x, y in places]
    got = [(q["bin"], q["place"], q["x"], q["y"]) for q in G.pair_seeds(spark.createDataFrame(rows, "frame string, x long, y long, w long, h long, vd double, score double"), per_bin=per_bin).collect()]
    lo, hi = min(q[5] for q in rows), max(q[5] for q in rows)
    taken, want = [], []
    for b in range(8):
        cells = {}
        for _, x, y, _, _, vd, score in rows:
            if min(7, math.floor((vd - lo) * 8 / (hi - lo))) == b:
                cells.setdefault(min(5, y // 15) * 6 + min(5, x // 20), []).append((score, y, x))
        picked, moved = 0, True
        while picked < per_bin and moved:
            moved = False
            for c in sorted(cells):
                free = [q for q in sorted(cells[c]) if all((q[2] - i) ** 2 + (q[1] - j) ** 2 >= 144 for i, j in taken)]
                if picked < per_bin and free:
                    picked, moved = picked + 1, True
                    taken.append((free[0][2], free[0][1]))
                    want.append((b, picked, free[0][2], free[0][1]))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_triangles_have_empty_circles_and_cover_the_hull(seed):
    r = np.random.default_rng(seed)
    n = [3, 5, 9, 20, 30, 12][seed]
    x, y = r.integers(0, 10_000, (2, n))
    t = mvs._triangles(x, y)
    for i, j, k in t:
        m = np.array([[x[j] - x[i], y[j] - y[i]], [x[k] - x[i], y[k] - y[i]]], float)
        centre = np.linalg.solve(m, (m**2).sum(1) / 2) + [x[i], y[i]]
        far = np.hypot(x - centre[0], y - centre[1])
        assert (far >= far[i] * (1 - 1e-9)).all()
    area = sum(abs((x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])) for i, j, k in t)
    hull = []
    for way in (1, -1):
        part = []
        for p in sorted(zip(x.tolist(), y.tolist(), strict=True))[::way]:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(p)
        hull += part[:-1]
    assert area == abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True)))


def test_priors_of_a_plane(spark):
    """All pixels inside the supports' hull get the plane itself; points on one circle or one line do no harm."""
    rows = [(0, 0, x, y, 1 + 0.25 * x - 0.125 * y, float((x % 3 != 0) + (y % 3 != 0)) / 4) for x in range(8) for y in range(8)] + [(1, 0, x, 0, 1.0, 0.0) for x in range(8)]
    got = mvs.delaunay_prior(spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, d double, cost double")).collect()
    assert {(r["x"], r["y"]) for r in got} == {(x, y) for x in range(7) for y in range(7)} and {r["tile_x"] for r in got} == {0}
    assert all(r["prior"] == pytest.approx(1 + 0.25 * r["x"] - 0.125 * r["y"]) and r["a"] == pytest.approx(0.25) for r in got)
