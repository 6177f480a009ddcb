"""Relaxation of planes: against scalar code, and on scenes whose disparities are known."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid.operators import matching as P

S = P.Settings(side=8, radius=2, least=0.3, most=2.5)


def scene(seed=1, m=2, k=3):
    r = np.random.default_rng(seed)
    there = np.ones((m, k), bool)
    there[-1, -1] = False
    return P.Scene(r.integers(0, 256, (m, 8, 8)).astype(float), r.uniform(-1, 1, (m, k, 2)), r.integers(0, 256, (m, k, 8, 8)).astype(float), there, np.arange(m) + 77, S)


def scalar_cost(sc, t, x, y, plane, k):
    d = lambda u, v: plane[0] * u + plane[1] * v + plane[2]
    sx, sy = sc.shift[t, k]
    qx, qy = x + sx * d(x, y), y + sy * d(x, y)
    if not sc.there[t, k] or not (0 <= qx < 8 and 0 <= qy < 8):
        return 2.0
    rows = []
    for j in range(-2, 3):
        for i in range(-2, 3):
            u, v = x + i, y + j
            if not (0 <= u < 8 and 0 <= v < 8):
                continue
            qx, qy = u + sx * d(u, v), v + sy * d(u, v)
            if not (0 <= qx < 8 and 0 <= qy < 8):
                continue
            w = math.exp(-math.hypot(i, j) / (2 * S.near**2) - abs(sc.image[t, v, u] - sc.image[t, y, x]) / (2 * S.alike**2))
            qx, qy = min(qx, 7), min(qy, 7)
            x0, y0 = int(qx), int(qy)
            x1, y1, ax, ay = min(x0 + 1, 7), min(y0 + 1, 7), qx - x0, qy - y0
            g = sc.view[t, k]
            rows.append((w, sc.image[t, v, u], (1 - ax) * (1 - ay) * g[y0, x0] + ax * (1 - ay) * g[y0, x1] + (1 - ax) * ay * g[y1, x0] + ax * ay * g[y1, x1]))
    total = sum(w for w, _, _ in rows)
    if total <= 1e-6:
        return 2.0
    mean = lambda f: sum(w * f(a, b) for w, a, b in rows) / total
    ma, mb = mean(lambda a, b: a), mean(lambda a, b: b)
    va, vb, cov = mean(lambda a, b: a * a) - ma * ma, mean(lambda a, b: b * b) - mb * mb, mean(lambda a, b: a * b) - ma * mb
    return 2.0 if va < 1e-5 or vb < 1e-5 else min(2.0, max(0.0, 1 - cov / math.sqrt(va * vb)))


def scalar_support(sc, t, x, y, plane):
    c = [scalar_cost(sc, t, x, y, plane, k) for k in range(sc.view.shape[1])]
    good = sorted(v for v in c if v < 2)[: S.top]
    return (sum(good) / len(good), [v <= good[-1] for v in c]) if good else (2.0, [False] * len(c))


def test_costs_against_scalar_code():
    sc, r = scene(), random.Random(3)
    n = 200
    t, x, y = (np.array([r.randrange(top) for _ in range(n)]) for top in (2, 8, 8))
    plane = np.array([[r.uniform(-0.3, 0.3), r.uniform(-0.3, 0.3), r.uniform(-1, 3)] for _ in range(n)])
    got, (mean, chosen) = sc.costs(t, x, y, plane), sc.supported(t, x, y, plane)
    for i in range(n):
        assert np.allclose(got[i], [scalar_cost(sc, t[i], x[i], y[i], plane[i], k) for k in range(3)], atol=1e-9)
        want = scalar_support(sc, t[i], x[i], y[i], plane[i])
        assert mean[i] == pytest.approx(want[0]) and chosen[i].tolist() == want[1]


def test_a_step_against_scalar_code():
    """Neighbourhoods, priors, draws, proposals and refinement of one step, pixel by pixel."""
    sc = scene(5)
    plane, cost, chosen = P.begin(sc, None)
    others = np.random.default_rng(9).uniform(-0.2, 0.2, (2, 3, 64, 3)) + np.array([0, 0, 1.0])
    step = 2
    new = P.update(sc, plane, cost, chosen, others, step)
    for t in range(2):
        for p in range(64):
            x, y = p % 8, p // 8
            if (x + y) % 2 != step % 2:
                assert (new[0][t, p] == plane[t, p]).all() and new[1][t, p] == cost[t, p]
                continue
            u = lambda j: float(P.uniform(sc.number[t : t + 1], np.array([p]), step + 1, j)[0])  # noqa: B023, E731
            price = lambda w: [scalar_cost(sc, t, x, y, w, k) for k in range(3)]  # noqa: B023, E731
            inside = lambda a, b: 0 <= a < 8 and 0 <= b < 8
            proposed = []
            for ax, ay in ((0, -1), (0, 1), (-1, 0), (1, 0)):
                fan = [(ax, ay)]
                for i in (0, 1):
                    fan += [(ax * (2 + i) - (i if ax == 0 else 0), ay * (2 + i) - (i if ay == 0 else 0)), (ax * (2 + i) + (i if ax == 0 else 0), ay * (2 + i) + (i if ay == 0 else 0))]
                near = [(y + b) * 8 + x + a for a, b in fan if inside(x + a, y + b)]
                far = [(y + b * ay) * 8 + x + b * ax for b in (3, 4) if inside(x + b * ax, y + b * ay)]
                at = min(near, key=lambda q: cost[t, q]) if near else None  # noqa: B023
                proposed += [at, min(far, key=lambda q: cost[t, q]) if far else at]  # noqa: B023
            prices = [price(plane[t, q]) for q in proposed if q is not None]
            prior = [sum(0.9 if chosen[t, (y + b) * 8 + x + a, k] else 0.1 for a, b in ((0, -1), (0, 1), (-1, 0), (1, 0)) if inside(x + a, y + b)) for k in range(3)]
            limit = 0.8 * math.exp(-1 / 90)
            share = []
            for k in range(3):
                good, bad = [c[k] for c in prices if c[k] < limit], sum(c[k] > 1.2 for c in prices)
                value = 0.0 if bad >= 3 else sum(math.exp(-c * c / 0.18) for c in good) / len(good) if len(good) > 2 else math.exp(-limit * limit / 0.32)
                share.append(value * prior[k] * sc.there[t, k])
            weight = [0.0] * 3
            for draw in range(15):
                so_far = 0.0
                for k in range(3):
                    so_far += share[k] / sum(share) if sum(share) else 0.0
                    if so_far > u(10 + draw):
                        weight[k] += 1
                        break
            weight = weight if sum(weight) else [float(v) for v in sc.there[t]]
            worth = lambda w: sum(a * b for a, b in zip(weight, price(w), strict=True)) / sum(weight)  # noqa: B023, E731
            best, least = plane[t, p], worth(plane[t, p])
            for q in proposed:
                if q is not None and worth(plane[t, q]) < least:
                    best, least = plane[t, q], worth(plane[t, q])
            for k in range(3):
                sx, sy = sc.shift[t, k]
                d = best[0] * x + best[1] * y + best[2]
                qx, qy = math.floor(x + sx * d + 0.5), math.floor(y + sy * d + 0.5)
                if weight[k] and inside(qx, qy):
                    held = others[t, k, qy * 8 + qx]
                    tried = held / (1 - held[0] * sx - held[1] * sy)
                    if worth(tried) < least:
                        best, least = tried, worth(tried)
            d = best[0] * x + best[1] * y + best[2]
            normal = np.array([-best[0], -best[1], 1]) / math.sqrt(best[0] ** 2 + best[1] ** 2 + 1)

            def plane_of(d, n):
                a, b = -n[0] / n[2], -n[1] / n[2]
                return np.array([a, b, d - a * x - b * y])  # noqa: B023

            def random_normal(a, b):
                r = 0.99 * math.sqrt(a)
                return [r * math.cos(2 * math.pi * b), r * math.sin(2 * math.pi * b), math.sqrt(1 - r * r)]

            moved = normal + 0.02 * math.pi * (2 * np.array([u(36), u(37), u(38)]) - 1)
            far = d + 2 * (u(30) - 0.5) if least < 0.1 else 0.3 + u(30) * 2.2
            for tried in (plane_of(0.3 + u(31) * 2.2, random_normal(u(32), u(33))), plane_of(d, random_normal(u(34), u(35))), plane_of(d, moved), plane_of(far, normal), plane_of(d * (1 + 0.02 * (2 * u(39) - 1)), normal)):
                if worth(tried) < least:
                    best, least = tried, worth(tried)
            assert np.allclose(new[0][t, p], best, atol=1e-7)
            assert new[1][t, p] == pytest.approx(scalar_support(sc, t, x, y, best)[0], abs=1e-7)


def relief(side, truth):
    """Tiles of one smooth texture, seen with the disparity ``truth``: the neighbour along ux, uy shows it shifted against the map."""
    rows, step = [], {}
    texture = lambda a, b: 128 + 60 * math.sin(0.9 * a + 0.4 * b) + 50 * math.cos(0.7 * b - 0.5 * a + 1) + 15 * math.sin(2.1 * a) * math.cos(1.9 * b)
    keys = [(a, b) for a in range(3) for b in range(3)]
    for a, b in keys:
        for x in range(side):
            for y in range(side):
                rows.append((a, b, x, y, texture(x - truth * a, y - truth * b)))
        for c, e in keys:
            if (a, b) != (c, e) and abs(a - c) <= 1 and abs(b - e) <= 1:
                size = math.hypot(c - a, e - b)
                step[a, b, c, e] = ((c - a) / size, (e - b) / size, 12.0 * size)
    return rows, [(*k, *v) for k, v in step.items()]


@pytest.mark.parametrize("side", [8, 14])
def test_a_known_disparity_is_found(spark, side):
    """Two levels on tiles of two sizes: most pixels find the true shift."""
    truth = 1.3
    rows, edges = relief(side, truth)
    pixel = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, v double")
    e = spark.createDataFrame(edges, "tile_x long, tile_y long, ntile_x long, ntile_y long, ux double, uy double, baseline double")
    s = P.Settings(side=side, radius=2, least=0.3, most=2.5)
    state = P.two_levels(pixel, e, s, rounds=(2, 3))
    got = P.sites(state, side).where("tile_x = 1 and tile_y = 1").toPandas()
    assert len(got) == side * side and (got.views >= 1).mean() > 0.9
    assert ((got.d - truth).abs() < 0.15).mean() > 0.7 and got.cost.median() < 0.05
    again = P.sites(P.two_levels(pixel, e, s, rounds=(2, 3)), side).where("tile_x = 1 and tile_y = 1").toPandas()
    key = ["tile_x", "tile_y", "x", "y"]
    assert np.array_equal(got.sort_values(key).d.to_numpy(), again.sort_values(key).d.to_numpy())  # a step that runs again gives the same


def test_costs_fall_from_round_to_round(spark):
    rows, edges = relief(8, 1.3)
    pixel = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, v double")
    e = spark.createDataFrame(edges, "tile_x long, tile_y long, ntile_x long, ntile_y long, ux double, uy double, baseline double")
    mean = [P.sites(P.relax(pixel, e, S, rounds=k), 8).agg(F.avg("cost")).first()[0] for k in (0, 1, 3)]
    assert mean[0] > mean[1] > mean[2]


def test_empty_and_lonely_tiles(spark):
    pixel = spark.createDataFrame([(0, 0, x, y, 10.0 * x) for x in range(8) for y in range(8)], "tile_x long, tile_y long, x long, y long, v double")
    e = spark.createDataFrame([], "tile_x long, tile_y long, ntile_x long, ntile_y long, ux double, uy double, baseline double")
    got = P.sites(P.relax(pixel, e, S, rounds=1), 8).collect()
    assert len(got) == 64 and all(r["cost"] == 2.0 and r["views"] == 0 for r in got)
    assert P.relax(pixel.where("false"), e, S, rounds=1).count() == 0


def spokes(n):
    """One tile with n neighbours that show the same texture, shifted along as many directions."""
    texture = lambda a, b: 128 + 60 * math.sin(0.9 * a + 0.4 * b) + 50 * math.cos(0.7 * b - 0.5 * a + 1)
    pixel, edges = [(0, 0, x, y, texture(x, y)) for x in range(8) for y in range(8)], []
    for k in range(1, n + 1):
        ux, uy = math.cos(k), math.sin(k)
        pixel += [(k, 0, x, y, texture(x - ux, y - uy)) for x in range(8) for y in range(8)]
        edges.append((0, 0, k, 0, ux, uy, 12.0))
    return pixel, edges


def test_all_of_many_views_count(spark):
    """Forty views all support; more than fit raise an error instead of being left out."""
    frames = lambda n: [spark.createDataFrame(r, c) for r, c in zip(spokes(n), ("tile_x long, tile_y long, x long, y long, v double", "tile_x long, tile_y long, ntile_x long, ntile_y long, ux double, uy double, baseline double"), strict=True)]
    s = P.Settings(side=8, radius=2, top=40, least=0.9, most=1.1)
    got = P.sites(P.relax(*frames(40), s, rounds=1), 8).where("tile_x = 0 and x between 3 and 4 and y between 3 and 4").collect()
    assert [r["views"] for r in got] == [40] * 4 and all(r["cost"] < 0.2 for r in got)
    with pytest.raises(Exception, match="64 views"):
        P.relax(*frames(64), s, rounds=0).count()


def test_a_seed_returns_by_cost_and_views():
    """A seed comes back where it is cheaper, and where it is about as cheap with as many views; not where it is invalid or clearly dearer."""
    sc = scene(11)
    plane, cost, chosen = P.begin(sc, None)
    others = np.full((2, 3, 64, 3), np.nan)
    alone = P.update(sc, plane, cost, chosen, others, 0)
    t, p = (w.ravel() for w in np.meshgrid(np.arange(2), np.arange(64), indexing="ij"))
    turn = (p % 8 + p // 8) % 2 == 0
    seeds = alone[0] + np.random.default_rng(3).normal(0, 0.02, (2, 64, 3))
    many = np.ones((2, 64, 3), bool)
    with_seed = P.update(sc, plane, cost, chosen, others, 0, (seeds, np.full((2, 64), 0.5), many))
    d = seeds[t, p, 0] * (p % 8) + seeds[t, p, 1] * (p // 8) + seeds[t, p, 2]
    worth = lambda w: (lambda c, v: c - P.VIEW_WORTH * v.sum(1))(*sc.supported(t, p % 8, p // 8, w[t, p]))
    back = turn & (d >= S.least) & (d <= S.most) & (worth(seeds) <= worth(alone[0]))
    assert 0 < back.sum() < turn.sum()
    assert (with_seed[0][t, p] == np.where(back[:, None], seeds[t, p], alone[0][t, p])).all()
    for old, views in ((1.0, many), (0.5, ~many)):  # seeds that never fitted, or without views
        assert (P.update(sc, plane, cost, chosen, others, 0, (seeds, np.full((2, 64), old), views))[0] == alone[0]).all()


def test_priors_seed_the_second_matching(spark):
    """Planes of known pixels: begun from them most pixels are right at once; begun from random planes few are."""
    rows, edges = relief(8, 1.3)
    pixel = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, v double")
    e = spark.createDataFrame(edges, "tile_x long, tile_y long, ntile_x long, ntile_y long, ux double, uy double, baseline double")
    planes = pixel.where("x > 0").select("tile_x", "tile_y", "x", "y", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.3).alias("c"))
    right = lambda s: P.sites(s, 8).where("tile_x = 1 and tile_y = 1 and x between 2 and 5 and y between 2 and 5").agg(F.count_if(F.abs(F.col("d") - 1.3) < 0.05)).first()[0]
    assert right(P.relax(pixel, e, S, rounds=0, seed=P.prior_seed(planes))) >= 14 > 6 > right(P.relax(pixel, e, S, rounds=0))


def test_only_patches_that_count_are_compared(monkeypatch):
    """A step compared every plane in every view, also where the pixel leaves the view's tile or the view was not drawn."""
    sc, pairs = scene(4, 5), []
    compare = P.Scene._correlated
    monkeypatch.setattr(P.Scene, "_correlated", lambda self, t, p, v, plane: pairs.append(len(t)) or compare(self, t, p, v, plane))
    state = P.begin(sc, None)
    assert pairs
    pairs.clear()
    P.update(sc, *state, np.repeat(state[0][:, None], sc.view.shape[1], 1), 0)
    updated = 4 * 64 // 2
    assert max(pairs) <= P.PAIRS
    assert sum(pairs) < 0.8 * updated * sc.view.shape[1] * (8 + 1 + sc.view.shape[1] + 5 + 1)
