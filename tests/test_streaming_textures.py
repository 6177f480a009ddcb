import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid import fixtures
from plenogrid.operators import fusion, grid, texture
from plenogrid.streaming import frames


def test_frames_stream(spark, sf, tmp_path):
    p = fixtures.pixel(spark, sf)
    for k in (0, 1):
        p.where(F.col("tile_x") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = frames.run(spark, str(tmp_path / "in"), p.schema.simpleString()[7:-1].replace(":", " "), grid.smd2, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.exceptAll(grid.smd2(p)).count() == 0 and got.count() == p.count()


def images(spark, sf):
    rows = fixtures.pixel(spark, sf).where("tile_y < 2").collect()
    out = {}
    for r in rows:
        out.setdefault((r["tile_x"], r["tile_y"]), np.zeros((8, 8)))[r["y"], r["x"]] = r["v"]
    return out


def test_high_frequency(spark, sf):
    got = {(r["tile_x"], r["tile_y"]): r["high_frequency"] for r in texture.high_frequency(fixtures.pixel(spark, sf)).where("tile_y < 2").collect()}
    for k, v in images(spark, sf).items():
        p = np.abs(np.fft.fft2(v - v.mean())) ** 2
        f = np.minimum(np.arange(8), 8 - np.arange(8))
        assert abs(p[np.hypot(f[:, None], f[None, :]) > 2].sum() / p.sum() - got[k]) < 1e-9


def mirrored(i, n, twice):
    """Index of a place outside 0..n-1: mirrored about the border, which counts ``twice`` or once."""
    while not 0 <= i < n:
        i = (-1 - i if i < 0 else 2 * n - 1 - i) if twice else (-i if i < 0 else 2 * n - 2 - i)
    return i


def test_window_measures_against_loops(spark, sf):
    """Two tiles, pixel by pixel."""
    v = images(spark, sf)
    keys = sorted(v)[:2]
    df = fixtures.pixel(spark, sf).where("tile_y = 0 and tile_x < 2")
    maps = {}
    for f, name in ((texture.sobel_windows, "richness"), (texture.gabor_windows, "response"), (texture.circular_codes, "code")):
        maps[name] = {(r["tile_x"], r["tile_y"], r["x"], r["y"]): r[name] for r in f(df).collect()}
        assert len(maps[name]) == 128
    for key in [k for k in keys if k[1] == 0]:
        image = v[key]
        for x in range(8):
            for y in range(8):
                patch = np.array([[image[mirrored(y + b, 8, True), mirrored(x + a, 8, True)] for a in range(-7, 8)] for b in range(-7, 8)])
                total = 0.0
                for b in range(15):
                    for a in range(15):
                        q = lambda i, j: patch[mirrored(b + j, 15, False), mirrored(a + i, 15, False)]  # noqa: B023, E731
                        total += abs(sum(w * (q(1, j) - q(-1, j)) for j, w in ((-1, 1), (0, 2), (1, 1)))) + abs(sum(w * (q(i, 1) - q(i, -1)) for i, w in ((-1, 1), (0, 2), (1, 1))))
                assert abs(maps["richness"][(*key, x, y)] - total / 225) < 1e-9
                response = 0.0
                for b in range(-10, 10):
                    for a in range(-10, 10):
                        u, w = (a + b) / 10 * np.sqrt(0.5), (b - a) / 10 * np.sqrt(0.5)
                        response += image[mirrored(y + b, 8, False), mirrored(x + a, 8, False)] * np.exp(-0.5 * (u * u + w * w) / (5 / 21) ** 2) * np.cos(2 * np.pi * u / 10 + np.pi / 2)
                assert abs(maps["response"][(*key, x, y)] - response) < 1e-6
                code = image[y, x]
                if 2 <= x < 5 and 2 <= y < 5:
                    code = 0.0
                    for n in range(16):
                        px, py = round(x + 2 * np.cos(np.pi * n / 8), 9), round(y - 2 * np.sin(np.pi * n / 8), 9)
                        x1, y1, x2, y2 = int(np.floor(px)), int(np.floor(py)), int(np.ceil(px)), int(np.ceil(py))
                        tx, ty = px - x1, py - y1
                        s = image[y1, x1] * (1 - tx) * (1 - ty) + image[y2, x1] * tx * (1 - ty) + image[y1, x2] * (1 - tx) * ty + image[y2, x2] * tx * ty
                        code += 2.0**n * (s > image[y, x] + 1e-6)
                    code *= 255 / 65535
                assert abs(maps["code"][(*key, x, y)] - code) < 1e-6


def test_tile_measures_against_loops(spark, sf):
    """Contrast, direction histogram, orientation entropy, pattern and Gabor energy of a tile, from their definitions."""
    df = fixtures.pixel(spark, sf).where("tile_y = 0 and tile_x < 3")
    got = {}
    for f in (texture.tamura, texture.orientation_entropy, texture.binary_patterns, texture.gabor):
        for r in f(df).collect():
            got.setdefault((r["tile_x"], r["tile_y"]), {}).update(r.asDict())
    for key, row in got.items():
        v = images(spark, sf)[key]
        m2, m4 = ((v - v.mean()) ** 2).mean(), ((v - v.mean()) ** 4).mean()
        assert abs(row["contrast"] - m2 / m4**0.25) < 1e-9
        counts, weights = np.zeros(16), np.zeros(9)
        for y in range(8):
            for x in range(8):
                gx = v[y, min(x + 1, 7)] - v[y, max(x - 1, 0)]
                gy = v[min(y + 1, 7), x] - v[max(y - 1, 0), x]
                gx, gy = gx / (2 if 0 < x < 7 else 1), gy / (2 if 0 < y < 7 else 1)
                turn = np.arctan2(gy, gx) % np.pi / np.pi
                counts[min(15, int(turn * 16))] += np.hypot(gx, gy) > 0
                weights[min(8, int(turn * 9))] += np.hypot(gx, gy)
        share = weights[weights > 0] / weights.sum()
        assert abs(row["direction_variance"] - (counts / counts.sum()).var()) < 1e-9 and abs(row["entropy"] + (share * np.log(share)).sum()) < 1e-9
        codes = []
        for y in range(2, 6):
            for x in range(2, 6):
                bits = []
                for n in range(16):
                    px, py = round(x + 2 * np.cos(np.pi * n / 8), 9), round(y + 2 * np.sin(np.pi * n / 8), 9)
                    x0, y0 = int(np.floor(px)), int(np.floor(py))
                    fx, fy = px - x0, py - y0
                    s = sum(wy * wx * v[y0 + b, x0 + a] for b, wy in ((0, 1 - fy), (1, fy)) for a, wx in ((0, 1 - fx), (1, fx)) if wy * wx > 1e-9)
                    bits.append(s >= v[y, x] - 1e-6)
                codes.append(sum(bits) if sum(bits[i] != bits[i - 1] for i in range(16)) <= 2 else 17)
        assert abs(row["pattern"] - np.mean(codes)) < 1e-9
        energy = []
        for k in range(4):
            kernel = np.array([[np.exp(-(a * a + b * b) / 8) * np.cos(2 * np.pi * (a * np.cos(np.pi * k / 4) + b * np.sin(np.pi * k / 4)) / 4) for a in range(-3, 4)] for b in range(-3, 4)])
            kernel -= kernel.mean()
            energy.append(np.mean([abs(sum(kernel[b + 3, a + 3] * v[mirrored(y + b, 8, False), mirrored(x + a, 8, False)] for a in range(-3, 4) for b in range(-3, 4))) for x in range(8) for y in range(8)]))
        assert abs(row["gabor"] - max(energy)) < 1e-9


def test_measures_of_flat_tiles_are_defined(spark):
    flat = spark.createDataFrame([(0, 0, x, y, 7.0) for x in range(8) for y in range(8)], "tile_x long, tile_y long, x long, y long, v double")
    for f in (texture.high_frequency, texture.gabor, texture.binary_patterns, texture.orientation_entropy, texture.tamura):
        assert all(np.isfinite(list(f(flat).first())[2:]))
    assert texture.gabor(flat.where("false")).count() == 0


def test_blur_levels(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0.1, 0.2, 5, 5.1, 10, 10.1)], "b double")
    got = {r["b"]: r["level"] for r in texture.blur_levels(df, "b", k=3).collect()}
    assert len({got[v] for v in (0.0, 0.1, 0.2)}) == 1 and got[5.0] == got[5.1] != got[10.0] == got[10.1]


def test_relaxation_keeps_sites_and_costs_nothing_more(spark, sf):
    """Each phase keeps the own disparity among its proposals, so a site's own cost never rises within the phase."""
    d, p = fixtures.disparity(spark, sf), fixtures.pixel(spark, sf)
    out = fusion.relaxed(d.where("tile_y < 3"), fixtures.edges(spark, sf), p, fixtures.BASELINE, rounds=1)
    assert out.count() == d.where("tile_y < 3 and d > 0").count() and out.where("d is null").count() == 0


def test_two_levels_fill_the_holes(spark, sf):
    d = fixtures.disparity(spark, sf).where("tile_y < 2")
    out = fusion.two_levels(d, fixtures.edges(spark, sf), fixtures.pixel(spark, sf), fixtures.BASELINE)
    assert out.where("d is null").count() == 0 and d.where("d > 0").count() < out.count() <= d.count()


def test_direction_windows_against_loops(spark):
    """Windows over tile borders, those that begin every four pixels and lie inside the image."""
    v = np.random.default_rng(8).integers(0, 256, (37, 46)).astype(float)
    image = spark.createDataFrame([("f", x, y, float(v[y, x])) for y in range(37) for x in range(46)], "frame string, x long, y long, v double")
    got = {(r["x"], r["y"]): (r["entropy"], r["richness"]) for r in texture.direction_windows(image).collect()}
    p = np.pad(v, 1, mode="reflect")
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    m, a = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi) / np.pi * 6 - 0.5
    want = {}
    for wy in range(0, 37 - 31, 4):
        for wx in range(0, 46 - 31, 4):
            total = 0.0
            for by in range(wy, wy + 17, 4):
                for bx in range(wx, wx + 17, 4):
                    h = np.zeros((4, 4, 6))
                    for y in range(16):
                        for x in range(16):
                            t = a[by + y, bx + x]
                            low = math.floor(t)
                            h[y // 4, x // 4, low % 6] += m[by + y, bx + x] * (1 - t + low)
                            h[y // 4, x // 4, (low + 1) % 6] += m[by + y, bx + x] * (t - low)
                    h = np.minimum(h / (np.sqrt((h**2).sum()) + 9.6), 0.2)
                    h /= np.sqrt((h**2).sum()) + 1e-3
                    h = h[h > 1e-6]
                    total -= (h * np.log(h)).sum()
            want[wx, wy] = total
    lo, hi = min(want.values()), max(want.values())
    assert got.keys() == want.keys() and len(want) == 8
    for k, e in want.items():
        assert got[k] == pytest.approx((e, (e - lo) * 255 / (hi - lo)))
