"""Cases worked out by hand, and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid.functions import keys, scalar
from plenogrid.operators import depthmodel, grid, mvs, neighbors, reproject, stats


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, v) for v in (1.0, 2.0, 3.0, 10.0)], "g int, v double")


def test_quantile_rules(four):
    got = {r: stats.quantile(four, ["g"], "v", 0.5, r).first()["q"] for r in stats.RULES}
    assert got == {"nearest": 3.0, "truncating": 2.0, "upper_median": 3.0}
    assert stats.interpolated(four, ["g"], "v", 0.5).first()["q500"] == 2.5


def test_exact_interval(four):
    r = stats.hdi_exact(four, ["g"], "v", 0.5).first()
    assert (r["hdi_lo"], r["hdi_hi"]) == (1.0, 2.0)


def test_mad_band_of_few_values_is_their_range(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(7)], "g int, v double")
    r = stats.mad_band(df, ["g"], "v").first()
    assert (r["lo"], r["hi"]) == (0.0, 6.0)


def test_statistics_ignore_what_is_no_number(spark):
    df = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, None), (0, float("inf")), (0, 3.0)], "g int, v double")
    r = stats.moments(df, ["g"], "v").first()
    assert (r["n"], r["mean"], r["n_nan"], r["n_inf"]) == (2, 2.0, 1, 1)
    assert stats.report(df.where("g = 9"), ["g"], "v").count() == 0


def test_all_equal_values(spark):
    df = spark.createDataFrame([(0, 5.0)] * 9, "g int, v double")
    r = stats.report(df, ["g"], "v").first()
    assert (r["q50"], r["hdi_lo"], r["hdi_hi"], r["bins"]) == (5.0, 5.0, 5.0, 1)


def test_keys(spark):
    one = spark.range(1)
    c = one.select(keys.child(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("c")).first()["c"]
    assert tuple(c) == (1, 3, 5)
    assert one.select(keys.bits(F.lit(13), 4).alias("b")).first()["b"] == [0, 2, 3]


def test_behaviour_model(spark):
    d = spark.range(1).select(scalar.metric_depth(F.lit(4.0), F.lit(0.05), F.lit(1500.0), F.lit(2000.0)).alias("d")).first()["d"]
    assert d == pytest.approx(10000)
    assert spark.range(1).select(scalar.metric_depth(F.lit(20.0), F.lit(0.05), F.lit(1.0), F.lit(1.0)).alias("d")).first()["d"] is None


def test_spike(spark):
    rows = [(0, 0, x, y, 5.0 if (x, y) == (1, 1) else 1.0) for x in range(3) for y in range(3)]
    df = spark.createDataFrame(rows, "tile_x bigint, tile_y bigint, x bigint, y bigint, d double")
    assert [(r["x"], r["y"]) for r in grid.spikes(df).where("spike = 1").collect()] == [(1, 1)]


def test_cycle_error_of_a_constant_plane_is_zero(spark):
    rows = [(t, 0, x, y, 1.5) for t in (0, 1) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "tile_x bigint, tile_y bigint, x bigint, y bigint, d double")
    e = spark.createDataFrame([(0, 0, 1, 0, 12.0, -1.0, 0.0)], "tile_x bigint, tile_y bigint, ntile_x bigint, ntile_y bigint, baseline double, ux double, uy double")
    r = reproject.cycle_errors(df, e, 12.0)
    assert r.count() == 6 * 8 and r.agg(F.max("error")).first()[0] == pytest.approx(0)


def test_model_is_recovered(spark):
    rows = [(0, 3.9 + k * 0.01, (1500 * (3.9 + k * 0.01) + 2000) / (1 - 0.05 * (3.9 + k * 0.01))) for k in range(120)]
    f = depthmodel.fit(spark.createDataFrame(rows, "g int, vd double, gt double"), ["g"]).first()
    assert f["c0"] == pytest.approx(0.05, abs=1e-6) and f["c1"] == pytest.approx(1500, abs=0.1) and f["c2"] == pytest.approx(2000, abs=1)


def test_segments_cut_at_size_and_span(spark):
    rows = [(3.9 + 0.05 * k / 16, 1.0) for k in range(20)]
    s = depthmodel.segments(spark.createDataFrame(rows, "vd double, gt double")).orderBy("seg_id").collect()
    assert [r["n"] for r in s] == [20]  # a cut before the 17th value leaves 4, which join the segment before
    more = rows + [(4.0 + 0.001 * k, 1.0) for k in range(20)]
    s = depthmodel.segments(spark.createDataFrame(more, "vd double, gt double")).orderBy("seg_id").collect()
    assert s[0]["n"] == 16 and sum(r["n"] for r in s) == 40


def test_empty_grid(spark):
    df = spark.createDataFrame([], "tile_x bigint, tile_y bigint, x bigint, y bigint, d double, cost double")
    e = spark.createDataFrame([], "tile_x bigint, tile_y bigint, ntile_x bigint, ntile_y bigint, baseline double, ux double, uy double")
    assert reproject.filter_reasons(df, e, 12.0).count() == 0
    assert neighbors.rings(e, 2).count() == 0


def test_region_growing_fills_the_region(spark):
    """A path of 34 steps through a tile, its walls far off in disparity."""
    path = [(x, y) for y in range(0, 8, 2) for x in (range(8) if y % 4 == 0 else range(7, -1, -1))]
    path += [(7, 1), (0, 3), (7, 5)]
    rows = [(0, 0, x, y, 1.0 if (x, y) in path else 5.0) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, d double")
    got = {(r["x"], r["y"]): r["step"] for r in mvs.grown(df, df.where("x = 0 and y = 0")).collect()}
    assert set(got) == set(path) and max(got.values()) == len(path) - 1
    assert mvs.grown(df, df.where("x = 0 and y = 0"), rounds=4).count() == 5


def test_edge_repair_goes_from_pixel_to_pixel(spark):
    """A row of five bad pixels, three of which only repaired neighbours reach; one unlike any other stays."""
    rows = [(0, 0, x, 0, 100.0 if x < 7 else 0.0, 2.0 if x == 0 else None) for x in range(8)]
    df = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, v double, d double")
    got = {r["x"]: (r["d"], r["round"]) for r in mvs.edges_repaired(df, df.where("x > 0"), radius=2).collect()}
    assert got == {1: (2.0, 1), 2: (2.0, 1), 3: (2.0, 2), 4: (2.0, 2), 5: (2.0, 3), 6: (2.0, 3)}


def test_spaced_samples(spark):
    rows = [("a", float(x), 0.0, x) for x in range(10)] + [("b", 0.0, 0.0, 1), ("b", 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c int")
    got = sorted((r["g"], r["place"], r["x"]) for r in mvs.spaced(df, ["g"], ["c", "y", "x"], 3, 4.0).collect())
    assert got == [("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, 8.0), ("b", 1, 1.0)]


def test_quantiles_of_a_heavy_tail(spark):
    """Nearly all values in one equal-width cell, against numpy; then one value, then none."""
    values = [1 + k / 1000 for k in range(3000)] + [1e9, 1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "g string, v double")
    got = {r["g"]: r for r in stats.interpolated(df, ["g"], "v", 0.1, 0.5, 0.999).collect()}
    for p, name in ((0.1, "q100"), (0.5, "q500"), (0.999, "q999")):
        assert abs(got["a"][name] - np.quantile(values, p)) < 1e-9 and got["b"][name] == 5.0
    cells = stats.ranked(df.where("g = 'a'"), ["g"], "v").agg({"i": "max"}).first()[0]
    assert cells == len(values) - 1
    band = {r["g"]: r for r in stats.mad_band(df, ["g"], "v").collect()}
    median = np.median(values)
    assert abs(band["a"]["mad"] - np.median(np.abs(np.array(values) - median))) < 1e-9
    assert stats.interpolated(df.where("false"), ["g"], "v", 0.5).count() == 0 and stats.hdi_exact(df.where("false"), ["g"], "v", 0.5).count() == 0


def test_holes_are_filled_to_the_end(spark):
    """A single valid pixel in a corner of a tile: fourteen rounds, more than eight."""
    rows = [(0, 0, x, y, 1.5 if x == y == 0 else None) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "tile_x long, tile_y long, x long, y long, d double")
    assert grid.fill_holes(df).where("d = 1.5").count() >= 0.98 * 64
    assert grid.fill_holes(df.where("x > 0")).where("d is not null").count() == 0


def test_fixed_positions_of_corners_edges_and_inner_lenses(spark):
    """A grid of 7 x 5: what each kind of place asks for, nearest first; a lens that was left out is no neighbour."""
    lens = spark.createDataFrame([(x, y, 12.0 * x + 6 * (y % 2), 10.4 * y) for x in range(7) for y in range(5)], "tile_x long, tile_y long, cx double, cy double")
    got = {}
    for r in sorted(neighbors.fixed_positions(lens, lens.where("not (tile_x = 3 and tile_y = 1)"), 7, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["tile_x"], r["tile_y"]), []).append((r["ntile_x"] - r["tile_x"], r["ntile_y"] - r["tile_y"]))
    assert len(got) == 35
    assert sorted(got[0, 0]) == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 2)]
    assert sorted(got[6, 0]) == [(-1, 0), (-1, 1), (0, 1)] and sorted(got[5, 0]) == [(-1, 0), (-1, 1), (0, 1), (1, 0), (1, 1)]
    assert sorted(got[0, 4]) == [(0, -2), (0, -1), (1, -1), (1, 0), (2, -2), (2, 0)]
    assert sorted(got[6, 4]) == [(-2, -1), (-2, 0), (-1, -1), (-1, 0), (0, -2), (0, -1)]
    assert sorted(got[0, 2]) == [(0, -1), (0, 1), (1, -1), (1, 0), (1, 1), (2, 0)] and sorted(got[6, 2]) == [(-2, -1), (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1)]
    assert len(got[2, 3]) == 12 and len(got[3, 2]) == 11 and (0, -1) not in got[3, 2]
    assert all(len(got[x, 4]) == 6 for x in range(7))
    assert set(got[2, 3][:2]) == {(1, 0), (-1, 0)}
