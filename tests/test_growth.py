"""What the plans and the results must keep on larger and less regular tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenogrid import plans, steps
from plenogrid.operators import guide as G
from plenogrid.operators import mvs, stats


@pytest.mark.parametrize("name", ["gradient_buckets", "edge_proxies"])
def test_pixels_are_not_broadcast(spark, sf, name):
    """Spark takes an exploded table for small, whatever the arrays hold; the driver would gather all pixels."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and re.search(r"[ \[]s?x#", x)]


def test_relaxation_joins_tiles_not_pixels(spark, sf, monkeypatch):
    """All pixels of a tile share its views; joined with them pixel by pixel, every pixel would carry a copy of them to the next shuffle."""
    seen = []

    def noted(df, write=steps.written):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df)

    monkeypatch.setattr(steps, "written", noted)
    out = plans.QUERIES["relaxation"](spark, sf)
    assert seen and out.count() > 0
    assert not [x for p in seen for x in p.split("\n") if "Join" in x and re.search(r"[ \[]s?x#", x)]


def test_windows_and_distances_of_a_frame_that_lacks_pixels(spark):
    """A last row of tiles that is not full: places without a pixel count nothing and are no sites, and the columns above them count for distances."""
    r = np.random.default_rng(5)
    v, there = r.integers(0, 99, (11, 9)).astype(float), np.ones((11, 9), bool)
    there[8:, 4:] = False
    at = [(x, y) for y in range(11) for x in range(9) if there[y, x]]
    df = spark.createDataFrame([("f", x, y, float(v[y, x])) for x, y in at], "frame string, x long, y long, v double")
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i

    def pass_of(a, steps):
        out = np.zeros_like(a)
        for x, y in at:
            seen = [(mirror(x + i, 9), mirror(y + j, 11), k) for i, j, k in steps]
            out[y, x] = sum(k * a[q, p] for p, q, k in seen if there[q, p])
        return out

    taps = G.blur_taps(2, 1.0)
    want = pass_of(pass_of(v, [(d - 2, 0, k) for d, k in enumerate(taps)]), [(0, d - 2, k) for d, k in enumerate(taps)])
    got = {(q["x"], q["y"]): q["v"] for q in G.smoothed(df, "v").collect()}
    assert got == {(x, y): np.floor(round(want[y, x], 6) + 0.5) for x, y in at}
    members = [(7, 7), (0, 0)]
    far = {(q["x"], q["y"]): q["far"] for q in G.distance(df, ((F.col("x") == 7) & (F.col("y") == 7)) | ((F.col("x") == 0) & (F.col("y") == 0))).collect()}
    assert far == {(x, y): pytest.approx(min(np.hypot(x - a, y - b) for a, b in members)) for x, y in at}


def test_distances_in_long_columns(spark):
    """A window that begins anew at each row takes the square of a column's length."""
    plan = G.distance(spark.range(4).selectExpr("'f' AS frame", "id AS x", "id AS y"), F.col("x") == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan


@pytest.mark.parametrize(("name", "column"), [("histogram", "bins"), ("histogram_mode", "bins"), ("hdi_filtered", "hdi_lo"), ("statistics_library", "median"), ("kde", "h")])
def test_rows_of_groups_are_written_before_values_meet_them(spark, sf, monkeypatch, name, column):
    """Inside a larger plan Spark doesn't know a row a group for small: it sorts a group in one task, or gathers all values on the driver."""
    seen = []

    def noted(df, write=steps.written):
        seen.append(df.columns)
        return write(df)

    monkeypatch.setattr(stats, "written", noted)
    plans.QUERIES[name](spark, sf)
    assert [c for c in seen if column in c and len({"v", "copies"} & {*c}) == 0]


def _plan(spark, sf, name):
    return plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_outliers_shuffle_tiles(spark, sf):
    """Each pixel was sent to the 25 sites that see it, twice."""
    plan = _plan(spark, sf, "local_outliers")
    assert not re.search(r"explode\(\[\[-2,-2\]", plan) and "MapInArrow" in plan


def test_regions_grow_without_a_job_a_step(spark, sf, monkeypatch):
    """Each of up to 63 steps was written and counted, and every task of each reported to the driver."""
    monkeypatch.setattr(mvs, "written", lambda df: pytest.fail("a step was written"))
    assert plans.QUERIES["region_growing"](spark, sf).count() > 0


def test_residuals_are_looked_up_within_pairs_of_tiles(spark, sf):
    """A row a pixel and view was joined with the moments here and there."""
    plan = _plan(spark, sf, "photo_residual")
    assert not [x for x in plan.split("\n") if "Join" in x and "ntile_x" in x and re.search(r"[ (]t?x#", x)]


@pytest.mark.parametrize("name", ["patch_ncc", "ncc_top"])
def test_matches_carry_no_tiles_through_a_shuffle(spark, sf, name):
    """Each match was joined with the arrays of both its tiles and shuffled with the first."""
    lines = _plan(spark, sf, name).split("\n")
    work = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    below = [x for x in lines[work + 1 :] if "Project" in x and "vs#" in x]
    assert below and not [x for x in below if re.search(r"[ \[]px#\d+L?,", x) and "collect_list" not in x and "transform" not in x]


def _written_plans(spark, sf, name, monkeypatch):
    """Plans of the steps of pixels that a query writes, and its own."""
    seen = []

    def noted(df, write=steps.written):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(G, "written", noted)
    last = _plan(spark, sf, name)
    return [*seen, last]


def test_supports_meet_pixels_in_blocks(spark, sf, monkeypatch):
    """Pixels were joined with their own levels, colours and gradients, and each window was a list of records of them."""
    plans_of = _written_plans(spark, sf, "guided_support", monkeypatch)
    assert len(plans_of) > 1
    for plan in plans_of:
        assert "collect_list" not in plan and not [x for x in plan.split("\n") if "Join" in x and re.search(r"[ (]x#", x)]


def test_direction_windows_are_summed_in_blocks(spark, sf, monkeypatch):
    """Each cell went with its numbers to the 16 blocks that hold it, and each block to 25 windows."""
    plans_of = _written_plans(spark, sf, "direction_windows", monkeypatch)
    assert len(plans_of) > 1 and not [p for p in plans_of if "collect_list" in p or "explode(transform" in p]


def test_a_report_reads_its_table_twice(spark, sf, monkeypatch):
    """The distinct values were counted three times and each held against the marks of a sketch."""
    seen = []

    def noted(df, write=steps.written):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(stats, "written", noted)
    seen.append(_plan(spark, sf, "distribution_report"))
    assert not [p for p in seen if "lambda" in p or "percentile_approx" in p]
    assert len([x for p in seen for x in p.split("\n") if "Relation [" in x and "l_extendedprice" in x]) == 2


@pytest.mark.parametrize("kind", ["string", "double", "struct<a:int,b:string>"])
def test_places_of_groups_that_span_parts(spark, kind):
    """Keys of several types, with numbers that are none, groups in several parts and several batches."""
    r = np.random.default_rng(11)
    key = {"string": lambda k: f"g{k}", "double": lambda k: float("nan") if k == 1 else float(k), "struct<a:int,b:string>": lambda k: (k // 2, f"b{k % 2}")}[kind]
    rows = [(int(k), float(v)) for k, v in zip(r.choice(4, 4000, p=[0.9, 0.05, 0.04, 0.01]), r.integers(0, 3000, 4000), strict=True)]
    df = spark.createDataFrame([(key(k), v, k) for k, v in rows], f"g {kind}, v double, k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = stats.ranked(df, ["g"], "v").join(df.select("g", "k").distinct(), "g").select("k", "v", "copies", "i", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for k in range(4):
        own = sorted(v for q, v in rows if q == k)
        want |= {(k, v, own.count(v), own.index(v), len(own)) for v in own}
    assert {tuple(q) for q in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["pair_candidates", "pair_seeds"])
def test_candidates_meet_pixels_in_blocks(spark, sf, monkeypatch, name):
    """Pixels were joined with themselves seven times, and 25 copies of each were put together in patches."""
    plans_of = _written_plans(spark, sf, name, monkeypatch)
    assert len(plans_of) > 1
    for plan in plans_of:
        assert not [x for x in plan.split("\n") if "Join" in x and re.search(r"[ (]x#", x)] and "collect_list(vd" not in plan


def test_distances_make_no_records_of_rows(spark):
    """A row of the image was a list of records, and a worker held those of up to 10,000 rows as dictionaries."""
    df = spark.range(4).selectExpr("'f' AS frame", "id AS x", "id AS y")
    plan = G.distance(df, F.col("x") == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"collect_list\((named_)?struct\(x,", plan) and "MapInArrow" not in plan


@pytest.mark.parametrize("share", [0.002, 0.1])
def test_distances_over_bands_that_lie_apart(spark, share):
    """Two sets at once, one of them empty in one frame; rows far apart, columns that lack pixels, and sites alone are returned with what is kept."""
    r = np.random.default_rng(8)
    rows = [(f, x, y, int(r.integers(9))) for f, n in (("a", 11), ("b", 40)) for x in range(n) for y in (*range(3, 3 + 3 * G.LINES), 10**6, 10**6 + 1) if r.random() < 0.6]
    first, second = ({q[:3] for q in rows if r.random() < share and q[0] in frames} for frames in ("ab", "b"))
    df = spark.createDataFrame([(*q, q[:3] in first, q[:3] in second) for q in rows], "frame string, x long, y long, k int, p boolean, q boolean")
    got = {tuple(q)[:3]: tuple(q)[3:] for q in G.distances(G.sized(df), {"p": F.col("p"), "q": F.col("q")}, ["k"], F.col("k") < 4).collect()}
    near = lambda own, of: min((float(np.hypot(own[1] - x, own[2] - y)) for f, x, y in of if f == own[0]), default=None)
    want = {q[:3]: (q[3], near(q, first), near(q, second)) for q in rows if q[3] < 4}
    assert got.keys() == want.keys() and {q[0] for q in want} == {"a", "b"}
    assert all(got[q][0] == v[0] and got[q][1:] == (pytest.approx(v[1]), v[2] if v[2] is None else pytest.approx(v[2])) for q, v in want.items())


def test_seeds_are_picked_bin_by_bin(spark, sf, monkeypatch):
    """A frame's pool was one table in a task, and its candidates were found anew for the ends of the bins."""
    last = _written_plans(spark, sf, "pair_seeds", monkeypatch)[-1]
    assert "FlatMap" not in last and last.count("MapInArrow") == 1


def test_seeds_of_frames_that_share_a_task(spark):
    """Frames one after the other and bins over several batches, against each frame alone in one batch."""
    r = np.random.default_rng(4)
    rows = [(f, 2 * x, 2 * y, 120, 90, float(r.uniform(1, 3)), float(r.integers(50)) / 50) for f in "abc" for x in range(60) for y in range(45) if r.random() < 0.7]
    pick = lambda rows: {tuple(q) for q in G.pair_seeds(spark.createDataFrame(rows, "frame string, x long, y long, w long, h long, vd double, score double").coalesce(1)).collect()}
    want = set().union(*[pick([q for q in rows if q[0] == f]) for f in "abc"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = pick(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) > 100
