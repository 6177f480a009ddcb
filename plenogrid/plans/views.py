"""Multi-view queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..operators import grid as G
from ..operators import mvs as M
from ..operators import reproject as R
from ..schema import SITE, TILE
from .catalog import register
from .fuse import SPLAT, splat_of
from .grids import K, MIRROR, SOBEL
from .reprojection import REPRO
from .reprojection import T as REPRO_TABLES
from .stats import rounded

KM = [100.0, 0.0, 100.0, 0.0, 100.0, 80.0, 0.0, 0.0, 1.0]


def _camera(i: int) -> tuple[list[float], list[float]]:
    """Rotation and translation of view i: half a unit apart, turned a little towards the middle one and about the line of sight."""
    a, b = 0.01 * (i - 1), 0.004 * (i - 1)
    ca, sa, cb, sb = math.cos(a), math.sin(a), math.cos(b), math.sin(b)
    r = [cb * ca, -sb, cb * sa, sb * ca, cb, sb * sa, -sa, 0.0, ca]
    c = [0.5 * i, 0.02 * i, 0.0]
    return r, [-sum(r[3 * k + m] * c[m] for m in range(3)) for k in range(3)]


CAMERAS = {i: _camera(i) for i in range(3)}
_CAM = ", ".join("(" + ", ".join([str(i), *(f"CAST({x!r} AS DOUBLE)" for x in [*r, *t])]) + ")" for i, (r, t) in CAMERAS.items())


def _world(u: str, v: str, d: str, c: str) -> list[str]:
    """SQL of the world point of a pixel, with the camera columns of ``c``."""
    cam = [f"(({u} - 100) / CAST(100 AS DOUBLE) * {d} - {c}.t0)", f"(({v} - 80) / CAST(100 AS DOUBLE) * {d} - {c}.t1)", f"({d} - {c}.t2)"]
    return [" + ".join(f"{cam[k]} * {c}.r{3 * k + j}" for k in range(3)) for j in range(3)]


def _seen(p: list[str], c: str) -> tuple[str, str, str]:
    cam = ["(" + " + ".join([f"{c}.t{k}", *(f"{p[j]} * {c}.r{3 * k + j}" for j in range(3))]) + ")" for k in range(3)]
    return f"(100 * {cam[0]} / {cam[2]} + 100)", f"(100 * {cam[1]} / {cam[2]} + 80)", cam[2]


def _fusion_sql() -> str:
    names = ", ".join([f"r{k}" for k in range(9)] + [f"t{k}" for k in range(3)])
    w = ", ".join(f"{e} AS w{k}" for k, e in enumerate(_world("d.x", "d.y", "depth", "c")))
    u, v, _ = _seen(["p.w0", "p.w1", "p.w2"], "s")
    bu, bv, bz = _seen(["q.w0", "q.w1", "q.w2"], "c")
    means = ", ".join(f"round((sum({o}) + any_value({m})) / (count(*) + 1), 5) AS {n}" for n, m, o in (("px", "w0", "q0"), ("py", "w1", "q1"), ("pz", "w2", "q2"), ("nx", "nx", "snx"), ("ny", "ny", "sny"), ("nz", "nz", "snz"), ("v", "v", "sv")))
    return sql(f"""WITH cam(image, {names}) AS (VALUES {_CAM}), pix AS (SELECT tile_x, tile_y, x, y, px.e, pixel.v FROM px JOIN pixel USING (tile_x, tile_y, x, y)),
  dm AS (SELECT i AS image, 8 * tile_x + x AS x, 8 * tile_y + y AS y, CAST(10 AS DOUBLE) + CAST(0.2 AS DOUBLE) * e AS depth, sin(e) AS nx, CAST(0 AS DOUBLE) AS ny, cos(e) AS nz, v FROM pix, range(0, 3) r(i)),
  pts AS (SELECT d.*, {w} FROM dm d JOIN cam c USING (image)),
  p AS (SELECT p.*, s.image AS src, CAST(floor({u} + 0.5) AS BIGINT) AS sx, CAST(floor({v} + 0.5) AS BIGINT) AS sy FROM pts p, cam s WHERE p.image = 1 AND s.image <> 1),
  j AS (SELECT p.*, q.w0 AS q0, q.w1 AS q1, q.w2 AS q2, q.nx AS snx, q.ny AS sny, q.nz AS snz, q.v AS sv, {bu} AS bu, {bv} AS bv, {bz} AS bz FROM p JOIN pts q ON q.image = p.src AND q.x = p.sx AND q.y = p.sy JOIN cam c ON c.image = p.image),
  k AS (SELECT * FROM j WHERE sqrt(pow(bu - x, 2) + pow(bv - y, 2)) < 2 AND abs(bz - depth) / depth < 0.01 AND acos(greatest(-1, least(1, nx * snx + ny * sny + nz * snz))) < 0.174533)
  SELECT CAST(image AS BIGINT) AS ref, x, y, count(*) AS n, {means} FROM k GROUP BY image, x, y HAVING count(*) >= 2""", "px", "pixel")


@register("view_fusion", _fusion_sql())
def view_fusion(spark, sf):
    """Three turned views of one relief; the middle one is the reference."""
    pix = X.px(spark, sf).join(X.pixel(spark, sf), SITE)
    p = pix.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("image"), (8 * F.col("tile_x") + F.col("x")).alias("x"), (8 * F.col("tile_y") + F.col("y")).alias("y"),
        (10 + 0.2 * F.col("e")).alias("depth"), F.sin("e").alias("nx"), F.lit(0.0).alias("ny"), F.cos("e").alias("nz"), "v",
    )
    pairs = spark.sql("SELECT * FROM VALUES (1L, 0L), (1L, 2L) AS t(ref, src)")
    cameras = spark.createDataFrame([(i, KM, r, t) for i, (r, t) in CAMERAS.items()], "image long, k array<double>, r array<double>, t array<double>")
    return rounded(M.fuse_views(p, pairs, cameras), "px", "py", "pz", "nx", "ny", "nz", "v", places=5)


@register("view_proposals", sql("WITH " + REPRO + """, v AS (SELECT *, floor(qx + 0.5) AS tx, floor(qy + 0.5) AS ty FROM q WHERE qx BETWEEN 0 AND 7 AND qy BETWEEN 0 AND 7),
  j AS (SELECT v.tile_x, v.tile_y, v.x, v.y, b.d, b.cost, row_number() OVER (PARTITION BY v.tile_x, v.tile_y, v.x, v.y ORDER BY round(b.cost, 9), v.ntile_y, v.ntile_x) AS k FROM v JOIN disparity b ON b.tile_x = v.ntile_x AND b.tile_y = v.ntile_y AND b.x = v.tx AND b.y = v.ty WHERE b.d > 0)
  SELECT tile_x, tile_y, x, y, round(d, 6) AS d, round(cost, 6) AS cost FROM j WHERE k = 1""", *REPRO_TABLES))
def view_proposals(spark, sf):
    d = X.disparity(spark, sf)
    return rounded(M.proposals(R.reprojected(d, X.edges(spark, sf), X.BASELINE), d), "d", "cost")


@register("planar_prior", sql("""WITH b AS (SELECT tile_x, tile_y, (y // 4) * 2 + x // 4 AS b, arg_min({'x': x, 'y': y, 'd': d}, (round(cost, 9), y, x)) AS p FROM disparity WHERE d IS NOT NULL GROUP BY ALL),
  t AS (SELECT tile_x, tile_y, max(p) FILTER (b = 0) AS s0, max(p) FILTER (b = 1) AS s1, max(p) FILTER (b = 2) AS s2, max(p) FILTER (b = 3) AS s3 FROM b GROUP BY ALL HAVING count(*) = 4),
  j AS (SELECT d.tile_x, d.tile_y, d.x, d.y, s1, s2, CASE WHEN ((s2.x - s1.x) * (d.y - s1.y) - (s2.y - s1.y) * (d.x - s1.x)) * ((s2.x - s1.x) * (s0.y - s1.y) - (s2.y - s1.y) * (s0.x - s1.x)) >= 0 THEN s0 ELSE s3 END AS c FROM disparity d JOIN t USING (tile_x, tile_y)),
  e AS (SELECT *, CAST((s1.x - c.x) * (s2.y - c.y) - (s1.y - c.y) * (s2.x - c.x) AS DOUBLE) AS det FROM j)
  SELECT tile_x, tile_y, x, y, round(c.d + ((x - c.x) * (s2.y - c.y) - (y - c.y) * (s2.x - c.x)) / det * (s1.d - c.d) + ((s1.x - c.x) * (y - c.y) - (s1.y - c.y) * (x - c.x)) / det * (s2.d - c.d), 5) AS prior FROM e WHERE det <> 0""", "disparity"))
def planar_prior(spark, sf):
    return rounded(M.planar_prior(X.disparity(spark, sf)), "prior", places=5)


@register("delaunay_prior", sql("""WITH b AS (SELECT tile_x, tile_y, arg_min({'x': x, 'y': y, 'd': d}, (round(cost, 9), y, x)) AS p FROM disparity WHERE d IS NOT NULL AND cost < 1.3 GROUP BY tile_x, tile_y, x // 3, y // 3),
  s AS MATERIALIZED (SELECT tile_x, tile_y, p.x AS x, p.y AS y, p.d AS d, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY p.y, p.x) AS i FROM b),
  t AS (SELECT a.tile_x, a.tile_y, a.i, b.i AS j, c.i AS k, a.x AS x0, a.y AS y0, a.d AS d0, b.x AS x1, b.y AS y1, b.d AS d1, c.x AS x2, c.y AS y2, c.d AS d2, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn
    FROM s a JOIN s b ON b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND b.i > a.i JOIN s c ON c.tile_x = a.tile_x AND c.tile_y = a.tile_y AND c.i > b.i),
  q AS (SELECT t.*, s.i AS l, x0 - s.x AS ax, y0 - s.y AS ay, x1 - s.x AS bx, y1 - s.y AS b_y, x2 - s.x AS cx, y2 - s.y AS cy FROM t JOIN s USING (tile_x, tile_y) WHERE turn <> 0),
  e AS MATERIALIZED (SELECT tile_x, tile_y, t.i, j, k, x0, y0, d0, x1, y1, d1, x2, y2, d2, turn FROM q t GROUP BY ALL HAVING NOT bool_or(((ax * ax + ay * ay) * (bx * cy - cx * b_y) + (bx * bx + b_y * b_y) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * b_y - bx * ay)) * sign(turn) > 0)),
  p AS (SELECT d.x, d.y, e.* FROM disparity d JOIN e USING (tile_x, tile_y) WHERE ((x1 - x0) * (d.y - y0) - (y1 - y0) * (d.x - x0)) * sign(turn) >= 0 AND ((x2 - x1) * (d.y - y1) - (y2 - y1) * (d.x - x1)) * sign(turn) >= 0 AND ((x0 - x2) * (d.y - y2) - (y0 - y2) * (d.x - x2)) * sign(turn) >= 0),
  f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY tile_x, tile_y, x, y ORDER BY i, j, k) = 1)
  SELECT tile_x, tile_y, x, y, round(d0 + ((d1 - d0) * (y2 - y0) - (d2 - d0) * (y1 - y0)) / turn * (x - x0) + ((d2 - d0) * (x1 - x0) - (d1 - d0) * (x2 - x0)) / turn * (y - y0), 5) AS prior FROM f""", "disparity"))
def delaunay_prior(spark, sf):
    """I05 with a triangulation of the supports; ``matching.prior_seed`` makes its planes a seed of the second matching."""
    return rounded(M.delaunay_prior(X.disparity(spark, sf), good=1.3).select(*SITE, "prior"), "prior", places=5)


@register("region_growing", sql("""WITH v AS (SELECT tile_x, tile_y, x, y, d, cost FROM disparity WHERE d IS NOT NULL), g AS (SELECT tile_x, tile_y, x, y, d, 0 AS step FROM v WHERE cost < 1 AND (x + 3 * y) % 13 = 0
  UNION SELECT b.tile_x, b.tile_y, b.x, b.y, b.d, g.step + 1 FROM g JOIN v b ON b.tile_x = g.tile_x AND b.tile_y = g.tile_y AND abs(b.x - g.x) + abs(b.y - g.y) = 1 AND abs(b.d - g.d) <= 0.05 WHERE g.step < 63)
  SELECT tile_x, tile_y, x, y, CAST(min(step) AS BIGINT) AS step FROM g GROUP BY ALL""", "disparity").replace("WITH ", "WITH RECURSIVE ", 1))
def region_growing(spark, sf):
    """I12; no path in a tile of 64 pixels has more than 63 steps, which bounds the SQL."""
    d = X.disparity(spark, sf)
    seeds = d.where("d is not null and cost < 1 and (x + 3 * y) % 13 = 0")
    return M.grown(d, seeds, gate=0.05)


@register("all_in_focus", sql("WITH " + SPLAT + """, s AS (SELECT s.*, p.v FROM splat s JOIN pixel p USING (tile_x, tile_y, x, y)), m AS (SELECT vx, vy, median(vd) AS m FROM s GROUP BY 1, 2),
  w AS (SELECT vx, vy, v, row_number() OVER (PARTITION BY vx, vy ORDER BY round(score, 9) DESC, tile_y, tile_x, y, x) AS k FROM s)
  SELECT a.vx, a.vy, a.median, w.v AS best, b.mean FROM (SELECT vx, vy, median(v) AS median FROM s GROUP BY 1, 2) a JOIN w ON w.vx = a.vx AND w.vy = a.vy AND w.k = 1 LEFT JOIN (SELECT vx, vy, round(sum(score * v) / sum(score), 5) AS mean FROM s JOIN m USING (vx, vy) WHERE abs(vd - m) <= 1 GROUP BY 1, 2) b ON b.vx = a.vx AND b.vy = a.vy""", "lens", "disparity", "pixel"))
def all_in_focus(spark, sf):
    """Median, best and gated mean intensities of the splats at a place."""
    s = splat_of(spark, sf).join(X.pixel(spark, sf).select(*SITE, "v"), SITE)
    key = F.struct(F.round("score", 9), -F.col("tile_y"), -F.col("tile_x"), -F.col("y"), -F.col("x"))
    g = s.groupBy("vx", "vy").agg(F.median("v").alias("median"), F.max_by("v", key).alias("best"), F.median("vd").alias("m"))
    near = s.join(g.select("vx", "vy", "m"), ["vx", "vy"]).where(F.abs(F.col("vd") - F.col("m")) <= 1).groupBy("vx", "vy").agg(F.round(F.sum(F.col("score") * F.col("v")) / F.sum("score"), 5).alias("mean"))
    return g.drop("m").join(near, ["vx", "vy"], "left")


@register("selected_samples", sql(f"""WITH p AS (SELECT {K}, a.d, median(b.d) AS m, mad(b.d) AS mad, max(b.d) - min(b.d) AS span FROM disparity a JOIN disparity b ON a.tile_x = b.tile_x AND a.tile_y = b.tile_y AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.d IS NOT NULL WHERE a.d IS NOT NULL GROUP BY a.tile_x, a.tile_y, a.x, a.y, a.d HAVING count(*) >= 5),
  g AS (SELECT * FROM p WHERE mad <= 0.08 AND span <= 0.8), e AS (SELECT min(d) AS lo, max(d) AS hi FROM g), b AS (SELECT g.*, CAST(least(7, floor((d - lo) * 8 / (hi - lo))) AS BIGINT) AS bin, tile_x // 5 AS cx, tile_y // 5 AS cy, round(mad + span / 4, 9) AS penalty FROM g, e),
  t AS (SELECT *, row_number() OVER (PARTITION BY bin, cx, cy ORDER BY penalty, tile_y, tile_x, y, x) AS turn FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY turn, cy, cx) AS place FROM t)
  SELECT bin, CAST(place AS INT) AS place, tile_x, tile_y, x, y, round(d, 6) AS d, round(penalty, 6) AS penalty FROM o WHERE place <= 24""", "disparity"))
def selected_samples(spark, sf):
    return rounded(M.selected_samples(X.disparity(spark, sf)), "d", "penalty")


@register("edge_proxies", sql(f"""WITH {MIRROR}, {SOBEL}, s AS (SELECT p.tile_x, p.tile_y, p.x, p.y, p.v, CASE WHEN d.d > 0 AND d.cost <= 1.3 THEN d.d END AS d, sobel >= 100 AND (d.d IS NULL OR d.cost > 1.3) AS bad FROM pixel p JOIN disparity d USING (tile_x, tile_y, x, y) JOIN sobel USING (tile_x, tile_y, x, y)),
  j AS (SELECT a.tile_x, a.tile_y, a.x, a.y, b.d, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.tile_x, a.tile_y, a.x, a.y ORDER BY abs(a.v - b.v), (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.y - a.y, b.x - a.x) AS k FROM s a JOIN s b ON b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2 AND (b.x <> a.x OR b.y <> a.y)
    WHERE a.bad AND b.d IS NOT NULL AND abs(a.v - b.v) <= 20) SELECT tile_x, tile_y, x, y, round(d, 6) AS d, dx, dy FROM j WHERE k = 1""", "pixel", "disparity"))
def edge_proxies(spark, sf):
    """Pixels on intensity edges without a trusted disparity; ``mvs.edges_repaired`` goes on from pixel to pixel."""
    p = X.pixel(spark, sf)
    j = X.disparity(spark, sf).drop("frame").join(p.select(*SITE, "v"), SITE).join(G.sobel(p).select(*SITE, "sobel"), SITE)
    trusted = F.coalesce((F.col("d") > 0) & (F.col("cost") <= 1.3), F.lit(False))
    bad = j.where((F.col("sobel") >= 100) & (F.col("d").isNull() | (F.col("cost") > 1.3)))
    return rounded(M.edge_proxies(j.select(*SITE, "v", F.when(trusted, F.col("d")).alias("d")), bad), "d")


@register("spaced_samples", sql("""WITH g AS (SELECT 8 * tile_x + x AS x, 8 * tile_y + y AS y, round(cost, 9) AS c, CAST(floor((12 / d - 3) / 1.0) AS BIGINT) AS band FROM disparity WHERE d > 0), s AS (SELECT *, x // 34 AS cx, y // 34 AS cy FROM g),
  o1 AS (SELECT *, row_number() OVER (PARTITION BY band, cx, cy ORDER BY c, y, x) AS k FROM s), p1 AS (SELECT * FROM o1 WHERE k = 1),
  o2 AS (SELECT s.*, row_number() OVER (PARTITION BY s.band, s.cx, s.cy ORDER BY s.c, s.y, s.x) AS k FROM s JOIN p1 p USING (band, cx, cy) WHERE sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) >= 20), p2 AS (SELECT * FROM o2 WHERE k = 1),
  o3 AS (SELECT s.*, row_number() OVER (PARTITION BY s.band, s.cx, s.cy ORDER BY s.c, s.y, s.x) AS k FROM s JOIN p1 p USING (band, cx, cy) JOIN p2 q USING (band, cx, cy) WHERE sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) >= 20 AND sqrt(pow(s.x - q.x, 2) + pow(s.y - q.y, 2)) >= 20)
  SELECT band, cx, cy, place, x, y, round(c, 6) AS c FROM (SELECT band, cx, cy, 1 AS place, x, y, c FROM p1 UNION ALL SELECT band, cx, cy, 2, x, y, c FROM p2 UNION ALL SELECT band, cx, cy, 3, x, y, c FROM o3 WHERE k = 1)""", "disparity"))
def spaced_samples(spark, sf):
    """Three samples of every cell of 34 pixels and every band of virtual depth, 20 pixels apart, the cheapest first."""
    x, y = 8 * F.col("tile_x") + F.col("x"), 8 * F.col("tile_y") + F.col("y")
    g = X.disparity(spark, sf).where("d > 0").select(x.alias("x"), y.alias("y"), F.round("cost", 9).alias("c"), F.floor(X.BASELINE / F.col("d") - 3).alias("band"))
    g = g.withColumns({"cx": F.floor(F.col("x") / 34), "cy": F.floor(F.col("y") / 34)})
    return rounded(M.spaced(g, ["band", "cx", "cy"], ["c", "y", "x"], 3, 20.0), "c")


@register("remap", sql("""WITH g AS (SELECT 8 * tile_x + x AS gx, 8 * tile_y + y AS gy, v FROM pixel), t AS (SELECT gx, gy, CAST(floor(100 + (1 + CAST(1e-6 AS DOUBLE) * ((gx - 100) * (gx - 100) + (gy - 80) * (gy - 80))) * (gx - 100) + 0.5) AS BIGINT) AS sx,
  CAST(floor(80 + (1 + CAST(1e-6 AS DOUBLE) * ((gx - 100) * (gx - 100) + (gy - 80) * (gy - 80))) * (gy - 80) + 0.5) AS BIGINT) AS sy FROM g) SELECT t.gx, t.gy, g.v FROM t JOIN g ON g.gx = t.sx AND g.gy = t.sy""", "pixel"))
def remap(spark, sf):
    p = X.pixel(spark, sf).select((8 * F.col("tile_x") + F.col("x")).alias("gx"), (8 * F.col("tile_y") + F.col("y")).alias("gy"), "v")
    return M.remapped(p, 100.0, 80.0, 1e-6)


@register("hashed_tiles", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS k FROM embeddings) WHERE k <= 8")
def hashed_tiles(spark, sf):
    """Eight tiles for inspection, the same ones every time; the limit is the feature."""
    return X.table(spark, sf, "embeddings").select("vec_id").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(8)


@register("tile_joins", sql("""SELECT l.tile_x, l.tile_y, l.area, valid, coalesce(n, 0) AS neighbours FROM lens l JOIN (SELECT tile_x, tile_y, count(d) AS valid FROM disparity GROUP BY 1, 2) d USING (tile_x, tile_y)
  LEFT JOIN (SELECT tile_x, tile_y, count(*) AS n FROM edges GROUP BY 1, 2) e USING (tile_x, tile_y)""", "edges", "disparity"))
def tile_joins(spark, sf):
    """Lens, disparity and edges by tile key; each side is brought to one row a tile before they meet."""
    n = X.edges(spark, sf).groupBy(*TILE).agg(F.count("*").alias("neighbours"))
    d = X.disparity(spark, sf).groupBy(*TILE).agg(F.count("d").alias("valid"))
    return X.lens(spark, sf).select(*TILE, "area").join(d, TILE).join(n, TILE, "left").select(*TILE, "area", "valid", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
