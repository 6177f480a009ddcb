"""Neighbour graph queries on the lens grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..operators import neighbors as N
from ..operators import reproject as R
from ..schema import TILE
from .catalog import register
from .reprojection import REPRO
from .reprojection import T as REPRO_TABLES
from .stats import rounded

B = X.BASELINE
PAIR = "tile_x, tile_y, ntile_x, ntile_y"
RINGS = """WITH RECURSIVE walk AS (SELECT tile_x, tile_y, ntile_x, ntile_y, 1 AS ring FROM edges
  UNION SELECT w.tile_x, w.tile_y, e.ntile_x, e.ntile_y, w.ring + 1 FROM walk w JOIN edges e ON e.tile_x = w.ntile_x AND e.tile_y = w.ntile_y WHERE w.ring < {most}),
rings AS (SELECT tile_x, tile_y, ntile_x, ntile_y, min(ring) AS ring FROM walk WHERE tile_x <> ntile_x OR tile_y <> ntile_y GROUP BY ALL)"""
SIMILAR = """, steps AS (SELECT e.*, s, CAST(floor(round(s * 2.0 * wx / sqrt(wx * wx + wy * wy), 6) + 0.5) AS BIGINT) AS tx, CAST(floor(round(s * 2.0 * wy / sqrt(wx * wx + wy * wy), 6) + 0.5) AS BIGINT) AS ty FROM
  (SELECT *, CASE WHEN abs(ux) * 12 < 5 THEN 0.0 ELSE -ux END AS wx, CASE WHEN abs(uy) * 12 < 5 THEN 0.0 ELSE -uy END AS wy FROM {edges}) e, range(0, 4) r(s)),
sim AS (SELECT tile_x, tile_y, ntile_x, ntile_y, CAST(max(same) AS DOUBLE) AS similarity FROM (
  SELECT s.tile_x, s.tile_y, s.ntile_x, s.ntile_y, s.s, count(*) FILTER ((a.v > 128) = (b.v > 128)) AS same FROM steps s JOIN pixel a ON a.tile_x = s.tile_x AND a.tile_y = s.tile_y
  JOIN pixel b ON b.tile_x = s.ntile_x AND b.tile_y = s.ntile_y AND b.x = a.x - s.tx AND b.y = a.y - s.ty GROUP BY ALL) GROUP BY ALL)"""


def recursive(body, *names):
    """SQL gives WITH RECURSIVE to the whole list."""
    return sql(body.replace("WITH RECURSIVE", "WITH", 1), *names).replace("WITH ", "WITH RECURSIVE ", 1)


@register("adjacency", sql(f"SELECT {PAIR}, round(baseline, 6) AS baseline, round(ux, 6) AS ux, round(uy, 6) AS uy FROM edges", "edges"))
def adjacency(spark, sf):
    return rounded(X.edges(spark, sf), "baseline", "ux", "uy")


@register("ring_expansion", recursive(RINGS.format(most=5) + f" SELECT {PAIR}, ring FROM rings", "edges"))
def ring_expansion(spark, sf):
    return N.rings(X.edges(spark, sf), 5)


@register("window_rings", sql(f"""SELECT {PAIR}, CASE WHEN d <= 1.1 THEN 1 WHEN d <= 2.1 THEN 2 WHEN d <= 3.1 THEN 3 ELSE 4 END AS ring FROM (
  SELECT a.tile_x, a.tile_y, b.tile_x AS ntile_x, b.tile_y AS ntile_y, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) / 12 AS d FROM lens a JOIN lens b ON abs(a.tile_x - b.tile_x) <= 4 AND abs(a.tile_y - b.tile_y) <= 4) WHERE d BETWEEN 0.9 AND 4.1""", "lens"))
def window_rings(spark, sf):
    return N.window_rings(X.lens(spark, sf), B)


@register("two_ring_offsets", sql(f"""SELECT {PAIR}, CASE WHEN steps <= 1.001 THEN 1 ELSE 2 END AS ring FROM (SELECT a.tile_x, a.tile_y, b.tile_x AS ntile_x, b.tile_y AS ntile_y,
  greatest(abs(a.tile_y - b.tile_y), abs(a.cx - b.cx) / 12 + abs(a.tile_y - b.tile_y) / 2) AS steps FROM lens a JOIN lens b ON abs(a.tile_x - b.tile_x) <= 2 AND abs(a.tile_y - b.tile_y) <= 2) WHERE steps > 0 AND steps <= 2.001""", "lens"))
def two_ring_offsets(spark, sf):
    return N.two_rings(X.lens(spark, sf))


@register("nearest_neighbors", sql(f"SELECT {PAIR}, round(baseline, 6) AS baseline, CAST(row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY round(baseline, 6), ntile_y, ntile_x) - 1 AS INT) AS rank FROM edges", "edges"))
def nearest_neighbors(spark, sf):
    return rounded(N.nearest_first(X.edges(spark, sf)), "baseline")


@register("projected_steps", sql("""WITH moves AS (SELECT round(b.cx - a.cx, 6) AS dx, round(b.cy - a.cy, 6) AS dy, CAST(greatest(abs(a.tile_y - b.tile_y), round(abs(a.cx - b.cx) / 12 + abs(a.tile_y - b.tile_y) / 2)) AS BIGINT) AS k
    FROM lens a JOIN lens b ON abs(a.tile_x - b.tile_x) <= 2 AND abs(a.tile_y - b.tile_y) <= 2 AND (a.tile_x <> b.tile_x OR a.tile_y <> b.tile_y)),
  ways AS (SELECT DISTINCT round(ux * baseline, 6) AS bx, round(uy * baseline, 6) AS by_ FROM edges)
  SELECT bx, by_ AS by, CAST(1 AS BIGINT) AS k, count(*) AS n, CASE WHEN count(*) >= 6 THEN median(round(abs(dx * bx + dy * by_) / sqrt(bx * bx + by_ * by_), 6)) ELSE 12.0 END AS p_tot FROM ways JOIN moves ON k = 1
  AND acos(greatest(-1, least(1, (dx * bx + dy * by_) / sqrt(dx * dx + dy * dy) / sqrt(bx * bx + by_ * by_)))) * 57.29578 <= 12 GROUP BY bx, by_""", "edges"))
def projected_steps(spark, sf):
    return N.projected_steps(X.lens(spark, sf), X.edges(spark, sf), B)


@register("shift_similarity", sql("WITH e0 AS (SELECT * FROM edges)" + SIMILAR.format(edges="edges") + f" SELECT {PAIR}, similarity FROM sim", "pixel", "edges"))
def shift_similarity(spark, sf):
    return N.similarity(X.pixel(spark, sf), X.edges(spark, sf))


@register("wide_similarity", sql("WITH e0 AS (SELECT * FROM edges)" + SIMILAR.format(edges="edges").replace("JOIN pixel", "JOIN wide") + f" SELECT {PAIR}, similarity FROM sim", "wide", "edges"))
def wide_similarity(spark, sf):
    """A52 on tiles of 16 x 16 pixels."""
    return N.similarity(X.wide_pixel(spark, sf), X.edges(spark, sf), side=16)


def ring_neighbors(spark, sf, most=3):
    """Neighbours of the first rings with distance, direction and similarity."""
    lens = X.lens(spark, sf)
    r = N.rings(X.edges(spark, sf), most)
    n = r.join(lens.select(*TILE, "cx", "cy"), TILE).join(lens.select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("cx").alias("ncx"), F.col("cy").alias("ncy")), ["ntile_x", "ntile_y"])
    dx, dy = F.col("cx") - F.col("ncx"), F.col("cy") - F.col("ncy")
    d = F.sqrt(dx * dx + dy * dy)
    n = n.select(*N.PAIR, "ring", d.alias("baseline"), (dx / d).alias("ux"), (dy / d).alias("uy"))
    return n.join(N.similarity(X.pixel(spark, sf), n), N.PAIR).drop("ux", "uy")


FULL = RINGS.format(most=3) + """, far AS (SELECT r.*, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS baseline, (a.cx - b.cx) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS ux, (a.cy - b.cy) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS uy
  FROM rings r JOIN lens a ON a.tile_x = r.tile_x AND a.tile_y = r.tile_y JOIN lens b ON b.tile_x = r.ntile_x AND b.tile_y = r.ntile_y)""" + SIMILAR.format(edges="far") + """,
nb AS (SELECT f.tile_x, f.tile_y, f.ntile_x, f.ntile_y, f.ring, f.baseline, s.similarity FROM far f JOIN sim s USING (tile_x, tile_y, ntile_x, ntile_y)),
fit AS (SELECT tile_x, tile_y, regr_slope(similarity, baseline) AS slope, regr_intercept(similarity, baseline) AS intercept FROM nb WHERE baseline < 25.2 GROUP BY 1, 2),
outl AS (SELECT n.*, CAST(coalesce(baseline > 12.6 AND round(abs(similarity - (slope * baseline + intercept)) / nullif(similarity, 0), 9) > 0.1, false) AS INT) AS outlier FROM nb n LEFT JOIN fit f USING (tile_x, tile_y))"""


@register("ring_fit", recursive(FULL + " SELECT tile_x, tile_y, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM fit", "pixel", "edges"))
def ring_fit(spark, sf):
    return rounded(N.ring_fit(ring_neighbors(spark, sf), B), "slope", "intercept", places=5)


@register("ring_outliers", recursive(FULL + f" SELECT {PAIR}, ring, round(baseline, 6) AS baseline, similarity, outlier FROM outl", "pixel", "edges"))
def ring_outliers(spark, sf):
    n = ring_neighbors(spark, sf)
    return rounded(N.ring_outliers(n, N.ring_fit(n, B), B), "baseline")


@register("ring_stop", recursive(FULL + f""", stop AS (SELECT tile_x, tile_y, min(ring) AS stop FROM (SELECT tile_x, tile_y, ring, sum(outlier) AS bad FROM outl GROUP BY ALL) WHERE bad >= 2 GROUP BY 1, 2)
  SELECT {PAIR}, ring, round(baseline, 6) AS baseline, similarity, outlier FROM outl LEFT JOIN stop USING (tile_x, tile_y) WHERE stop IS NULL OR ring < stop""", "pixel", "edges"))
def ring_stop(spark, sf):
    return rounded(N.ring_stop(ring_neighbors(spark, sf), B), "baseline")


RANK = f"SELECT {PAIR}, ring, similarity, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY round(score, 9) DESC, ntile_y, ntile_x) - 1 AS INT) AS rank FROM s"


@register("match_score", recursive(FULL + f""", s AS (SELECT *, 1 - coalesce((baseline - least(0, a)) / nullif(greatest(0, b) - least(0, a), 0), 0) AS score FROM (SELECT *, min(baseline) OVER w AS a, max(baseline) OVER w AS b FROM nb WINDOW w AS (PARTITION BY tile_x, tile_y))) {RANK}""", "pixel", "edges"))
def match_score(spark, sf):
    return rounded(N.match_score(ring_neighbors(spark, sf)).drop("baseline"), "score")


@register("refocus_score", recursive(FULL + f""", s AS (SELECT *, 0.5 * coalesce((similarity - a) / nullif(b - a, 0), 0) + 0.3 * exp(-5e-6 * pow(baseline - 12, 2) * CASE WHEN baseline >= 12 THEN 28 ELSE 1 END) + 0.2 AS score
  FROM (SELECT * REPLACE (CASE WHEN abs(baseline - 12) < 1e-9 THEN 12.0 ELSE baseline END AS baseline), min(similarity) OVER w AS a, max(similarity) OVER w AS b FROM nb WINDOW w AS (PARTITION BY tile_x, tile_y))) {RANK}""", "pixel", "edges"))
def refocus_score(spark, sf):
    return rounded(N.refocus_score(ring_neighbors(spark, sf), 12.0).drop("baseline"), "score")


#: Pixels and the whole places in the neighbours that they reproject to, and the correlation of the patches about both.
NCC = REPRO + """, m AS (SELECT tile_x, tile_y, ntile_x, ntile_y, x AS px, y AS py, CAST(floor(qx + 0.5) AS BIGINT) AS qx, CAST(floor(qy + 0.5) AS BIGINT) AS qy FROM q WHERE qx BETWEEN 0 AND 7 AND qy BETWEEN 0 AND 7),
h AS (SELECT *, least(5, px, py, qx, qy, 7 - px, 7 - py, 7 - qx, 7 - qy) AS half FROM m),
ncc AS (SELECT h.tile_x, h.tile_y, h.ntile_x, h.ntile_y, px, py, qx, qy, coalesce(abs(covar_pop(a.v, b.v) / nullif(sqrt(var_pop(a.v) * var_pop(b.v)), 0)), 0) AS ncc FROM h JOIN pixel a ON a.tile_x = h.tile_x AND a.tile_y = h.tile_y AND abs(a.x - px) <= half AND abs(a.y - py) <= half
  JOIN pixel b ON b.tile_x = h.ntile_x AND b.tile_y = h.ntile_y AND b.x = a.x - px + qx AND b.y = a.y - py + qy GROUP BY ALL)"""


def patches(spark, sf):
    """Every valid pixel and the whole place in each neighbour that it reprojects to, with their correlation."""
    r = R.reprojected(X.disparity(spark, sf), X.edges(spark, sf), B)
    m = r.select(*N.PAIR, F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("qx") + 0.5).alias("qx"), F.floor(F.col("qy") + 0.5).alias("qy"))
    return N.ncc(X.pixel(spark, sf), m)


@register("patch_ncc", sql(f"WITH {NCC} SELECT {PAIR}, px, py, qx, qy, round(ncc, 6) AS ncc FROM ncc", *REPRO_TABLES))
def patch_ncc(spark, sf):
    return rounded(patches(spark, sf), "ncc")


@register("ncc_top", sql(f"""WITH {NCC}, g AS (SELECT {PAIR}, CAST(1 AS INT) AS ring, count(*) FILTER (round(ncc, 9) > 0.8) AS points, coalesce(avg(ncc) FILTER (round(ncc, 9) > 0.8), 0) AS mean FROM ncc GROUP BY {PAIR}),
  s AS (SELECT *, 0.5 * coalesce((points - coalesce(avg(points) FILTER (points > 0) OVER w, 0)) / nullif(stddev_pop(points) FILTER (points > 0) OVER w, 0), 0) + 0.5 * coalesce((mean - coalesce(avg(mean) FILTER (points > 0) OVER w, 0)) / nullif(stddev_pop(mean) FILTER (points > 0) OVER w, 0), 0) AS score FROM g WINDOW w AS (PARTITION BY tile_x, tile_y)),
  p AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY round(score, 9) DESC, ntile_y, ntile_x) AS INT) AS place FROM s) SELECT {PAIR}, ring, points, round(mean, 6) AS mean, round(score, 5) AS score, place FROM p WHERE place <= 3""", *REPRO_TABLES))
def ncc_top(spark, sf):
    return rounded(rounded(N.ncc_top(patches(spark, sf).withColumn("ring", F.lit(1))), "mean"), "score", places=5)


@register("weighted_ncc_cost", sql(f"""WITH w AS (SELECT p.*, exp(-sqrt(pow(p.x - 4, 2) + pow(p.y - 4, 2)) / 50.0 - abs(p.v - c.v) / 1800.0) AS w FROM pixel p JOIN pixel c ON c.tile_x = p.tile_x AND c.tile_y = p.tile_y AND c.x = 4 AND c.y = 4),
  m AS (SELECT e.tile_x, e.tile_y, e.ntile_x, e.ntile_y, sum(w) AS s, sum(w * a.v) AS sv, sum(w * b.v) AS su, sum(w * a.v * a.v) AS svv, sum(w * b.v * b.v) AS suu, sum(w * a.v * b.v) AS svu FROM edges e JOIN w a ON a.tile_x = e.tile_x AND a.tile_y = e.tile_y JOIN pixel b ON b.tile_x = e.ntile_x AND b.tile_y = e.ntile_y AND b.x = a.x AND b.y = a.y GROUP BY ALL)
  SELECT {PAIR}, round(CASE WHEN svv / s - pow(sv / s, 2) < 1e-5 OR suu / s - pow(su / s, 2) < 1e-5 THEN 2.0 ELSE least(2, greatest(0, 1 - (svu / s - sv * su / s / s) / sqrt((svv / s - pow(sv / s, 2)) * (suu / s - pow(su / s, 2))))) END, 6) AS cost FROM m""", "pixel", "edges"))
def weighted_ncc_cost(spark, sf):
    return rounded(N.weighted_ncc_cost(X.pixel(spark, sf), X.edges(spark, sf)), "cost")


@register("similarity_measures", sql(f"""SELECT {PAIR}, round(euclid, 5) AS euclid, round((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM (
  SELECT e.tile_x, e.tile_y, e.ntile_x, e.ntile_y, sqrt(sum(pow(a.v - b.v, 2))) AS euclid, avg(a.v) AS ma, avg(b.v) AS mb, var_pop(a.v) AS va, var_pop(b.v) AS vb, covar_pop(a.v, b.v) AS cov FROM edges e JOIN pixel a ON a.tile_x = e.tile_x AND a.tile_y = e.tile_y JOIN pixel b ON b.tile_x = e.ntile_x AND b.tile_y = e.ntile_y AND b.x = a.x AND b.y = a.y GROUP BY ALL)""", "pixel", "edges"))
def similarity_measures(spark, sf):
    return rounded(rounded(N.similarity_measures(X.pixel(spark, sf), X.edges(spark, sf)), "euclid", places=5), "ssim")


@register("area_filter", sql("SELECT tile_x, tile_y, area FROM lens WHERE area >= 0.8 * (SELECT avg(area) FROM lens)", "lens"))
def area_filter(spark, sf):
    """P03."""
    lens = X.lens(spark, sf)
    return lens.crossJoin(F.broadcast(lens.agg(F.avg("area").alias("mean")))).where("area >= 0.8 * mean").select(*TILE, "area")  # one row


@register("crop_inside", sql("SELECT tile_x, tile_y FROM lens, (SELECT max(cx) + 4 AS w, max(cy) + 4 AS h FROM lens) WHERE cx - 8 // 2 >= 0 AND cy - 8 // 2 >= 0 AND cx + 8 // 2 <= w AND cy + 8 // 2 <= h AND cx - 4 >= 5 AND cy - 4 >= 5", "lens"))
def crop_inside(spark, sf):
    """Lenses whose crop, of the side of P10, lies within the array and its margin of five pixels."""
    from ..functions.scalar import crop_side

    lens = X.lens(spark, sf)
    size = lens.agg((F.max("cx") + 4).alias("w"), (F.max("cy") + 4).alias("h"))
    half = F.floor(crop_side(F.lit(B)) / 2)
    j = lens.crossJoin(F.broadcast(size))  # one row
    return j.where((F.col("cx") - half >= 5) & (F.col("cy") - half >= 5) & (F.col("cx") + half <= F.col("w")) & (F.col("cy") + half <= F.col("h"))).select(*TILE)


@register("garbage_tiles", sql("SELECT l.tile_x, l.tile_y, CAST(coalesce(n, 0) = 0 OR l.tile_x < 1 OR l.tile_y < 1 AS INT) AS garbage FROM lens l LEFT JOIN (SELECT tile_x, tile_y, count(*) AS n FROM edges GROUP BY 1, 2) e USING (tile_x, tile_y)", "edges"))
def garbage_tiles(spark, sf):
    """P05."""
    n = X.edges(spark, sf).groupBy(*TILE).agg(F.count("*").alias("n"))
    return X.lens(spark, sf).select(*TILE).join(n, TILE, "left").select(*TILE, (F.col("n").isNull() | (F.col("tile_x") < 1) | (F.col("tile_y") < 1)).cast("int").alias("garbage"))


@register("row_clusters", sql("""WITH g AS (SELECT tile_x, tile_y, cx, cy, CASE WHEN cy - lag(cy) OVER (ORDER BY cy, cx) > 6 THEN 1 ELSE 0 END AS step FROM lens),
  r AS (SELECT *, sum(step) OVER (ORDER BY cy, cx) AS row FROM g) SELECT tile_x, tile_y, CAST(row AS BIGINT) AS row, CAST(row_number() OVER (PARTITION BY row ORDER BY cx) - 1 AS INT) AS col FROM r""", "lens"))
def row_clusters(spark, sf):
    """W20, gap rule: a new row where y jumps by more than half a baseline; columns in order of x.

    Rows are found on distinct y values, a few per row of lenses, so the one
    ordered window is over them and not over the lenses.
    """
    lens = X.lens(spark, sf)
    ys = lens.select(F.round("cy", 6).alias("y")).distinct()
    order = Window.orderBy("y")
    ys = ys.withColumn("step", F.coalesce((F.col("y") - F.lag("y").over(order) > B / 2).cast("long"), F.lit(0))).withColumn("row", F.sum("step").over(order))
    j = lens.withColumn("y", F.round("cy", 6)).join(ys.select("y", "row"), "y")
    return j.select(*TILE, "row", (F.row_number().over(Window.partitionBy("row").orderBy("cx")) - 1).alias("col"))


@register("baseline_normal", sql(f"SELECT {PAIR}, round(exp(-baseline / greatest(1, max(baseline) OVER (PARTITION BY tile_x, tile_y))), 6) AS weight FROM edges", "edges"))
def baseline_normal(spark, sf):
    """A31."""
    w = Window.partitionBy(*TILE)
    return X.edges(spark, sf).select(*N.PAIR, F.round(F.exp(-F.col("baseline") / F.greatest(F.lit(1.0), F.max("baseline").over(w))), 6).alias("weight"))


@register("adaptive_rows", sql("""WITH RECURSIVE y AS (SELECT y, c, row_number() OVER (ORDER BY y) AS i FROM (SELECT round(cy, 3) AS y, count(*) AS c FROM lens GROUP BY 1)),
  w AS (SELECT i, y, CAST(0 AS BIGINT) AS row, y * c AS s, c AS n FROM y WHERE i = 1 UNION ALL SELECT y.i, y.y, CASE WHEN y.y - s / n >= 6 THEN row + 1 ELSE row END, CASE WHEN y.y - s / n >= 6 THEN y.y * y.c ELSE s + y.y * y.c END, CASE WHEN y.y - s / n >= 6 THEN y.c ELSE n + y.c END FROM w JOIN y ON y.i = w.i + 1)
  SELECT tile_x, tile_y, row, CAST(row_number() OVER (PARTITION BY row ORDER BY cx) - 1 AS INT) AS col FROM lens JOIN w ON w.y = round(cy, 3)""".replace("WITH RECURSIVE", "WITH", 1), "lens").replace("WITH ", "WITH RECURSIVE ", 1))
def adaptive_rows(spark, sf):
    return N.adaptive_rows(X.lens(spark, sf), B)


_PLACES = ", ".join(f"('{c}', '{r}', {a}, {b})" for (c, r), steps in N.POSITIONS.items() for a, b in steps)


@register("fixed_positions", sql(f"""WITH size AS (SELECT max(tile_x) + 1 AS w, max(tile_y) + 1 AS h FROM lens), place(c, r, dx, dy) AS (VALUES {_PLACES}),
  spot AS (SELECT tile_x, tile_y, cx, cy, CASE WHEN tile_x = 0 THEN 'first' WHEN tile_y = 0 THEN 'inner' WHEN tile_x = 1 THEN 'second' WHEN tile_x = w - 1 THEN 'last' WHEN tile_x = w - 2 THEN 'last but one' ELSE 'inner' END AS c, CASE WHEN tile_y = 0 THEN 'top' WHEN tile_y = h - 1 THEN 'bottom' ELSE 'middle' END AS r FROM lens, size),
  j AS (SELECT a.tile_x, a.tile_y, b.tile_x AS ntile_x, b.tile_y AS ntile_y, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS baseline FROM spot a JOIN place p USING (c, r) JOIN lens b ON b.tile_x = a.tile_x + dx AND b.tile_y = a.tile_y + dy WHERE b.area >= 72)
  SELECT tile_x, tile_y, ntile_x, ntile_y, round(baseline, 6) AS baseline, CAST(row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY round(baseline, 6), ntile_y, ntile_x) - 1 AS INT) AS rank FROM j""", "lens"))
def fixed_positions(spark, sf):
    """J05 on the whole grid; lenses of small area are left out as neighbours."""
    lens = X.lens(spark, sf)
    size = lens.agg(F.max("tile_x"), F.max("tile_y")).first()  # one row
    return rounded(N.fixed_positions(lens, lens.where("area >= 72"), size[0] + 1, size[1] + 1), "baseline")
