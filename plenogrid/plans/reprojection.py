"""Reprojection queries on the disparity grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..functions import scalar as C
from ..functions.keys import bits
from ..operators import grid as G
from ..operators import reproject as R
from ..schema import SITE, TILE
from .catalog import register
from .grids import K, MIRROR, NEAR, SOBEL
from .stats import rounded

B = X.BASELINE
#: Corners of the reprojected place in the neighbour, all valid.
REPRO = """own AS (SELECT d.*, p.v FROM disparity d JOIN pixel p USING (tile_x, tile_y, x, y)),
q AS (SELECT d.tile_x, d.tile_y, d.x, d.y, e.ntile_x, e.ntile_y, d.d, d.cost, d.v, e.ux, e.uy, e.baseline / 12 AS scale, d.x + e.ux * d.d * (e.baseline / 12) AS qx, d.y + e.uy * d.d * (e.baseline / 12) AS qy FROM own d JOIN edges e USING (tile_x, tile_y) WHERE d.d > 0),
r AS (SELECT q.*, (1-(qx-floor(qx)))*(1-(qy-floor(qy)))*a.d + (1-(qx-floor(qx)))*(qy-floor(qy))*b.d + (qx-floor(qx))*(1-(qy-floor(qy)))*c.d + (qx-floor(qx))*(qy-floor(qy))*e.d AS n_d,
  (1-(qx-floor(qx)))*(1-(qy-floor(qy)))*a.cost + (1-(qx-floor(qx)))*(qy-floor(qy))*b.cost + (qx-floor(qx))*(1-(qy-floor(qy)))*c.cost + (qx-floor(qx))*(qy-floor(qy))*e.cost AS n_cost,
  (1-(qx-floor(qx)))*(1-(qy-floor(qy)))*a.v + (1-(qx-floor(qx)))*(qy-floor(qy))*b.v + (qx-floor(qx))*(1-(qy-floor(qy)))*c.v + (qx-floor(qx))*(qy-floor(qy))*e.v AS n_v
  FROM q JOIN own a ON a.tile_x = ntile_x AND a.tile_y = ntile_y AND a.x = floor(qx) AND a.y = floor(qy) JOIN own b ON b.tile_x = ntile_x AND b.tile_y = ntile_y AND b.x = floor(qx) AND b.y = least(floor(qy) + 1, 7)
  JOIN own c ON c.tile_x = ntile_x AND c.tile_y = ntile_y AND c.x = least(floor(qx) + 1, 7) AND c.y = floor(qy) JOIN own e ON e.tile_x = ntile_x AND e.tile_y = ntile_y AND e.x = least(floor(qx) + 1, 7) AND e.y = least(floor(qy) + 1, 7)
  WHERE qx BETWEEN 0 AND 7 AND qy BETWEEN 0 AND 7),
err AS (SELECT *, sqrt(pow(qx - ux * n_d * scale - x, 2) + pow(qy - uy * n_d * scale - y, 2)) AS error FROM r WHERE n_d IS NOT NULL),
costs AS (SELECT tile_x, tile_y, x, y, ntile_x, ntile_y, d, least(2.0, abs(v - n_v) / 64) AS cost, scale FROM r WHERE n_v IS NOT NULL)"""
T = ("pixel", "edges", "disparity")
S = "tile_x, tile_y, x, y"


def q(body: str) -> str:
    body = body.strip()
    return sql("WITH " + REPRO + (", " + body[5:] if body.startswith("WITH ") else " " + body), *T)


def errors(spark, sf):
    return R.cycle_errors(X.disparity(spark, sf), X.edges(spark, sf), B, "cost")


def costs(spark, sf):
    return R.view_costs(X.disparity(spark, sf), X.pixel(spark, sf), X.edges(spark, sf), B)


@register("reprojection_join", q(f"SELECT {S}, ntile_x, ntile_y, round(qx, 6) AS qx, round(qy, 6) AS qy, round(n_d, 6) AS n_d FROM r WHERE n_d IS NOT NULL"))
def reprojection_join(spark, sf):
    r = R.reprojected(X.disparity(spark, sf), X.edges(spark, sf), B).where("n_d is not null")
    return rounded(r.select(*SITE, "ntile_x", "ntile_y", "qx", "qy", "n_d"), "qx", "qy", "n_d")


@register("geometric_map", sql("""WITH p AS (SELECT d.tile_x, d.tile_y, e.ntile_x, e.ntile_y, d.x, d.y, a.cx - b.cx AS bx, a.cy - b.cy AS by_, -(d.d - ((e.ux * (3 - d.x) + e.uy * (3 - d.y)) * 0.05) / CAST(0.8 AS DOUBLE)) AS d
    FROM disparity d JOIN edges e USING (tile_x, tile_y) JOIN lens a ON a.tile_x = d.tile_x AND a.tile_y = d.tile_y JOIN lens b ON b.tile_x = e.ntile_x AND b.tile_y = e.ntile_y WHERE d.d > 0),
  m AS (SELECT *, sqrt(bx * bx + by_ * by_) AS baseline, x + bx * (d * (sqrt(bx * bx + by_ * by_) / 12) / sqrt(bx * bx + by_ * by_)) AS qx, y + by_ * (d * (sqrt(bx * bx + by_ * by_) / 12) / sqrt(bx * bx + by_ * by_)) AS qy FROM p),
  r AS (SELECT *, CASE WHEN bx * (x - qx) + by_ * (y - qy) >= 0 THEN sqrt(greatest(0, bx * (x - qx) + by_ * (y - qy))) END AS d_real FROM m)
  SELECT tile_x, tile_y, ntile_x, ntile_y, x, y, round(qx, 6) AS qx, round(qy, 6) AS qy, round(d_real, 6) AS d_real, round(baseline, 6) AS baseline, round(baseline / (d_real + 1e-7), 6) AS vd FROM r""", "edges", "disparity"))
def geometric_map(spark, sf):
    """F11 for planes through each valid pixel, read at the tile's centre; with the disparity's sign turned, so that d_real is real."""
    lens = X.lens(spark, sf)
    j = X.disparity(spark, sf).where("d > 0").join(X.edges(spark, sf), TILE).join(lens.select(*TILE, "cx", "cy"), TILE)
    j = j.join(lens.select(F.col("tile_x").alias("ntile_x"), F.col("tile_y").alias("ntile_y"), F.col("cx").alias("ncx"), F.col("cy").alias("ncy")), ["ntile_x", "ntile_y"])
    x, y = F.col("x"), F.col("y")
    d = -C.plane_at(F.col("ux") * 0.05, F.col("uy") * 0.05, F.lit(0.8), F.col("d"), x, y, 3 - x, 3 - y)
    m = C.geometric_map(F.col("cx"), F.col("cy"), F.col("ncx"), F.col("ncy"), x, y, d, B)
    return rounded(j.select(*TILE, "ntile_x", "ntile_y", "x", "y", *[c.alias(k) for k, c in m.items()]), *m)


@register("cycle_error", q(f"SELECT {S}, ntile_x, ntile_y, round(error, 6) AS error FROM err"))
def cycle_error(spark, sf):
    return rounded(errors(spark, sf).select(*SITE, "ntile_x", "ntile_y", "error"), "error")


FILTER = f"""WITH early AS (SELECT {S}, d, cost, CASE WHEN d IS NULL OR d <= 0 THEN 'invalid' WHEN cost < 0 OR cost > 1.8 THEN 'cost' END AS early FROM disparity),
sup AS (SELECT {S}, count(*) AS support, count(*) FILTER (error <= 0.5) AS good FROM err WHERE n_cost BETWEEN 0 AND 1.8 GROUP BY ALL),
st AS (SELECT e.*, CASE WHEN early IS NOT NULL THEN early WHEN coalesce(support, 0) < 2 THEN 'no_support' WHEN good < 2 THEN 'cycle' ELSE 'kept' END AS stage FROM early e LEFT JOIN sup USING ({S})),
kept AS (SELECT * FROM st WHERE stage = 'kept'), ring AS (SELECT {K}, a.d, list_sort(list(b.d) FILTER (b.x <> a.x OR b.y <> a.y)) AS ring {NEAR.format(t='kept', r=1)} GROUP BY ALL),
sp AS (SELECT {S} FROM ring WHERE len(ring) >= 3 AND abs(d - ring[len(ring) // 2 + 1]) > 1),
res AS (SELECT st.*, CASE WHEN sp.x IS NOT NULL THEN 'spike' ELSE stage END AS reason FROM st LEFT JOIN sp USING ({S}))"""


@register("disparity_filter", q(FILTER + f" SELECT {S}, reason FROM res"))
def disparity_filter(spark, sf):
    return R.filter_reasons(X.disparity(spark, sf), X.edges(spark, sf), B).select(*SITE, "reason")


@register("filter_counts", q(FILTER + " SELECT reason, count(*) AS n FROM res GROUP BY 1"))
def filter_counts(spark, sf):
    return R.filter_counts(R.filter_reasons(X.disparity(spark, sf), X.edges(spark, sf), B))


@register("cycle_metrics", q(f"""WITH pe AS (SELECT {S}, avg(error) AS e FROM err GROUP BY ALL) SELECT coalesce(tile_x, -1) AS tile_x, coalesce(tile_y, -1) AS tile_y, count(*) AS n, round(avg(e), 6) AS mean, round(sqrt(avg(e * e)), 6) AS rmse FROM pe GROUP BY GROUPING SETS ((tile_x, tile_y), ())"""))
def cycle_metrics(spark, sf):
    return rounded(R.cycle_metrics(errors(spark, sf)).fillna(-1, ["tile_x", "tile_y"]), "mean", "rmse")


@register("completeness", q(f"""WITH pe AS (SELECT {S}, count(*) AS views, count(*) FILTER (error <= 0.5) AS good FROM err GROUP BY ALL) SELECT tile_x, tile_y, round(count(*) FILTER (good >= 2) / count(*), 6) AS joint, round(count(*) FILTER (good >= 1) / count(*), 6) AS single,
  round(count(*) FILTER (views >= 1) / count(*), 6) AS covered FROM disparity LEFT JOIN pe USING ({S}) GROUP BY 1, 2"""))
def completeness(spark, sf):
    return rounded(R.completeness(errors(spark, sf), X.disparity(spark, sf)), "joint", "single", "covered")


@register("error_map", q(f"""WITH pe AS (SELECT {S}, median(error) AS e FROM err GROUP BY ALL HAVING count(*) >= 2) SELECT tile_x, tile_y, count(*) AS n, round(avg(e), 6) AS mean, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.9), 6) AS p90, count(*) FILTER (e <= 0.5) AS within_ FROM pe WHERE e <= 3 GROUP BY 1, 2"""))
def error_map(spark, sf):
    return rounded(R.error_map(errors(spark, sf)), "mean", "rmse", "p90").withColumnRenamed("within", "within_")


@register("left_right_check", q(f"""WITH v AS (SELECT *, floor(qx + 0.5) AS tx, floor(qy + 0.5) AS ty FROM q WHERE qx BETWEEN 0 AND 7 AND qy BETWEEN 0 AND 7)
  SELECT {K}, count(*) AS agree FROM v a JOIN disparity b ON b.tile_x = a.ntile_x AND b.tile_y = a.ntile_y AND b.x = a.tx AND b.y = a.ty WHERE b.d > 0 AND abs(a.d - b.d) <= 1 GROUP BY ALL HAVING count(*) >= 2"""))
def left_right_check(spark, sf):
    return R.left_right_check(X.disparity(spark, sf), X.edges(spark, sf), B)


@register("photo_residual", q(f"""WITH m AS (SELECT {K}, sum(b.v) / 9 AS m, sqrt(greatest(0, sum(b.v * b.v) / 9 - pow(sum(b.v) / 9, 2))) AS s {NEAR.format(t='pixel', r=1)} GROUP BY ALL HAVING count(*) = 9), g AS (SELECT * FROM m WHERE s > 1e-3)
  SELECT r.tile_x, r.tile_y, r.x, r.y, r.ntile_x, r.ntile_y, round(coalesce(abs((r.v - a.m) / a.s - (r.n_v - b.m) / b.s), abs(r.v - r.n_v) / 255), 5) AS residual FROM r LEFT JOIN g a ON a.tile_x = r.tile_x AND a.tile_y = r.tile_y AND a.x = r.x AND a.y = r.y
  LEFT JOIN g b ON b.tile_x = r.ntile_x AND b.tile_y = r.ntile_y AND b.x = floor(qx + 0.5) AND b.y = floor(qy + 0.5) WHERE n_v IS NOT NULL"""))
def photo_residual(spark, sf):
    return rounded(R.photo_residual(X.disparity(spark, sf), X.pixel(spark, sf), X.edges(spark, sf), B), "residual", places=5)


@register("gradient_buckets", q(f"""WITH pe AS (SELECT {S}, avg(error) AS e FROM err GROUP BY ALL), {MIRROR}, {SOBEL} SELECT CAST(least(50, floor(sobel / 10)) AS BIGINT) AS bucket, count(*) AS n, round(avg(e), 6) AS mean FROM pe JOIN sobel USING ({S}) GROUP BY 1"""))
def gradient_buckets(spark, sf):
    return rounded(R.gradient_buckets(errors(spark, sf), G.sobel(X.pixel(spark, sf))), "mean")


PLACES = f"WITH c AS (SELECT *, round(cost, 9) AS c, row_number() OVER (PARTITION BY {S} ORDER BY round(cost, 9), ntile_y, ntile_x) AS place FROM costs), k AS (SELECT *, max(CASE WHEN place <= 3 THEN c END) OVER (PARTITION BY {S}) AS kth FROM c)"


@register("top_k_cost", q(PLACES + f" SELECT {S}, round(avg(cost) FILTER (place <= 3), 6) AS mean, count(*) FILTER (c <= kth) AS chosen FROM k GROUP BY ALL"))
def top_k_cost(spark, sf):
    return rounded(R.top_k_cost(costs(spark, sf)), "mean")


@register("weighted_cost", q(f"SELECT {S}, round(coalesce(sum(exp(-scale) * cost) / nullif(sum(exp(-scale)), 0), 2), 6) AS cost FROM costs GROUP BY ALL"))
def weighted_cost(spark, sf):
    return rounded(R.weighted_cost(costs(spark, sf), F.exp(-F.col("scale"))), "cost")


@register("blur_cost", sql("SELECT tile_x, tile_y, x, y, round(cost + 0.8 * (1 - exp(-0.007368 * pow(v - 128, 2))), 6) AS cost FROM disparity JOIN pixel USING (tile_x, tile_y, x, y)", "pixel", "disparity"))
def blur_cost(spark, sf):
    j = X.disparity(spark, sf).drop("frame").join(X.pixel(spark, sf), SITE)
    return j.select(*SITE, F.round(R.blur_cost(F.col("cost"), F.col("v"), F.lit(128.0)), 6).alias("cost"))


@register("softmin_view", q(f"""WITH k AS (SELECT *, rank() OVER (PARTITION BY {S} ORDER BY round(scale, 9)) - 1 AS rd, rank() OVER (PARTITION BY {S} ORDER BY round(cost, 9)) - 1 AS rc, count(*) OVER (PARTITION BY {S}) AS n FROM costs),
  s AS (SELECT *, round(exp(-rd / n) * exp(-rc / n), 9) AS s FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY s DESC, ntile_y, ntile_x) AS place FROM s) SELECT {S}, ntile_x, ntile_y, round(s, 6) AS score FROM o WHERE place = 1"""))
def softmin_view(spark, sf):
    return rounded(R.softmin_view(costs(spark, sf)), "score")


@register("best_virtual_depth", q(f"""WITH s AS (SELECT *, (1 - cost) * exp(-pow(d * scale - 0.2, 2) / 8) AS s FROM costs), o AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY round(s, 9) DESC, ntile_y, ntile_x) AS place FROM s) SELECT {S}, round(12 / d, 6) AS vd, round(s, 6) AS score FROM o WHERE place = 1"""))
def best_virtual_depth(spark, sf):
    return rounded(R.best_virtual_depth(costs(spark, sf), B), "vd", "score")


@register("view_draws", q(f"""WITH w AS (SELECT *, exp(-cost * cost / 0.18) * CASE WHEN cost < 0.8 THEN 0.9 ELSE 0.1 END AS w FROM costs), t AS (SELECT *, sum(w) OVER (PARTITION BY {S} ORDER BY ntile_y, ntile_x) / sum(w) OVER (PARTITION BY {S}) AS cdf, w / sum(w) OVER (PARTITION BY {S}) AS share FROM w),
  n AS (SELECT *, CAST(greatest(0, floor(round(cdf, 9) * 15 - ((31 * tile_x + 17 * tile_y + 7 * x + 3 * y) % 97) / CAST(97 AS DOUBLE)) - floor(round(cdf - share, 9) * 15 - ((31 * tile_x + 17 * tile_y + 7 * x + 3 * y) % 97) / CAST(97 AS DOUBLE))) AS BIGINT) AS drawn FROM t)
  SELECT {S}, ntile_x, ntile_y, drawn FROM n WHERE drawn > 0"""))
def view_draws(spark, sf):
    return R.view_draws(costs(spark, sf))


@register("view_bits", sql("SELECT tile_x, tile_y, x, y, i AS view FROM (SELECT tile_x, tile_y, x, y, unnest(list_slice(list_filter(range(0, 32), lambda i : (CAST(v AS BIGINT) >> i) & 1 = 1), 1, 4)) AS i FROM pixel)", "pixel"))
def view_bits(spark, sf):
    """The first four set bits of a view mask; the pixel value is the mask."""
    return X.pixel(spark, sf).select(*SITE, F.explode(bits(F.col("v").cast("long"), 4)).alias("view")).withColumn("view", F.col("view").cast("long"))


@register("cost_predicate", sql("SELECT tile_x, tile_y, x, y, CASE WHEN cost IS NULL OR cost < 0 OR cost > 1.8 THEN 'cost' ELSE 'kept' END AS reason FROM disparity", "disparity"))
def cost_predicate(spark, sf):
    """P06."""
    c = F.col("cost")
    return X.disparity(spark, sf).select(*SITE, F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1.8), "cost").otherwise("kept").alias("reason"))


@register("clamped_cost", sql("SELECT tile_x, tile_y, x, y, round(least(2, greatest(0, cost)), 6) AS cost FROM disparity", "disparity"))
def clamped_cost(spark, sf):
    """P13."""
    return X.disparity(spark, sf).select(*SITE, F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("cost"))), 6).alias("cost"))


@register("warm_seeds", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), m AS (SELECT {K}, a.cost, a.d, count(*) AS n, sqrt(greatest(0, sum(b.d * b.d) / count(*) - pow(sum(b.d) / count(*), 2))) AS s {NEAR.format(t='v', r=1)} GROUP BY ALL)
  SELECT tile_x, tile_y, x, y, round(d, 6) AS d FROM m WHERE cost < 1 AND n >= 4 AND s <= greatest(0.03, 0.12 * d)""", "disparity"))
def warm_seeds(spark, sf):
    """Cheap pixels with three valid neighbours and a small local deviation."""
    d = X.disparity(spark, sf).where("d is not null")
    m = G.window_moments(d, 1, "d").where("n >= 4").join(d.select(*SITE, "d", "cost"), SITE)
    return rounded(m.where("cost < 1").where(F.col("std") <= F.greatest(F.lit(0.03), 0.12 * F.col("d"))).select(*SITE, "d"), "d")
