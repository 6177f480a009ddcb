"""Window queries on the pixel and disparity grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..operators import grid as G
from ..operators import stats as S
from ..schema import SITE
from .catalog import register
from .stats import rounded

NEAR = """FROM {t} a JOIN {t} b ON a.tile_x = b.tile_x AND a.tile_y = b.tile_y AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r}"""
K = "a.tile_x, a.tile_y, a.x, a.y"
#: Nine samples around each pixel, mirrored at the border.
MIRROR = """samples AS (SELECT a.tile_x, a.tile_y, a.x, a.y, dx, dy, b.v FROM pixel a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), pixel b
  WHERE b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND b.x = CASE WHEN abs(a.x + dx) > 7 THEN 14 - abs(a.x + dx) ELSE abs(a.x + dx) END AND b.y = CASE WHEN abs(a.y + dy) > 7 THEN 14 - abs(a.y + dy) ELSE abs(a.y + dy) END)"""
SOBEL = """grad AS (SELECT tile_x, tile_y, x, y, sum(dx * (2 - abs(dy)) * v) AS gx, sum(dy * (2 - abs(dx)) * v) AS gy FROM samples GROUP BY ALL),
sobel AS (SELECT *, sqrt(gx * gx + gy * gy) AS sobel FROM grad)"""
MOMENT = f"SELECT {K}, count(b.v) AS n, sum(b.v) / count(b.v) AS mean, sqrt(greatest(0, sum(b.v * b.v) / count(b.v) - pow(sum(b.v) / count(b.v), 2))) AS std " + NEAR


@register("smd2", sql("""SELECT a.tile_x, a.tile_y, a.x, a.y, coalesce(abs(a.v - d.v) * abs(a.v - r.v), 0) AS smd2 FROM pixel a
  LEFT JOIN pixel d ON d.tile_x = a.tile_x AND d.tile_y = a.tile_y AND d.x = a.x AND d.y = a.y + 1 LEFT JOIN pixel r ON r.tile_x = a.tile_x AND r.tile_y = a.tile_y AND r.y = a.y AND r.x = a.x + 1""", "pixel"))
def smd2(spark, sf):
    return G.smd2(X.pixel(spark, sf))


@register("sobel", sql(f"WITH {MIRROR}, {SOBEL} SELECT tile_x, tile_y, x, y, gx, gy, round(sobel, 6) AS sobel FROM sobel", "pixel"))
def sobel(spark, sf):
    return rounded(G.sobel(X.pixel(spark, sf)), "sobel")


@register("sobel_tile_mean", sql(f"WITH {MIRROR}, {SOBEL} SELECT tile_x, tile_y, round(avg(sobel), 6) AS mean FROM sobel GROUP BY 1, 2", "pixel"))
def sobel_tile_mean(spark, sf):
    return G.sobel(X.pixel(spark, sf)).groupBy("tile_x", "tile_y").agg(F.round(F.avg("sobel"), 6).alias("mean"))


@register("laplacian", sql(f"WITH {MIRROR} SELECT tile_x, tile_y, x, y, sum(v * CASE WHEN dx = 0 AND dy = 0 THEN -4 WHEN dx = 0 OR dy = 0 THEN 1 ELSE 0 END) AS laplacian FROM samples GROUP BY ALL", "pixel"))
def laplacian(spark, sf):
    return G.laplacian(X.pixel(spark, sf))


@register("patch_moments", sql(f"SELECT tile_x, tile_y, x, y, n, round(mean, 6) AS mean, round(std, 6) AS std FROM ({MOMENT.format(t='pixel', r=1)} GROUP BY ALL) WHERE std > 1e-3", "pixel"))
def patch_moments(spark, sf):
    return rounded(G.window_moments(X.pixel(spark, sf), 1).where("std > 1e-3"), "mean", "std")


@register("texture_mask", sql(f"WITH {MIRROR}, {SOBEL}, m AS ({MOMENT.format(t='pixel', r=3)} GROUP BY ALL) SELECT s.tile_x, s.tile_y, s.x, s.y, CAST(sobel > 8 AND std * std > 60 AS INT) AS textured FROM sobel s JOIN m USING (tile_x, tile_y, x, y)", "pixel"))
def texture_mask(spark, sf):
    return G.texture_mask(X.pixel(spark, sf))


@register("glcm_contrast", sql("""SELECT a.tile_x, a.tile_y, round(avg(pow(floor(a.v * 8 / 256) - floor(b.v * 8 / 256), 2)), 6) AS contrast, count(*) AS n FROM pixel a JOIN pixel b
  ON b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND b.x = a.x + 1 AND b.y = a.y + 1 GROUP BY 1, 2""", "pixel"))
def glcm_contrast(spark, sf):
    return rounded(G.glcm_contrast(X.pixel(spark, sf)), "contrast")


@register("haar_diagonal", sql("SELECT tile_x, tile_y, x // 2 AS bx, y // 2 AS by, sum(CASE WHEN (x + y) % 2 = 0 THEN v ELSE -v END) / 2 AS detail FROM pixel GROUP BY ALL", "pixel"))
def haar_diagonal(spark, sf):
    return G.haar_diagonal(X.pixel(spark, sf))


@register("spike_filter", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), r AS (SELECT {K}, a.d, list_sort(list(b.d) FILTER (b.x <> a.x OR b.y <> a.y)) AS ring {NEAR.format(t='v', r=1)} GROUP BY ALL)
  SELECT tile_x, tile_y, x, y, round(d, 6) AS d, coalesce(len(ring), 0) AS n, CAST(coalesce(len(ring) >= 3 AND abs(d - ring[len(ring) // 2 + 1]) > 1, false) AS INT) AS spike FROM r""", "disparity"))
def spike_filter(spark, sf):
    return rounded(G.spikes(X.disparity(spark, sf)), "d").withColumn("n", F.col("n").cast("long"))


@register("checkerboard_median", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), o(dx, dy) AS (VALUES {', '.join(map(str, G.DIAMOND))})
  SELECT {K}, round(median(b.d), 6) AS filtered, count(*) AS n FROM v a, o, v b WHERE b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL""", "disparity"))
def checkerboard_median(spark, sf):
    return rounded(G.checkerboard_median(X.disparity(spark, sf)), "filtered").withColumn("n", F.col("n").cast("long"))


@register("local_outliers", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), m AS (SELECT {K}, abs(a.d - median(b.d)) AS dev {NEAR.format(t='v', r=2)} GROUP BY a.tile_x, a.tile_y, a.x, a.y, a.d)
  SELECT {K}, CAST(a.dev > 3 * (median(b.dev) + 1e-9) AS INT) AS outlier {NEAR.format(t='m', r=2)} GROUP BY a.tile_x, a.tile_y, a.x, a.y, a.dev""", "disparity"))
def local_outliers(spark, sf):
    return G.local_outliers(X.disparity(spark, sf))


@register("adaptive_rmse", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), r AS (SELECT {K}, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS ring, count(*) AS n, sum(pow(b.d - a.d, 2)) AS sq {NEAR.format(t='v', r=3)} AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL),
  c AS (SELECT tile_x, tile_y, x, y, ring, sum(n) OVER w AS n, sum(sq) OVER w AS sq FROM r WINDOW w AS (PARTITION BY tile_x, tile_y, x, y ORDER BY ring)), f AS (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y, x, y ORDER BY ring) AS k FROM c WHERE n >= 4)
  SELECT tile_x, tile_y, x, y, ring, CAST(n AS BIGINT) AS n, round(sqrt(sq / n), 6) AS rmse, CAST(sqrt(sq / n) < 0.5 AS INT) AS kept FROM f WHERE k = 1""", "disparity"))
def adaptive_rmse(spark, sf):
    return rounded(G.adaptive_rmse(X.disparity(spark, sf), "d", limit=0.5), "rmse")


@register("local_consistency", sql(f"""WITH v AS (SELECT * FROM disparity WHERE d IS NOT NULL), p AS (SELECT {K}, abs(b.d - a.d) AS diff, greatest(CAST(0.3 AS DOUBLE), 0.005 * abs(a.d)) AS tol {NEAR.format(t='v', r=1)} AND (a.x <> b.x OR a.y <> b.y))
  SELECT tile_x, tile_y, x, y, count(*) AS n, CAST(count(*) >= 4 AND count(*) FILTER (diff <= tol) >= 0.5 * count(*) AND avg(diff) <= 1.2 * any_value(tol) AND max(diff) <= 3 * any_value(tol) AS INT) AS consistent FROM p GROUP BY ALL""", "disparity"))
def local_consistency(spark, sf):
    return G.locally_consistent(X.disparity(spark, sf))


@register("hole_filling", sql("""SELECT a.tile_x, a.tile_y, a.x, a.y, round(coalesce(a.d, l.d, r.d, u.d, w.d), 6) AS d FROM disparity a
  LEFT JOIN disparity l ON l.tile_x = a.tile_x AND l.tile_y = a.tile_y AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN disparity r ON r.tile_x = a.tile_x AND r.tile_y = a.tile_y AND r.y = a.y AND r.x = a.x + 1
  LEFT JOIN disparity u ON u.tile_x = a.tile_x AND u.tile_y = a.tile_y AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN disparity w ON w.tile_x = a.tile_x AND w.tile_y = a.tile_y AND w.x = a.x AND w.y = a.y + 1""", "disparity"))
def hole_filling(spark, sf):
    return rounded(G.fill_holes(X.disparity(spark, sf)), "d")


@register("valid_samples", sql("SELECT tile_x, tile_y, x, y, round(d, 6) AS d FROM disparity WHERE d > 0 AND isfinite(d)", "disparity"))
def valid_samples(spark, sf):
    """P01."""
    d = F.col("d")
    return rounded(X.disparity(spark, sf).where(~F.isnan(d) & (d > 0) & (d < float("inf"))).select(*SITE, "d"), "d")


@register("band_filter", sql("SELECT tile_x, tile_y, x, y, round(d, 6) AS d FROM disparity WHERE d BETWEEN 1.45 AND 1.95", "disparity"))
def band_filter(spark, sf):
    """P02."""
    return rounded(X.disparity(spark, sf).where("d between 1.45D and 1.95D").select(*SITE, "d"), "d")


@register("binarise", sql("SELECT tile_x, tile_y, x, y, CASE WHEN v > 128 THEN 255 ELSE 0 END AS b FROM pixel", "pixel"))
def binarise(spark, sf):
    """P08; the threshold of 10 suits blur scores, pixels are cut at 128."""
    return X.pixel(spark, sf).select(*SITE, F.when(F.col("v") > 128, 255).otherwise(0).alias("b"))


@register("bright_count", sql("SELECT tile_x, tile_y, count(*) FILTER (v > 200) AS bright FROM pixel GROUP BY 1, 2", "pixel"))
def bright_count(spark, sf):
    """Pixels of a tile that a binarised map marks."""
    return X.pixel(spark, sf).groupBy("tile_x", "tile_y").agg(F.count_if(F.col("v") > 200).alias("bright"))


@register("visual_stretch", sql("""WITH q AS (SELECT quantile_cont(d, 0.02) AS a, quantile_cont(d, 0.98) AS b FROM disparity)
  SELECT tile_x, tile_y, x, y, round(255 * pow(1 - (least(b, greatest(a, d)) - a) / (b - a), 0.9), 4) AS shown FROM disparity, q WHERE d IS NOT NULL""", "disparity"))
def visual_stretch(spark, sf):
    """Clamp to two quantiles, invert, gamma 0.9, scale to 255."""
    d = X.disparity(spark, sf).where("d is not null")
    q = S.interpolated(d, [], "d", 0.02, 0.98).select(F.col("q20").alias("a"), F.col("q980").alias("b"))
    j = d.crossJoin(F.broadcast(q))  # one row
    part = (F.least("b", F.greatest("a", "d")) - F.col("a")) / (F.col("b") - F.col("a"))
    return j.select(*SITE, F.round(255 * F.pow(1 - part, F.lit(0.9)), 4).alias("shown"))
