"""Texture queries; what has no SQL form is held against plain numpy in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..operators import grid as G
from ..operators import texture as T
from .catalog import register
from .stats import rounded


@register("high_frequency")
def high_frequency(spark, sf):
    return rounded(T.high_frequency(X.pixel(spark, sf)), "high_frequency")


@register("gabor")
def gabor(spark, sf):
    return rounded(T.gabor(X.pixel(spark, sf)), "gabor")


@register("binary_patterns")
def binary_patterns(spark, sf):
    return rounded(T.binary_patterns(X.pixel(spark, sf)), "pattern")


@register("orientation_entropy")
def orientation_entropy(spark, sf):
    return rounded(T.orientation_entropy(X.pixel(spark, sf)), "entropy")


@register("tamura")
def tamura(spark, sf):
    return rounded(T.tamura(X.pixel(spark, sf)), "contrast", "direction_variance")


@register("sobel_windows")
def sobel_windows(spark, sf):
    return rounded(T.sobel_windows(X.pixel(spark, sf)), "richness")


@register("gabor_windows")
def gabor_windows(spark, sf):
    return rounded(T.gabor_windows(X.pixel(spark, sf)), "response")


@register("circular_codes")
def circular_codes(spark, sf):
    return rounded(T.circular_codes(X.pixel(spark, sf)), "code")


@register("blur_levels")
def blur_levels(spark, sf):
    blur = G.smd2(X.pixel(spark, sf)).groupBy("tile_x", "tile_y").agg(F.avg("smd2").alias("blur"))
    return rounded(T.blur_levels(blur, "blur"), "blur")


_SEEN = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * ({1} - 1) - ({0}) ELSE {0} END"


@register("direction_windows", sql(f"""WITH g AS (SELECT 8 * tile_x + x AS x, 8 * tile_y + y AS y, v FROM pixel), n AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM g),
  b AS MATERIALIZED (SELECT x, y, {_SEEN.format("x + 1", "w")} AS xr, {_SEEN.format("x - 1", "w")} AS xl, {_SEEN.format("y + 1", "h")} AS yd, {_SEEN.format("y - 1", "h")} AS yu FROM g, n),
  d AS MATERIALIZED (SELECT b.x, b.y, r.v - l.v AS gx, u.v - o.v AS gy FROM b JOIN g r ON r.x = b.xr AND r.y = b.y JOIN g l ON l.x = b.xl AND l.y = b.y JOIN g u ON u.x = b.x AND u.y = b.yd JOIN g o ON o.x = b.x AND o.y = b.yu),
  a AS (SELECT x, y, sqrt(gx * gx + gy * gy) AS m, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() WHEN atan2(gy, gx) >= pi() THEN atan2(gy, gx) - pi() ELSE atan2(gy, gx) END / pi() * 6 - 0.5 AS t FROM d),
  s AS (SELECT x // 4 AS cx, y // 4 AS cy, CAST(floor(t) + 6 AS BIGINT) % 6 AS b, m * (1 - t + floor(t)) AS v FROM a UNION ALL SELECT x // 4, y // 4, CAST(floor(t) + 7 AS BIGINT) % 6, m * (t - floor(t)) FROM a),
  c AS (SELECT cx, cy, b, sum(v) AS v FROM (SELECT * FROM s UNION ALL SELECT cx, cy, b, 0 FROM (SELECT DISTINCT cx, cy FROM s), range(6) q(b)) GROUP BY 1, 2, 3),
  k AS (SELECT cx - i AS bx, cy - j AS b_y, list(v) AS v FROM c, range(4) p(i), range(4) q(j) GROUP BY 1, 2 HAVING count(*) = 96),
  k1 AS (SELECT bx, b_y, list_transform(v, lambda e : least(e / s, 0.2)) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda f : f * f))) + 9.6 AS s FROM k)),
  k2 AS (SELECT bx, b_y, list_transform(v, lambda e : e / s) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda f : f * f))) + 0.001 AS s FROM k1)),
  e AS (SELECT bx, b_y, list_sum(list_transform(v, lambda p : CASE WHEN p > 1e-6 THEN -p * ln(p) ELSE 0 END)) AS e FROM k2),
  w AS (SELECT bx - i AS wx, b_y - j AS wy, sum(e) AS entropy FROM e, range(5) p(i), range(5) q(j) GROUP BY 1, 2 HAVING count(*) = 25)
  SELECT 4 * wx AS x, 4 * wy AS y, round(entropy, 5) AS entropy, round((entropy - min(entropy) OVER ()) * 255 / (max(entropy) OVER () - min(entropy) OVER ()), 4) AS richness FROM w""", "pixel"))
def direction_windows(spark, sf):
    """W12 over the borders of tiles."""
    g = X.pixel(spark, sf).select("frame", (8 * F.col("tile_x") + F.col("x")).alias("x"), (8 * F.col("tile_y") + F.col("y")).alias("y"), "v")
    return rounded(rounded(T.direction_windows(g).drop("frame"), "entropy", places=5), "richness", places=4)
