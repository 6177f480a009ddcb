"""Depth model queries on calibration samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..functions import scalar as C
from ..operators import depthmodel as D
from ..steps import written
from .catalog import register
from .stats import rounded

FIT = """(my - {c0} * ma - {c1} * mb)"""
SUMS = """count(*) AS n, var_pop(gt * vd) AS saa, covar_pop(gt * vd, vd) AS sab, var_pop(vd) AS sbb, covar_pop(gt * vd, gt) AS say, covar_pop(vd, gt) AS sby, avg(gt * vd) AS ma, avg(vd) AS mb, avg(gt) AS my"""


def fit_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, n, c0, c1, my - c0 * ma - c1 * mb AS c2 FROM (SELECT *, CASE WHEN abs(saa * sbb - sab * sab) > 1e-12 * saa * sbb THEN (say * sbb - sby * sab) / (saa * sbb - sab * sab) END AS c0,
  CASE WHEN abs(saa * sbb - sab * sab) > 1e-12 * saa * sbb THEN (sby * saa - say * sab) / (saa * sbb - sab * sab) END AS c1 FROM (SELECT {by}, {SUMS} FROM {source} GROUP BY {by}))"""


SEG = """WITH RECURSIVE cells AS (SELECT k, c, row_number() OVER (ORDER BY k) AS i FROM (SELECT CAST(round(vd / 1e-3) AS BIGINT) AS k, count(*) AS c FROM depth_pair GROUP BY 1)),
walk AS (SELECT i, CAST(0 AS BIGINT) AS seg, k AS a, k AS b, CAST(c AS BIGINT) AS n FROM cells WHERE i = 1 UNION ALL
  SELECT c.i, CASE WHEN cut THEN seg + 1 ELSE seg END, CASE WHEN cut THEN c.k ELSE a END, c.k, CASE WHEN cut THEN c.c ELSE n + c.c END FROM (SELECT w.*, c.i AS j, c.k AS nk, (n >= 16 AND (c.k - a) * 1e-3 >= 0.04 - 1e-9) OR ((c.k - a) * 1e-3 > 0.18 + 1e-9 AND n >= 8) AS cut FROM walk w JOIN cells c ON c.i = w.i + 1) w JOIN cells c ON c.i = w.j),
raw AS (SELECT seg, min(a) AS a, max(b) AS b, max(n) AS n FROM walk GROUP BY seg),
seg0 AS (SELECT CASE WHEN seg = (SELECT max(seg) FROM raw) AND n < 8 AND seg > 0 THEN seg - 1 ELSE seg END AS seg_id, a, b, n FROM raw),
segs AS (SELECT seg_id, min(a) * 1e-3 AS vd_min, max(b) * 1e-3 AS vd_max, CAST(sum(n) AS BIGINT) AS n FROM seg0 GROUP BY 1),
st AS (SELECT seg_id, lo, greatest(hi, lo + 1e-4) AS hi FROM (SELECT seg_id, coalesce((lag(vd_max) OVER (ORDER BY seg_id) + vd_min) / 2, vd_min) AS lo, coalesce((lead(vd_min) OVER (ORDER BY seg_id) + vd_max) / 2, vd_max) AS hi FROM segs)),
loc AS (SELECT d.*, s.seg_id FROM depth_pair d LEFT JOIN st s ON d.vd >= s.lo AND (d.vd < s.hi OR (d.vd <= s.hi AND s.seg_id = (SELECT max(seg_id) FROM st))))"""
ROBUST = f""", f1 AS ({fit_sql("(SELECT * FROM loc WHERE seg_id IS NOT NULL)", "seg_id")}),
res AS (SELECT l.seg_id, l.vd, l.gt, abs(l.gt - (c1 * vd + c2) / (1 - c0 * vd)) AS r FROM loc l JOIN f1 USING (seg_id)), gate AS (SELECT seg_id, greatest(800, 3 * greatest(median(r), 1)) AS gate FROM res GROUP BY 1),
kept AS (SELECT r.* FROM res r JOIN gate USING (seg_id) WHERE r <= gate), f2 AS ({fit_sql("kept", "seg_id")}),
fin AS (SELECT f1.seg_id, f1.n, coalesce(f2.n, 0) AS used, CASE WHEN f2.n >= 3 THEN f2.c0 ELSE f1.c0 END AS c0, CASE WHEN f2.n >= 3 THEN f2.c1 ELSE f1.c1 END AS c1, CASE WHEN f2.n >= 3 THEN f2.c2 ELSE f1.c2 END AS c2 FROM f1 LEFT JOIN f2 USING (seg_id))"""


def seg_sql(rest: str) -> str:
    return sql((SEG + rest).replace("WITH RECURSIVE", "WITH", 1), "depth_pair").replace("WITH ", "WITH RECURSIVE ", 1)


def stitched(spark, sf):
    return written(D.stitched(D.segments(X.depth_pair(spark, sf))))


def located(spark, sf):
    return D.located(X.depth_pair(spark, sf), stitched(spark, sf))


@register("model_fit", sql(f"SELECT g, n, round(c0, 5) AS c0, round(c1, 1) AS c1, round(c2, 0) AS c2 FROM ({fit_sql('(SELECT *, k % 7 AS g FROM depth_pair)', 'g')})", "depth_pair"))
def model_fit(spark, sf):
    f = D.fit(X.depth_pair(spark, sf).withColumn("g", F.col("k") % 7), ["g"])
    return rounded(rounded(rounded(f, "c0", places=5), "c1", places=1), "c2", places=0)


@register("greedy_segments", seg_sql(" SELECT CAST(seg_id AS INT) AS seg_id, round(vd_min, 6) AS vd_min, round(vd_max, 6) AS vd_max, n FROM segs"))
def greedy_segments(spark, sf):
    return rounded(D.segments(X.depth_pair(spark, sf)), "vd_min", "vd_max")


@register("stitched_segments", seg_sql(" SELECT CAST(seg_id AS INT) AS seg_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM st"))
def stitched_segments(spark, sf):
    return rounded(stitched(spark, sf).select("seg_id", "lo", "hi"), "lo", "hi")


@register("segment_lookup", seg_sql(" SELECT k, line, round(vd, 6) AS vd, CAST(seg_id AS INT) AS seg_id FROM loc"))
def segment_lookup(spark, sf):
    return rounded(located(spark, sf).select("k", "line", "vd", "seg_id"), "vd")


@register("robust_segment_fit", seg_sql(ROBUST + " SELECT CAST(seg_id AS INT) AS seg_id, n, used, round((c1 * 4.5 + c2) / (1 - c0 * 4.5) / 100) AS at_45 FROM fin"))
def robust_segment_fit(spark, sf):
    """Coefficients of a narrow segment are nearly collinear, so the query shows the fitted curve at one depth, in hundreds."""
    f = D.robust_fit(located(spark, sf).where("seg_id is not null"), ["seg_id"])
    return f.select("seg_id", "n", "used", F.round(D.predicted(F.lit(4.5), F.col("c0"), F.col("c1"), F.col("c2")) / 100).alias("at_45"))


@register("error_report", sql("""WITH p AS (SELECT CAST(floor((vd - 3.9) / 0.2) AS INT) AS s, gt, (1500 * vd + 2000) / (1 - CAST(0.05 AS DOUBLE) * vd) AS pred FROM depth_pair), q AS (SELECT CASE WHEN s < 6 THEN s END AS seg_id, gt, CASE WHEN s < 6 THEN pred END AS pred FROM p),
  g AS (SELECT seg_id, count(gt - pred) AS n, avg(pow(gt - pred, 2)) AS mse, avg(abs(gt - pred)) AS mae, median(abs(gt - pred)) AS median, count(*) FILTER (pred IS NULL) AS outside, CAST(grouping(seg_id) AS INT) AS total FROM q GROUP BY ROLLUP (seg_id))
  SELECT coalesce(seg_id, -1) AS seg_id, n, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(median, 4) AS median, outside, total FROM g WHERE total = 1 OR seg_id IS NOT NULL""", "depth_pair"))
def error_report(spark, sf):
    d = X.depth_pair(spark, sf)
    s = F.floor((F.col("vd") - 3.9) / 0.2).cast("int")
    d = d.withColumn("seg_id", F.when(s < 6, s)).withColumn("pred", F.when(s < 6, (1500 * F.col("vd") + 2000) / (1 - 0.05 * F.col("vd"))))
    return rounded(D.error_report(d).fillna(-1, ["seg_id"]), "mse", "rmse", "mae", "median", places=4)


@register("unimodal_gate", sql("""WITH b AS (SELECT CAST(k % 50 AS BIGINT) AS g, floor(gt / 2500) AS bin, count(*) AS c FROM depth_pair WHERE vd < 4.3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, bin) AS k FROM b),
  s AS (SELECT g, CAST(sum(c) AS BIGINT) AS n, max(CASE WHEN k = 1 THEN c END) AS best, coalesce(max(CASE WHEN k = 2 THEN c END), 0) AS second FROM r GROUP BY 1)
  SELECT g, n, round(best / n, 6) AS purity, CAST(n >= 12 AND best / n >= 0.58 AND (best - second) / n >= 0.1 AS INT) AS unimodal FROM s""", "depth_pair"))
def unimodal_gate(spark, sf):
    d = X.depth_pair(spark, sf).where("vd < 4.3D").withColumn("g", F.col("k") % 50)
    return rounded(D.unimodal(d, ["g"]), "purity")


@register("unimodal_fit", sql(f"""WITH loc AS (SELECT CAST(k % 50 AS BIGINT) AS seg_id, vd, gt FROM depth_pair WHERE vd < 4.3), b AS (SELECT seg_id, floor(gt / 2500) AS bin, count(*) AS c FROM loc GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY c DESC, bin) AS k FROM b),
  s AS (SELECT seg_id, sum(c) AS n, max(CASE WHEN k = 1 THEN c END) AS best, coalesce(max(CASE WHEN k = 2 THEN c END), 0) AS second FROM rk GROUP BY 1), ok AS (SELECT seg_id FROM s WHERE n >= 12 AND best / n >= 0.58 AND (best - second) / n >= 0.1),
  good AS (SELECT loc.* FROM loc JOIN ok USING (seg_id))""" + ROBUST.replace("(SELECT * FROM loc WHERE seg_id IS NOT NULL)", "good").replace("FROM loc l", "FROM good l") + """ SELECT seg_id AS g, n, used, round((c1 * 4.1 + c2) / (1 - c0 * 4.1) / 100) AS at_41 FROM fin WHERE greatest(used, CASE WHEN used < 3 THEN n ELSE 0 END) >= 8""", "depth_pair"))
def unimodal_fit(spark, sf):
    d = X.depth_pair(spark, sf).where("vd < 4.3D").withColumn("g", F.col("k") % 50)
    f = D.unimodal_fit(d, ["g"])
    return f.select("g", "n", "used", F.round(D.predicted(F.lit(4.1), F.col("c0"), F.col("c1"), F.col("c2")) / 100).alias("at_41"))


@register("triangle_geometry", sql("""WITH c AS (SELECT tile_x, tile_y, max(CASE WHEN x = 0 AND y = 0 THEN v END) AS a, max(CASE WHEN x = 7 AND y = 0 THEN v END) AS b, max(CASE WHEN x = 0 AND y = 7 THEN v END) AS c FROM pixel GROUP BY 1, 2),
  n AS (SELECT *, -7 * (b - a) AS nx, -7 * (c - a) AS ny, CAST(49 AS DOUBLE) AS nz, greatest(49 + pow(b - a, 2), 49 + pow(c - a, 2), 98 + pow(b - c, 2)) AS longest FROM c)
  SELECT tile_x, tile_y, round(sqrt(nx*nx + ny*ny + nz*nz) / 2, 5) AS area, round(sqrt(nx*nx + ny*ny + nz*nz) / longest, 6) AS quality, CAST(nz / sqrt(nx*nx + ny*ny + nz*nz) > 0.996194698 AS INT) AS level FROM n""", "pixel"))
def triangle_geometry(spark, sf):
    """the triangle through three corner values of a tile, and whether it lies level."""

    def at(x, y):
        return F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col("v")))

    t = X.pixel(spark, sf).groupBy("tile_x", "tile_y").agg(at(0, 0).alias("a"), at(7, 0).alias("b"), at(0, 7).alias("c"))
    zero, seven, one = F.lit(0.0), F.lit(7.0), F.lit(1.0)
    corners = [[zero, zero, F.col("a")], [seven, zero, F.col("b")], [zero, seven, F.col("c")]]
    area, quality = C.triangle(corners)
    level = C.similar_normal(C.plane_through(corners)[:3], [zero, zero, one])
    return rounded(rounded(t.select("tile_x", "tile_y", area.alias("area"), quality.alias("quality"), level.cast("int").alias("level")), "quality"), "area", places=5)


@register("stratified_thinning", sql("""WITH t AS (SELECT round(gt, 6) AS gt, CAST(floor(gt / 1000) AS BIGINT) AS grp, CAST(floor((gt - floor(gt / 1000) * 1000) / 100) AS BIGINT) AS sub FROM depth_pair), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp, sub ORDER BY gt) AS INT) AS place FROM t)
  SELECT grp, sub, gt, place FROM r WHERE place <= 10""", "depth_pair"))
def stratified_thinning(spark, sf):
    return rounded(D.thinned(X.depth_pair(spark, sf), "gt").select("grp", "sub", "gt", "place"), "gt")


HASH = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT)"


def hashed(*columns: str):
    return F.conv(F.substring(F.md5(F.concat_ws("-", *columns)), 1, 6), 16, 10).cast("long")


@register("hash_sample", f"SELECT event_id, round(value, 6) AS value FROM events WHERE {HASH} % 100 < 5")
def hash_sample(spark, sf):
    """A repeatable 5 % sample; membership follows from the id alone, so nothing is sorted."""
    return X.table(spark, sf, "events").where(hashed("event_id") % 100 < 5).select("event_id", F.round("value", 6).alias("value"))


@register("jittered_sample", f"SELECT event_id, j, (({HASH} // (j + 1)) * 31 + 17 * j) % 101 - 50 AS dx, (({HASH} // (j + 1)) * 37 + 29 * j) % 101 - 50 AS dy FROM events, range(0, 5) r(j)")
def jittered_sample(spark, sf):
    """Five offsets per seed in a 101 x 101 window, from the seed's hash."""
    e = X.table(spark, sf, "events").select("event_id", hashed("event_id").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("j"))
    part = F.floor(F.col("h") / (F.col("j") + 1))
    return e.select("event_id", "j", ((part * 31 + 17 * F.col("j")) % 101 - 50).alias("dx"), ((part * 37 + 29 * F.col("j")) % 101 - 50).alias("dy"))


@register("cell_sample", sql("""WITH c AS (SELECT k, line, round(vd, 6) AS vd, CAST(floor((vd - 3.9) / 0.1625) AS BIGINT) AS band, k % 6 AS cx, (k // 6) % 6 AS cy FROM depth_pair), r AS (SELECT *, row_number() OVER (PARTITION BY band, cx, cy ORDER BY k, line, vd) AS place FROM c)
  SELECT band, cx, cy, k, line, vd FROM r WHERE place <= 3""", "depth_pair"))
def cell_sample(spark, sf):
    """Three samples of every cell of a 6 x 6 grid and eight virtual-depth bands."""
    from pyspark.sql import Window

    d = X.depth_pair(spark, sf).withColumn("vd", F.round("vd", 6))
    d = d.select("k", "line", "vd", F.floor((F.col("vd") - 3.9) / 0.1625).alias("band"), (F.col("k") % 6).alias("cx"), (F.floor(F.col("k") / 6) % 6).alias("cy"))
    w = Window.partitionBy("band", "cx", "cy").orderBy("k", "line", "vd")
    return d.withColumn("place", F.row_number().over(w)).where("place <= 3").select("band", "cx", "cy", "k", "line", "vd")


@register("lens_geometry", sql("""SELECT tile_x, tile_y, x, y, round(12 / d, 6) AS vd_plain, round(12.0 * 1.5 / (1.5 + d) / d, 6) AS vd_gap, round(1 / (1 / CAST(50.0 AS DOUBLE) - 1 / (60 + 12 / d * 0.3)), 4) AS object, round((1500 * (12 / d) + 2000) / (1 + CAST(0.01 AS DOUBLE) * (12 / d)), 4) AS metric,
  round(1 / (1 / CAST(50.0 AS DOUBLE) - 1 / (1000 * d)), 5) AS image FROM disparity WHERE d > 0""", "disparity"))
def lens_geometry(spark, sf):
    """F04, F06, F07, F08."""
    d = F.col("d")
    vd = C.virtual_depth(d, 12.0)
    return X.disparity(spark, sf).where("d > 0").select(
        "tile_x", "tile_y", "x", "y", F.round(vd, 6).alias("vd_plain"), F.round(C.virtual_depth(d, 12.0, 1.5), 6).alias("vd_gap"), F.round(C.object_depth(vd, 50.0, 60.0, 0.3), 4).alias("object"),
        F.round(C.metric_depth(vd, F.lit(-0.01), F.lit(1500.0), F.lit(2000.0)), 4).alias("metric"), F.round(C.image_distance(1000 * d, 50.0), 5).alias("image"),
    )


@register("thin_lens_sweep", """SELECT p_size, count(*) AS n, round(avg(1 / (1 / CAST(50 AS DOUBLE) - 1 / CAST(100 + 10 * p_size AS DOUBLE)) - 50), 6) AS b, round(avg(10 / (1 / (1 / CAST(50 AS DOUBLE) - 1 / CAST(100 + 10 * p_size AS DOUBLE)) - 50)), 6) AS disparity FROM part GROUP BY 1""")
def thin_lens_sweep(spark, sf):
    """Image distance and disparity over a sweep of object distances, here 100 + 10 p_size."""
    a = (100 + 10 * F.col("p_size")).cast("double")
    b = C.image_distance(a, 50.0) - 50
    return X.table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.round(F.avg(b), 6).alias("b"), F.round(F.avg(10 / b), 6).alias("disparity"))


K9 = [100.0, 0.0, 32.0, 0.0, 110.0, 24.0, 0.0, 0.0, 1.0]
R9 = [0.8, 0.0, 0.6, 0.0, 1.0, 0.0, -0.6, 0.0, 0.8]
T3 = [0.5, -0.25, 4.0]


@register("camera_projection", sql("""WITH p AS (SELECT tile_x, tile_y, x, y, tile_x / 10.0 AS px, tile_y / 10.0 AS py, CAST(d AS DOUBLE) AS pz FROM disparity WHERE d > 0), c AS (SELECT *, px * 0.8 + pz * 0.6 + 0.5 AS cx, py - 0.25 AS cy, px * -0.6 + pz * 0.8 + 4.0 AS cz FROM p)
  SELECT tile_x, tile_y, x, y, round((100 * cx + 32 * cz) / cz, 6) AS u, round((110 * cy + 24 * cz) / cz, 6) AS v, round(cz, 6) AS depth, round(px, 5) AS back_x, round(py, 5) AS back_y, round(pz, 5) AS back_z FROM c""", "disparity"))
def camera_projection(spark, sf):
    """projection of a point and its way back."""
    p = X.disparity(spark, sf).where("d > 0").select("tile_x", "tile_y", "x", "y", (F.col("tile_x") / 10.0).alias("px"), (F.col("tile_y") / 10.0).alias("py"), F.col("d").alias("pz"))
    u, v, z = C.project([F.col("px"), F.col("py"), F.col("pz")], K9, R9, T3)
    p = p.withColumns({"u": u, "v": v, "depth": z})
    back = C.unproject(F.col("u"), F.col("v"), F.col("depth"), K9, R9, T3)
    p = p.withColumns({f"back_{a}": b for a, b in zip("xyz", back, strict=True)})
    return rounded(rounded(p.drop("px", "py", "pz"), "u", "v", "depth"), "back_x", "back_y", "back_z", places=5)


@register("plane_geometry", sql("""WITH c AS (SELECT tile_x, tile_y, max(CASE WHEN x = 0 AND y = 0 THEN v END) AS a, max(CASE WHEN x = 7 AND y = 0 THEN v END) AS b, max(CASE WHEN x = 0 AND y = 7 THEN v END) AS c FROM pixel GROUP BY 1, 2),
  n AS (SELECT *, -7 * (b - a) AS nx, -7 * (c - a) AS ny, CAST(49 AS DOUBLE) AS nz FROM c), u AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS s FROM n)
  SELECT tile_x, tile_y, round(nx / s, 6) AS nx, round(ny / s, 6) AS ny, round(nz / s, 6) AS nz, round(-(nz / s) * a, 5) AS w, round(a + (b - a) * 3 / 7 + (c - a) * 2 / 7, 5) AS at_32, round(1 - 3.0 / 7 - 2.0 / 7, 6) AS w0, round(3.0 / 7, 6) AS w1, round(2.0 / 7, 6) AS w2 FROM u""", "pixel"))
def plane_geometry(spark, sf):
    """the plane through three corner values of a tile, its value at (3, 2), and that place's barycentric weights."""

    def at(x, y):
        return F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col("v")))

    t = X.pixel(spark, sf).groupBy("tile_x", "tile_y").agg(at(0, 0).alias("a"), at(7, 0).alias("b"), at(0, 7).alias("c"))
    zero, seven = F.lit(0.0), F.lit(7.0)
    n = C.plane_through([[zero, zero, F.col("a")], [seven, zero, F.col("b")], [zero, seven, F.col("c")]])
    t = t.withColumns(dict(zip(("nx", "ny", "nz", "w"), n, strict=True)))
    w = C.barycentric(F.lit(3.0), F.lit(2.0), [(zero, zero), (seven, zero), (zero, seven)])
    t = t.select("tile_x", "tile_y", "nx", "ny", "nz", "w", C.plane_at(F.col("nx"), F.col("ny"), F.col("nz"), F.col("a"), zero, zero, F.lit(3.0), F.lit(2.0)).alias("at_32"), *[c.alias(f"w{i}") for i, c in enumerate(w)])
    return rounded(rounded(t, "nx", "ny", "nz", "w0", "w1", "w2"), "w", "at_32", places=5)


@register("small_terms", sql("""SELECT tile_x, tile_y, x, y, round(exp(-cost * cost / 0.18) * (0.5 + exp(-abs(e)) * exp(-abs(e) / 2)), 6) AS prior, least(2.5, greatest(0.0, v / 100 * 0.5)) AS sigma, CAST(abs(v - 128) < 0.01 * v AS INT) AS similar, floor(0.299 * v + 0.587 * (255 - v) + CAST(0.114 AS DOUBLE) * 128 + 0.5) AS gray
  FROM disparity JOIN pixel USING (tile_x, tile_y, x, y)""", "pixel", "disparity"))
def small_terms(spark, sf):
    """F13, F14, F18, P11."""
    j = X.disparity(spark, sf).drop("frame").join(X.pixel(spark, sf), ["tile_x", "tile_y", "x", "y"])
    e, v = F.abs("e"), F.col("v")
    return j.select("tile_x", "tile_y", "x", "y", F.round(C.prior_weight(F.col("cost"), e, e / 2), 6).alias("prior"), C.blur_sigma(v / 100).alias("sigma"), C.similar_depth(v, F.lit(128.0)).cast("int").alias("similar"), C.gray(v, 255 - v, F.lit(128.0)).cast("double").alias("gray"))


@register("hue_depth", sql("SELECT tile_x, tile_y, x, y, CASE WHEN v < 30 THEN 0 WHEN v < 75 THEN 1 WHEN v < 150 THEN 2 WHEN v < 200 THEN 3 WHEN v < 240 THEN 4 ELSE 5 END AS bucket FROM pixel", "pixel"))
def hue_depth(spark, sf):
    """A ladder from a hue to a depth bucket."""
    v, c = F.col("v"), F.lit(5)
    for k, top in reversed(list(enumerate((30, 75, 150, 200, 240)))):
        c = F.when(v < top, k).otherwise(c)
    return X.pixel(spark, sf).select("tile_x", "tile_y", "x", "y", c.alias("bucket"))
