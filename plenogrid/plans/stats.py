"""Statistics queries: line item prices by return flag, pixels and disparities by tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..operators import stats as S
from ..schema import TILE
from .catalog import register

G = ["g"]

MOMENTS = """SELECT g, n, mean, std, CASE WHEN n >= 3 THEN sqrt(n) * m3 / pow(m2, 1.5) END AS skewness, CASE WHEN n >= 4 THEN n * m4 / (m2 * m2) - 3 END AS kurtosis, lo AS min, hi AS max
  FROM (SELECT v.g, count(*) AS n, any_value(a.mean) AS mean, any_value(a.std) AS std, any_value(a.lo) AS lo, any_value(a.hi) AS hi,
          sum(pow(v.v - a.mean, 2)) AS m2, sum(pow(v.v - a.mean, 3)) AS m3, sum(pow(v.v - a.mean, 4)) AS m4
        FROM val v JOIN (SELECT g, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi FROM val GROUP BY g) a ON v.g = a.g GROUP BY v.g)"""
RANKED = "SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM val"
QUARTILES = """SELECT g, any_value(n) AS n, max(CASE WHEN i = floor((n - 1) * 0.05 + 0.5) THEN v END) AS q05, max(CASE WHEN i = floor((n - 1) * 0.25 + 0.5) THEN v END) AS q25,
  max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN v END) AS q50, max(CASE WHEN i = floor((n - 1) * 0.75 + 0.5) THEN v END) AS q75, max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN v END) AS q95
  FROM ranked GROUP BY g"""
HPLAN = """SELECT g, n, lo, hi, CASE WHEN hi > lo THEN bins ELSE 1 END AS bins, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1.0 END AS width FROM (
  SELECT g, n, lo, hi, least(65536, greatest(64, CAST(ceil((hi - lo) / CASE WHEN q75 > q25 THEN 2 * (q75 - q25) * pow(n, -1/3) WHEN sd > 0 THEN 3.5 * sd * pow(n, -1/3) ELSE (hi - lo) / 256 END) AS BIGINT))) AS bins
  FROM (SELECT q.*, a.lo, a.hi, a.sd FROM quartiles q JOIN (SELECT g, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM val GROUP BY g) a ON q.g = a.g))"""
HIST = "SELECT v.g, CAST(least(bins - 1, greatest(0, floor((v - lo) / width))) AS BIGINT) AS bin, count(*) AS count, any_value(lo) AS lo, any_value(width) AS width, any_value(bins) AS bins FROM val v JOIN hplan p ON v.g = p.g GROUP BY 1, 2"
MODE = """SELECT g, bin, lo + (bin + 0.5 + greatest(-0.5, least(0.5, coalesce(0.5 * (b - a) / nullif(b - 2 * count + a, 0), 0)))) * width AS mode FROM (
  SELECT h.*, coalesce(p.count, 0) AS b, coalesce(q.count, 0) AS a, row_number() OVER (PARTITION BY h.g ORDER BY h.count DESC, h.bin) AS k
  FROM hist h LEFT JOIN hist p ON p.g = h.g AND p.bin = h.bin - 1 LEFT JOIN hist q ON q.g = h.g AND q.bin = h.bin + 1) WHERE k = 1"""
HDIBIN = """SELECT g, lo + bin * width AS hdi_bin_lo, lo + (e + 1) * width AS hdi_bin_hi FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY e - bin, e, bin) AS k FROM (
    SELECT a.g, a.bin, a.lo, a.width, min(b.bin) AS e FROM cums a JOIN cums b ON a.g = b.g AND b.cum >= a.cum - a.count + ceil(a.n * 0.5) GROUP BY 1, 2, 3, 4)) WHERE k = 1"""
CUMS = "SELECT g, bin, lo, width, count, sum(count) OVER (PARTITION BY g ORDER BY bin) AS cum, sum(count) OVER (PARTITION BY g) AS n FROM hist"
HDI = """SELECT g, v AS hdi_lo, v2 AS hdi_hi FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v2 - v, i) AS k FROM (
  SELECT a.g, a.i, a.v, b.v AS v2 FROM ranked a JOIN ranked b ON a.g = b.g AND b.i = a.i + CAST(ceil(a.n * 0.5) AS BIGINT) - 1)) WHERE k = 1"""
CHAIN = f"WITH moments AS ({MOMENTS}), ranked AS ({RANKED}), quartiles AS ({QUARTILES}), hplan AS ({HPLAN}), hist AS ({HIST}), cums AS ({CUMS}), modes AS ({MODE}), hdibin AS ({HDIBIN}), hdi AS ({HDI})\n"


def rounded(df, *names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


@register("distribution_report", sql(CHAIN + """SELECT m.g, m.n, round(mean, 4) AS mean, round(std, 4) AS std, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, min, max, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf,
  q05, q25, q50, q75, q95, p.bins, round(p.width, 8) AS width, round(mode, 4) AS mode, round(hdi_bin_lo, 8) AS hdi_bin_lo, round(hdi_bin_hi, 8) AS hdi_bin_hi, hdi_lo, hdi_hi,
  round(q25 - 1.5 * (q75 - q25), 4) AS fence_lo, round(q75 + 1.5 * (q75 - q25), 4) AS fence_hi
  FROM moments m JOIN quartiles q ON m.g = q.g JOIN hplan p ON p.g = m.g JOIN modes o ON o.g = m.g JOIN hdibin b ON b.g = m.g JOIN hdi h ON h.g = m.g""", "val"))
def distribution_report(spark, sf):
    out = S.report(X.values(spark, sf), G, "v")
    out = rounded(out, "width", "hdi_bin_lo", "hdi_bin_hi", places=8)
    return rounded(out, "mean", "std", "skewness", "kurtosis", "mode", "fence_lo", "fence_hi", places=4)


@register("moments", sql(f"WITH moments AS ({MOMENTS}) SELECT g, n, round(mean, 4) AS mean, round(std, 4) AS std, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, min, max FROM moments", "val"))
def moments(spark, sf):
    return rounded(S.moments(X.values(spark, sf), G, "v").drop("n_nan", "n_inf"), "mean", "std", "skewness", "kurtosis", places=4)


@register("quantile_nearest", sql(f"WITH ranked AS ({RANKED}) SELECT g, max(CASE WHEN i = floor((n - 1) * 0.9 + 0.5) THEN v END) AS q FROM ranked GROUP BY g", "val"))
def quantile_nearest(spark, sf):
    return S.quantile(X.values(spark, sf), G, "v", 0.9, "nearest")


@register("quantile_truncating", sql(f"WITH ranked AS ({RANKED}) SELECT g, max(CASE WHEN i = floor((n - 1) * 0.9) THEN v END) AS q FROM ranked GROUP BY g", "val"))
def quantile_truncating(spark, sf):
    return S.quantile(X.values(spark, sf), G, "v", 0.9, "truncating")


@register("quantile_upper_median", sql(f"WITH ranked AS ({RANKED}) SELECT g, max(CASE WHEN i = n // 2 THEN v END) AS q FROM ranked GROUP BY g", "val"))
def quantile_upper_median(spark, sf):
    return S.quantile(X.values(spark, sf), G, "v", 0.5, "upper_median")


@register("quantile_interpolated", sql("SELECT g, round(quantile_cont(v, 0.1), 4) AS q100, round(quantile_cont(v, 0.5), 4) AS q500, round(quantile_cont(v, 0.9), 4) AS q900 FROM val GROUP BY g", "val"))
def quantile_interpolated(spark, sf):
    return rounded(S.interpolated(X.values(spark, sf), G, "v", 0.1, 0.5, 0.9), "q100", "q500", "q900", places=4)


@register("median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median(spark, sf):
    return S.interpolated(X.table(spark, sf, "events"), ["event_type"], "value", 0.5).select("event_type", F.round("q500", 6).alias("median"))


@register("quantile_streaming", sql("SELECT g, quantile_disc(v, 0.9) AS q FROM val GROUP BY g", "val"))
def quantile_streaming(spark, sf):
    return S.streaming_quantile(X.values(spark, sf), G, "v", 0.9)


@register("histogram", sql(CHAIN + "SELECT g, bin, count FROM hist", "val"))
def histogram(spark, sf):
    return S.histogram(X.values(spark, sf), G, "v").select("g", "bin", "count")


@register("histogram_mode", sql(CHAIN + "SELECT g, bin, round(mode, 4) AS mode FROM modes", "val"))
def histogram_mode(spark, sf):
    return rounded(S.histogram_mode(S.histogram(X.values(spark, sf), G, "v"), G), "mode", places=4)


@register("hdi_histogram", sql(CHAIN + "SELECT g, round(hdi_bin_lo, 8) AS hdi_lo, round(hdi_bin_hi, 8) AS hdi_hi FROM hdibin", "val"))
def hdi_histogram(spark, sf):
    return rounded(S.hdi_histogram(S.histogram(X.values(spark, sf), G, "v"), G, 0.5), "hdi_lo", "hdi_hi", places=8)


@register("hdi_exact", sql(CHAIN + "SELECT * FROM hdi", "val"))
def hdi_exact(spark, sf):
    return S.hdi_exact(X.values(spark, sf), G, "v", 0.5)


@register("hdi_filtered", sql(CHAIN + "SELECT v.g, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max FROM val v JOIN hdi h ON v.g = h.g AND v.v BETWEEN hdi_lo AND hdi_hi GROUP BY v.g", "val"))
def hdi_filtered(spark, sf):
    return rounded(S.hdi_filtered(X.values(spark, sf), G, "v").select("g", "n", "mean", "std", "min", "max"), "mean", "std", places=4)


@register("mad_band", sql("""SELECT tile_x, tile_y, n, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN hi - lo < 1e-4 THEN (lo + hi) / 2 - 5e-5 ELSE lo END, 6) AS lo, round(CASE WHEN hi - lo < 1e-4 THEN (lo + hi) / 2 + 5e-5 ELSE hi END, 6) AS hi FROM (
  SELECT *, CASE WHEN n < 8 THEN least_v ELSE median - 3 * 1.4826 * mad END AS lo, CASE WHEN n < 8 THEN most_v ELSE median + 3 * 1.4826 * mad END AS hi FROM (
  SELECT tile_x, tile_y, count(d) AS n, median(d) AS median, mad(d) AS mad, min(d) AS least_v, max(d) AS most_v FROM disparity WHERE d IS NOT NULL GROUP BY 1, 2))""", "disparity"))
def mad_band(spark, sf):
    return rounded(S.mad_band(X.disparity(spark, sf), TILE, "d"), "median", "mad", "lo", "hi")


KDE = """kp AS (SELECT g, n, lo, hi, CASE WHEN h > 0 THEN h ELSE 1e-3 END AS h FROM (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, 1.06 * stddev_samp(v) * pow(count(*), -0.2) AS h FROM val GROUP BY g)),
kd AS (SELECT v.g, k, lo + k * (hi - lo) / 63 AS x, sum(exp(-0.5 * pow((lo + k * (hi - lo) / 63 - v) / h, 2))) / (any_value(n) * any_value(h) * 2.5066282746310002) AS density
  FROM val v JOIN kp p ON v.g = p.g, range(0, 64) r(k) GROUP BY 1, 2, 3)"""


@register("kde", sql("WITH " + KDE + " SELECT g, k, round(x, 4) AS x, round(density * 1e6, 4) AS density FROM kd", "val"))
def kde(spark, sf):
    return S.kde(X.values(spark, sf), G, "v").select("g", "k", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density"))


@register("kde_interval", sql("WITH " + KDE + """, o AS (SELECT *, sum(density) OVER (PARTITION BY g ORDER BY density DESC, k) - density AS before, sum(density) OVER (PARTITION BY g) AS total FROM kd)
  SELECT g, round(max(CASE WHEN before = 0 THEN x END), 4) AS mode, round(min(CASE WHEN before < 0.85 * total THEN x END), 4) AS lo, round(max(CASE WHEN before < 0.85 * total THEN x END), 4) AS hi FROM o GROUP BY g""", "val"))
def kde_interval(spark, sf):
    return rounded(S.kde_interval(X.values(spark, sf), G, "v"), "mode", "lo", "hi", places=4)


@register("fixed_bin_mode", sql("""SELECT tile_x, tile_y, bin, count, round(bin * 0.01, 6) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY count DESC, bin) AS k FROM (
  SELECT tile_x, tile_y, CAST(floor((d - 0.0) / CAST(0.01 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS count FROM disparity WHERE d BETWEEN 0 AND 4 GROUP BY 1, 2, 3)) WHERE k = 1""", "disparity"))
def fixed_bin_mode(spark, sf):
    return rounded(S.fixed_bin_mode(X.disparity(spark, sf), TILE, "d"), "mode")


@register("otsu", sql("""WITH h AS (SELECT tile_x, tile_y, CAST(v AS BIGINT) AS t, count(*) AS c FROM pixel GROUP BY 1, 2, 3),
c AS (SELECT *, sum(c) OVER w AS n0, sum(c * t) OVER w AS s0, sum(c) OVER e AS n, sum(c * t) OVER e AS s FROM h WINDOW w AS (PARTITION BY tile_x, tile_y ORDER BY t), e AS (PARTITION BY tile_x, tile_y)),
b AS (SELECT tile_x, tile_y, t, round(coalesce((n0 / n) * (1 - n0 / n) * pow(s0 / n0 - (s - s0) / nullif(n - n0, 0), 2), 0), 6) AS between_ FROM c)
SELECT tile_x, tile_y, t AS threshold, between_ AS between FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY between_ DESC, t) AS k FROM b) WHERE k = 1""", "pixel"))
def otsu(spark, sf):
    return S.otsu(X.pixel(spark, sf), TILE, "v")


NORMAL = "SELECT tile_x, tile_y, x, y, round(coalesce((v - {lo}) / nullif({hi} - {lo}, 0), 0), 6) AS normal FROM (SELECT *, min(v) OVER (PARTITION BY tile_x, tile_y) AS a, max(v) OVER (PARTITION BY tile_x, tile_y) AS b FROM pixel)"


@register("min_max_normal", sql(NORMAL.format(lo="a", hi="b"), "pixel"))
def min_max_normal(spark, sf):
    return rounded(S.min_max(X.pixel(spark, sf), TILE, "v").drop("frame", "v"), "normal")


@register("min_max_seeded", sql(NORMAL.format(lo="least(0, a)", hi="greatest(0, b)"), "pixel"))
def min_max_seeded(spark, sf):
    return rounded(S.min_max(X.pixel(spark, sf), TILE, "v", seeded=True).drop("frame", "v"), "normal")


@register("binned_quantiles", sql("""WITH b AS (SELECT tile_x, tile_y, floor(d / 0.5) AS bin, count(*) AS c FROM disparity WHERE d IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT *, sum(c) OVER (PARTITION BY tile_x, tile_y ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY tile_x, tile_y) AS n FROM b)
SELECT tile_x, tile_y, (min(CASE WHEN cum >= ceil(n * 0.5) THEN bin END) + 0.5) * 0.5 AS p50, (min(CASE WHEN cum >= ceil(n * 0.9) THEN bin END) + 0.5) * 0.5 AS p90 FROM w GROUP BY 1, 2""", "disparity"))
def binned_quantiles(spark, sf):
    return S.binned_quantiles(X.disparity(spark, sf), TILE, "d", 0.5, 0.9)


@register("patch_stats", sql("SELECT tile_x, tile_y, count(d) AS n, round(median(d), 6) AS median, round(mad(d), 6) AS mad, round(quantile_cont(d, 0.9) - quantile_cont(d, 0.1), 6) AS span FROM disparity WHERE d IS NOT NULL GROUP BY 1, 2 HAVING count(d) >= 8", "disparity"))
def patch_stats(spark, sf):
    return rounded(S.patch_stats(X.disparity(spark, sf), TILE, "d"), "median", "mad", "span")


@register("statistics_library", """SELECT l_returnflag AS g, round(covar_pop(v, u), 3) AS covariance, round(corr(v, u), 6) AS correlation, round(median(v) + 5.2 * mad(v), 3) AS x84,
  round(quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 3) AS quartile_limit, round(20 * log10(avg(v) / stddev_pop(v)), 6) AS snr FROM (SELECT l_returnflag, l_extendedprice AS v, l_quantity AS u FROM lineitem) GROUP BY 1""")
def statistics_library(spark, sf):
    t = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("u"))
    return rounded(rounded(S.library(t, G, "v", "u"), "covariance", "x84", "quartile_limit", places=3), "correlation", "snr")


@register("signal_measures", """SELECT l_returnflag AS g, count(*) AS n, round(10 * log10(sum(v * v) / sum((v - u) * (v - u))), 6) AS snr, round(10 * log10(pow(greatest(0, max(v), max(u)), 2) / (sum((v - u) * (v - u)) / count(*))), 6) AS psnr,
  round(pow(4 / (3.0 * count(*)), 0.2) * stddev_pop(v), 4) AS bandwidth FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS u FROM lineitem) GROUP BY 1""")
def signal_measures(spark, sf):
    """The discounted price as a noisy copy of the price."""
    t = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("u"))
    return rounded(rounded(S.signal_measures(t, G, "v", "u"), "snr", "psnr"), "bandwidth", places=4)


@register("frame_extremes", sql("SELECT frame, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(min(12 / d), 6) AS min_vd, round(max(12 / d), 6) AS max_vd FROM disparity WHERE d > 0 GROUP BY frame", "disparity"))
def frame_extremes(spark, sf):
    """A51."""
    d = X.disparity(spark, sf).where("d > 0")
    vd = X.BASELINE / F.col("d")
    return rounded(d.groupBy("frame").agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.min(vd).alias("min_vd"), F.max(vd).alias("max_vd")), "min_d", "max_d", "min_vd", "max_vd")
