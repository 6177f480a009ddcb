"""Fusion, voxel and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sql
from ..functions import keys as Q
from ..operators import fusion as U
from ..operators import matching as P
from ..schema import SITE, TILE
from .catalog import register
from .grids import K, NEAR
from .stats import rounded

B = X.BASELINE
SPLAT = """splat AS (SELECT d.tile_x, d.tile_y, d.x, d.y, CAST(floor((cx + (x - 3.5) * (12 / d.d)) * 0.5 + 0.5) AS BIGINT) AS vx, CAST(floor((cy + (y - 3.5) * (12 / d.d)) * 0.5 + 0.5) AS BIGINT) AS vy, 12 / d.d AS vd, 1 / (1 + greatest(0.0, cost)) AS score FROM disparity d JOIN lens USING (tile_x, tile_y) WHERE d.d > 0)"""
T = ("lens", "disparity")


def q(body: str) -> str:
    body = body.strip()
    return sql("WITH " + SPLAT + (", " + body[5:] if body.startswith("WITH ") else " " + body), *T)


def splat_of(spark, sf):
    return U.splat(X.disparity(spark, sf), X.lens(spark, sf), B)


@register("splat", q("SELECT vx, vy, tile_x, tile_y, x, y, round(vd, 6) AS vd, round(score, 6) AS score FROM splat"))
def splat(spark, sf):
    return rounded(splat_of(spark, sf).drop("frame", "cx", "cy"), "vd", "score")


@register("splat_median", q("SELECT vx, vy, count(*) AS n, round(median(vd), 6) AS vd FROM splat GROUP BY 1, 2"))
def splat_median(spark, sf):
    return rounded(U.splat_median(splat_of(spark, sf)), "vd")


@register("splat_winner", q("WITH r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy ORDER BY round(score, 9) DESC, tile_y, tile_x, y, x) AS k FROM splat) SELECT vx, vy, tile_x, tile_y, x, y, round(vd, 6) AS vd, round(score, 6) AS score FROM r WHERE k = 1"))
def splat_winner(spark, sf):
    return rounded(U.splat_winner(splat_of(spark, sf)), "vd", "score")


@register("splat_mean", q("WITH m AS (SELECT vx, vy, median(vd) AS m FROM splat GROUP BY 1, 2) SELECT vx, vy, count(*) AS n, round(sum(score * vd) / sum(score), 6) AS vd FROM splat JOIN m USING (vx, vy) WHERE abs(vd - m) <= 1 GROUP BY 1, 2"))
def splat_mean(spark, sf):
    return rounded(U.splat_mean(splat_of(spark, sf)), "vd")


@register("consistent_fusion", q("""WITH t AS (SELECT vx, vy, tile_x, tile_y, avg(vd) AS vd FROM splat GROUP BY ALL), c AS (SELECT *, floor(ln(vd) / ln(CAST(1.05 AS DOUBLE))) AS cell FROM t), s AS (SELECT vx, vy, cell, count(*) AS n, sum(vd) AS s FROM c GROUP BY ALL),
  g AS (SELECT a.vx, a.vy, a.cell, sum(b.n) AS n, sum(b.s) AS s FROM s a JOIN s b ON a.vx = b.vx AND a.vy = b.vy AND abs(a.cell - b.cell) <= 1 GROUP BY ALL HAVING sum(b.n) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy ORDER BY n DESC, cell) AS k FROM g)
  SELECT vx, vy, CAST(n AS BIGINT) AS n, round(s / n, 6) AS vd FROM r WHERE k = 1"""))
def consistent_fusion(spark, sf):
    return rounded(U.consistent(splat_of(spark, sf)), "vd")


@register("voxel_dedupe", q("WITH p AS (SELECT *, CAST(floor(vx / 4.0) AS BIGINT) AS a, CAST(floor(vy / 4.0) AS BIGINT) AS b, CAST(floor(vd / 2) AS BIGINT) AS c FROM splat), r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY tile_y, tile_x, y, x) AS k, count(*) OVER (PARTITION BY a, b, c) AS n FROM p) SELECT a AS voxel_x, b AS voxel_y, c AS voxel_z, n, tile_x, tile_y, x, y, round(vd, 6) AS vd FROM r WHERE k = 1"))
def voxel_dedupe(spark, sf):
    s = splat_of(spark, sf).select(F.col("vx").alias("px"), F.col("vy").alias("py"), (F.col("vd") * 2).alias("pz"), *SITE, "vd")
    v = U.voxels(s, ["px", "py", "pz"], 4.0, ["tile_y", "tile_x", "y", "x"])
    return rounded(v.select(F.col("vpx").alias("voxel_x"), F.col("vpy").alias("voxel_y"), F.col("vpz").alias("voxel_z"), "n", *SITE, "vd"), "vd")


CELLS = "WITH cells AS (SELECT DISTINCT CAST(floor(vx / 4.0) AS BIGINT) AS vx, CAST(floor(vy / 4.0) AS BIGINT) AS vy, CAST(floor(vd / 2) AS BIGINT) AS vz FROM splat)"


def cells(spark, sf):
    return splat_of(spark, sf).select(F.floor(F.col("vx") / 4).alias("vx"), F.floor(F.col("vy") / 4).alias("vy"), F.floor(F.col("vd") / 2).alias("vz")).distinct()


@register("outer_faces", q(CELLS + ", s(dx, dy, dz, face) AS (VALUES (-1,0,0,0),(1,0,0,1),(0,-1,0,2),(0,1,0,3),(0,0,-1,4),(0,0,1,5)) SELECT c.vx, c.vy, c.vz, s.face FROM cells c, s WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.vx = c.vx + dx AND o.vy = c.vy + dy AND o.vz = c.vz + dz)"))
def outer_faces(spark, sf):
    return U.outer_faces(cells(spark, sf))


@register("octree_keys", q(CELLS + " SELECT CAST(l AS INT) AS level, CAST(floor(vx / pow(2, l)) AS BIGINT) AS vx, CAST(floor(vy / pow(2, l)) AS BIGINT) AS vy, CAST(floor(vz / pow(2, l)) AS BIGINT) AS vz, count(*) AS leaves FROM cells, range(0, 5) r(l) GROUP BY ALL"))
def octree_keys(spark, sf):
    return U.octree_keys(cells(spark, sf))


@register("nearest_valid", sql("""WITH s AS (SELECT a.tile_x, a.tile_y, a.x, a.y, b.d, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS q, row_number() OVER (PARTITION BY a.tile_x, a.tile_y, a.x, a.y ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.y - a.y, b.x - a.x) AS k
  FROM disparity a JOIN disparity b ON a.tile_x = b.tile_x AND a.tile_y = b.tile_y AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND b.d IS NOT NULL) SELECT tile_x, tile_y, x, y, round(d, 6) AS nearest, q AS dist2 FROM s WHERE k = 1""", "disparity"))
def nearest_valid(spark, sf):
    return rounded(U.nearest_valid(X.disparity(spark, sf), "d"), "nearest")


@register("inverse_square_mean", sql(f"""WITH p AS (SELECT {K}, b.d, 1.0 / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS w {NEAR.format(t='disparity', r=2)} AND (a.x <> b.x OR a.y <> b.y) AND b.d IS NOT NULL),
  m AS (SELECT tile_x, tile_y, x, y, list_sort(list(d))[count(*) // 2 + 1] AS m FROM p GROUP BY ALL) SELECT tile_x, tile_y, x, y, count(*) AS n, round(sum(w * d) / sum(w), 6) AS mean FROM p JOIN m USING (tile_x, tile_y, x, y) WHERE abs(d - m) <= greatest(0.05, 0.2 * m) GROUP BY ALL""", "disparity"))
def inverse_square_mean(spark, sf):
    return rounded(U.inverse_square_mean(X.disparity(spark, sf), "d"), "mean")


@register("centre_rmse", sql(f"""WITH p AS (SELECT {K}, a.d AS own, b.d {NEAR.format(t='disparity', r=1)} AND (a.x <> b.x OR a.y <> b.y) AND b.d IS NOT NULL)
  SELECT tile_x, tile_y, x, y, count(*) AS n, round(sqrt(greatest(0, avg(d * d) - 2 * coalesce(any_value(own), avg(d)) * avg(d) + pow(coalesce(any_value(own), avg(d)), 2))), 5) AS rmse FROM p GROUP BY ALL""", "disparity"))
def centre_rmse(spark, sf):
    return rounded(U.centre_rmse(X.disparity(spark, sf), "d"), "rmse", places=5)


@register("descriptor_matches", """WITH v AS (SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
  j AS (SELECT a.tile_x, a.tile_y, b.tile_x AS ntile_x, b.tile_y AS ntile_y, round(list_distance(a.vec, b.vec), 6) AS dist FROM v a JOIN v b ON abs(a.tile_x - b.tile_x) <= 2 AND abs(a.tile_y - b.tile_y) <= 1 AND (a.tile_x <> b.tile_x OR a.tile_y <> b.tile_y)),
  r AS (SELECT *, row_number() OVER w AS k, lead(dist) OVER w AS second FROM j WINDOW w AS (PARTITION BY tile_x, tile_y ORDER BY dist, ntile_y, ntile_x)) SELECT tile_x, tile_y, ntile_x, ntile_y, dist, round(dist / second, 5) AS ratio FROM r WHERE k = 1""")
def descriptor_matches(spark, sf):
    v = X.table(spark, sf, "embeddings").select((F.col("vec_id") % 25).alias("tile_x"), F.floor(F.col("vec_id") / 25).alias("tile_y"), F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(U.descriptor_matches(v), "ratio", places=5)


@register("coarse_seeds", sql("""WITH c AS (SELECT tile_x, tile_y, x // 2 AS sx, y // 2 AS sy, median(d) AS d FROM disparity GROUP BY ALL) SELECT f.tile_x, f.tile_y, f.x, f.y, round(c.d, 6) AS d FROM disparity f JOIN c ON c.tile_x = f.tile_x AND c.tile_y = f.tile_y AND c.sx = least(3, f.x // 2) AND c.sy = least(3, f.y // 2)""", "disparity"))
def coarse_seeds(spark, sf):
    d = X.disparity(spark, sf)
    return rounded(U.coarse_seeds(d, U.halved(d)), "d")


@register("relaxation")
def relaxation(spark, sf):
    """No SQL form; a test holds it against its invariants."""
    return rounded(U.relaxed(X.disparity(spark, sf), X.edges(spark, sf), X.pixel(spark, sf), B, rounds=1), "d")


def _shown(state):
    return rounded(P.sites(state, 8), "d", "cost")


@register("wide_centre_rmse", sql("""WITH r AS (SELECT a.tile_x, a.tile_y, a.x, a.y, a.v AS own, count(*) AS n, avg(b.v) AS m1, avg(b.v * b.v) AS m2 FROM wide a JOIN wide b ON b.tile_x = a.tile_x AND b.tile_y = a.tile_y AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND (b.x <> a.x OR b.y <> a.y) GROUP BY ALL)
  SELECT tile_x, tile_y, x, y, n, round(sqrt(greatest(0, m2 - 2 * own * m1 + own * own)), 6) AS rmse FROM r""", "wide"))
def wide_centre_rmse(spark, sf):
    """A42 on tiles of 16 x 16 pixels."""
    return rounded(U.centre_rmse(X.wide_pixel(spark, sf), "v", side=16), "rmse")


@register("plane_relaxation")
def plane_relaxation(spark, sf):
    """I01 to I03 with planes, weighted correlation, drawn views and five perturbed candidates; tests hold it against scalar code and a known scene."""
    return _shown(P.relax(X.pixel(spark, sf), X.edges(spark, sf), P.Settings(unit=B), rounds=2))


@register("plane_two_levels")
def plane_two_levels(spark, sf):
    """The coarser level's planes as seeds of the finer one."""
    return _shown(P.two_levels(X.pixel(spark, sf), X.edges(spark, sf), P.Settings(unit=B), rounds=(1, 1)))


@register("quad_keys", """SELECT vec_id, 5 AS child_lod, (vec_id % 25) * 2 + vec_id % 2 AS child_x, (vec_id // 25) * 2 + (vec_id // 2) % 2 AS child_y, (vec_id % 25) // 2 AS parent_x, (vec_id // 25) // 2 AS parent_y, (vec_id % 25) % 2 + 2 * ((vec_id // 25) % 2) AS quadrant,
  '4_' || (vec_id % 25) || '_' || (vec_id // 25) AS name, CASE WHEN vec_id % 2 = 1 THEN 5.0 ELSE 0.0 END AS box_x, CASE WHEN (vec_id // 2) % 2 = 1 THEN 5.0 ELSE 0.0 END AS box_y FROM embeddings""")
def quad_keys(spark, sf):
    """F01."""
    v = X.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 25).alias("x"), F.floor(F.col("vec_id") / 25).alias("y"), (F.col("vec_id") % 4).cast("long").alias("q"))
    zero, ten = F.lit(0.0), F.lit(10.0)
    v = v.withColumn("c", Q.child(F.lit(4), F.col("x"), F.col("y"), F.col("q"))).withColumn("p", Q.parent(F.lit(4), F.col("x"), F.col("y"))).withColumn("b", Q.child_box(zero, zero, ten, ten, F.col("q")))
    return v.select("vec_id", F.col("c.lod").alias("child_lod"), F.col("c.x").alias("child_x"), F.col("c.y").alias("child_y"), F.col("p.x").alias("parent_x"), F.col("p.y").alias("parent_y"), Q.quadrant(F.col("x"), F.col("y")).alias("quadrant"), Q.tile_name(F.lit(4), F.col("x"), F.col("y")).alias("name"), F.col("b.min_x").alias("box_x"), F.col("b.min_y").alias("box_y"))


@register("hex_steps", sql("""SELECT tile_x, tile_y, ntile_x, ntile_y, CAST(1 AS BIGINT) AS steps, CAST(greatest(abs(tile_y - 7), round(abs(l.cx - (12 * 11 + 12)) / 12 + abs(tile_y - 7) / 2), abs(tile_y - 7)) AS BIGINT) AS to_centre FROM edges JOIN lens l USING (tile_x, tile_y)""", "edges"))
def hex_steps(spark, sf):
    """steps along an edge, and from a lens to lens (11, 7)."""
    e = X.edges(spark, sf).select(*TILE, "ntile_x", "ntile_y", (F.col("ux") * F.col("baseline")).alias("dx"), (F.col("uy") * F.col("baseline")).alias("dy"))
    e = Q.with_hex_steps(e, "dx", "dy", B, "steps").join(X.lens(spark, sf).select(*TILE, (F.col("cx") - (B * 11 + 12)).alias("gx"), (F.col("cy") - (X.ROW_STEP * 7 + 6)).alias("gy")), TILE)
    return Q.with_hex_steps(e, "gx", "gy", B, "to_centre").select(*TILE, "ntile_x", "ntile_y", "steps", "to_centre")


@register("vector_angles", sql("SELECT tile_x, tile_y, ntile_x, ntile_y, round(acos(greatest(-1, least(1, ux))), 6) AS angle FROM edges", "edges"))
def vector_angles(spark, sf):
    """between an edge and the x axis."""
    from ..functions.scalar import angle

    return X.edges(spark, sf).select(*TILE, "ntile_x", "ntile_y", F.round(angle(F.col("ux"), F.col("uy"), F.lit(1.0), F.lit(0.0)), 6).alias("angle"))


@register("bit_masks", sql("SELECT tile_x, tile_y, bit_or(CAST(v AS BIGINT)) AS any_bits, bit_and(CAST(v AS BIGINT)) AS all_bits, sum(bit_count(CAST(v AS BIGINT))) AS set_bits FROM pixel GROUP BY 1, 2", "pixel"))
def bit_masks(spark, sf):
    """Bit sets, their union and intersection."""
    v = F.col("v").cast("long")
    return X.pixel(spark, sf).groupBy(*TILE).agg(F.bit_or(v).alias("any_bits"), F.bit_and(v).alias("all_bits"), F.sum(F.bit_count(v).cast("double")).alias("set_bits"))


@register("split_names", "SELECT s_suppkey, string_split(s_name, '#')[1] AS head, string_split(s_name, '#')[2] AS tail FROM supplier")
def split_names(spark, sf):
    """F16."""
    parts = F.split("s_name", "#")
    return X.table(spark, sf, "supplier").select("s_suppkey", F.try_element_at(parts, F.lit(1)).alias("head"), F.try_element_at(parts, F.lit(2)).alias("tail"))


@register("crop_pixels", sql("SELECT l.tile_x, l.tile_y, p.x AS ox, p.y AS oy, CAST(floor(cx) AS BIGINT) - 4 + p.x AS gx, CAST(floor(cy) AS BIGINT) - 4 + p.y AS gy, p.v FROM lens l JOIN pixel p USING (tile_x, tile_y)", "lens", "pixel"))
def crop_pixels(spark, sf):
    """Slices of a frame around every lens, by an equi-join of generated places with the frame's pixels."""
    lens, p = X.lens(spark, sf), X.pixel(spark, sf)
    gx, gy = (F.floor(c) - 4 for c in ("cx", "cy"))
    frame = p.join(lens, TILE).select(*TILE, (gx + F.col("x")).alias("gx"), (gy + F.col("y")).alias("gy"), "v")
    steps = F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))
    sites = lens.select(*TILE, "cx", "cy", F.explode(steps).alias("ox")).select("*", F.explode(steps).alias("oy")).select(*TILE, "ox", "oy", (gx + F.col("ox")).alias("gx"), (gy + F.col("oy")).alias("gy"))
    return sites.join(frame, [*TILE, "gx", "gy"]).select(*TILE, "ox", "oy", "gx", "gy", "v")


@register("two_level_relaxation")
def two_level_relaxation(spark, sf):
    """No SQL form; a test holds it against its invariants."""
    return rounded(U.two_levels(X.disparity(spark, sf), X.edges(spark, sf), X.pixel(spark, sf), B), "d")
