"""Grid tables derived from the given tables, in Spark and as SQL for any other engine.

An embedding of 64 numbers is an 8 x 8 micro-image, its id places it on a grid
25 tiles wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SITE, TILE

BASELINE, ROW_STEP = 12.0, 10.392304845413264


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a pixel.

    Spark judges the size of an exploded table as if each array held one number, and would send tables of pixels
    to the driver and broadcast them; the hint goes with all that is derived from these rows, up to the next join.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).hint("merge")
    i = F.col("i").cast("long")
    return e.select(
        (F.col("vec_id") % 25).alias("tile_x"), F.floor(F.col("vec_id") / 25).alias("tile_y"), (i % 8).alias("x"), F.floor(i / 8).alias("y"), F.col("e").cast("double").alias("e")
    )


def level(e: Column) -> Column:
    """A pixel's gray level."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 256 * e))).cast("double")


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select(F.lit("f0").alias("frame"), *SITE, level(F.col("e")).alias("v"))


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("tile_x"), F.floor(F.col("vec_id") / 25).alias("tile_y"))
    odd = (F.col("tile_y") % 2).cast("double")
    return t.select(
        *TILE,
        (BASELINE * F.col("tile_x") + 6 + 6 * odd).alias("cx"),
        (ROW_STEP * F.col("tile_y") + 6).alias("cy"),
        (60 + 12 * ((7 * F.col("tile_x") + 5 * F.col("tile_y")) % 9)).cast("double").alias("area"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.neighbors import adjacent

    return adjacent(lens(spark, sf_dir), BASELINE)


def disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px(spark, sf_dir)
    X, Y, x, y = (F.col(c) for c in ("tile_x", "tile_y", "x", "y"))
    d = 1.5 + 0.1 * ((31 * X + 17 * Y) % 5) + 0.5 * F.col("e") + F.when((5 * x + 3 * y + X + 7 * Y) % 37 == 0, 1.6).otherwise(0.0)
    return p.select(
        F.lit("f0").alias("frame"), *SITE, F.when((7 * x + 13 * y + 3 * X + 5 * Y) % 11 != 0, d).alias("d"), (1.2 + 2 * F.col("e")).alias("cost"), "e"
    )


def depth_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    vd = 3.9 + 1.3 * ((37 * F.col("l_partkey") + 11 * F.col("l_suppkey") + F.col("l_linenumber")) % 1000) / 1000
    t = t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"), vd.alias("vd"))
    return t.select("k", "line", "vd", ((1500 * F.col("vd") + 2000) / (1 - 0.05 * F.col("vd")) + (13 * F.col("k")) % 201 - 100).alias("gt"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))


def wide_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 x 16 pixels, each of four whole neighbouring ones."""
    X, Y, x, y = (F.col(c) for c in ("tile_x", "tile_y", "x", "y"))
    wide = [F.floor(X / 2).alias("tile_x"), F.floor(Y / 2).alias("tile_y")]
    whole = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("tile_x"), F.floor(F.col("vec_id") / 25).alias("tile_y")).groupBy(*wide).agg(F.count("*").alias("n")).where("n = 4").select(*TILE)
    return pixel(spark, sf_dir).select("frame", *wide, (8 * (X % 2) + x).alias("x"), (8 * (Y % 2) + y).alias("y"), "v").join(whole, TILE, "left_semi")


SQL = {
    "px": """SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(embedding[i] AS DOUBLE) AS e
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
    "pixel": "SELECT 'f0' AS frame, tile_x, tile_y, x, y, floor(least(255.0, greatest(0.0, 128 + 256 * e))) AS v FROM px",
    "wide": """SELECT frame, tile_x // 2 AS tile_x, tile_y // 2 AS tile_y, 8 * (tile_x % 2) + x AS x, 8 * (tile_y % 2) + y AS y, v FROM pixel
  JOIN (SELECT tile_x // 2 AS wx, tile_y // 2 AS wy FROM pixel GROUP BY ALL HAVING count(*) = 256) ON wx = tile_x // 2 AND wy = tile_y // 2""",
    "lens": """SELECT tile_x, tile_y, CAST(12 * tile_x + 6 + 6 * (tile_y % 2) AS DOUBLE) AS cx, CAST(10.392304845413264 AS DOUBLE) * tile_y + 6 AS cy,
  CAST(60 + 12 * ((7 * tile_x + 5 * tile_y) % 9) AS DOUBLE) AS area FROM (SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y FROM embeddings)""",
    "edges": """SELECT a.tile_x, a.tile_y, b.tile_x AS ntile_x, b.tile_y AS ntile_y,
  sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS baseline,
  (a.cx - b.cx) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS ux,
  (a.cy - b.cy) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS uy
  FROM lens a JOIN lens b ON abs(a.tile_x - b.tile_x) <= 1 AND abs(a.tile_y - b.tile_y) <= 1 AND (a.tile_x <> b.tile_x OR a.tile_y <> b.tile_y)
  WHERE abs(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) - 12) < 0.15 * 12""",
    "disparity": """SELECT 'f0' AS frame, tile_x, tile_y, x, y, CASE WHEN (7*x + 13*y + 3*tile_x + 5*tile_y) % 11 <> 0 THEN
  CAST(1.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * ((31*tile_x + 17*tile_y) % 5) + CAST(0.5 AS DOUBLE) * e + CASE WHEN (5*x + 3*y + tile_x + 7*tile_y) % 37 = 0 THEN CAST(1.6 AS DOUBLE) ELSE 0 END END AS d,
  CAST(1.2 AS DOUBLE) + 2 * e AS cost, e FROM px""",
    "depth_pair": """SELECT k, line, vd, (1500 * vd + 2000) / (1 - CAST(0.05 AS DOUBLE) * vd) + (13 * k) % 201 - 100 AS gt FROM
  (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS line, CAST(3.9 AS DOUBLE) + CAST(1.3 AS DOUBLE) * ((37 * l_partkey + 11 * l_suppkey + l_linenumber) % 1000) / 1000 AS vd FROM lineitem)""",
    "val": "SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem",
}
NEEDS = {"pixel": ["px"], "wide": ["px", "pixel"], "edges": ["lens"], "disparity": ["px"]}


def sql(body: str, *names: str) -> str:
    """``body`` with the named tables in front; a body that begins with WITH goes on with its own."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    head = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
