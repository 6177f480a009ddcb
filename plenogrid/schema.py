"""Schemas of the grid tables, and sentinels turned into nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENS = "tile_x bigint, tile_y bigint, cx double, cy double, area double, blur_type int, blur_radius double, abandoned boolean"
PIXEL = "frame string, tile_x bigint, tile_y bigint, x bigint, y bigint, v double"
DISPARITY = "frame string, tile_x bigint, tile_y bigint, x bigint, y bigint, d double, cost double, views array<int>"
NEIGHBOR = "tile_x bigint, tile_y bigint, ntile_x bigint, ntile_y bigint, ring int, baseline double, similarity double, score double, rank int"
SPLAT = "frame string, vx bigint, vy bigint, tile_x bigint, tile_y bigint, x bigint, y bigint, vd double, score double"
DEPTH_PAIR = "x bigint, y bigint, vd double, gt double"
SEGMENT_MODEL = "seg_id int, vd_min double, vd_max double, n bigint, c0 double, c1 double, c2 double"

TILE = ["tile_x", "tile_y"]
SITE = [*TILE, "x", "y"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def normalise(df: DataFrame, column: str, *sentinels: float, positive: bool = False) -> DataFrame:
    """Null for NaN, infinities, the given sentinels and, asked for, values of zero or less."""
    c = F.col(column)
    ok = finite(c)
    for s in sentinels:
        ok &= c != s
    if positive:
        ok &= c > 0
    return df.withColumn(column, F.when(ok, c))
