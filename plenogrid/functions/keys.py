"""Tile keys and hexagonal coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT3 = 1.7320508075688772


def tile_name(lod: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", lod, x, y)


def child(lod: Column, x: Column, y: Column, quadrant: Column) -> Column:
    """the quadrant's tile one level down; quadrant bit 0 moves x, bit 1 moves y."""
    return F.struct((lod + 1).alias("lod"), (F.shiftleft(x, 1) + quadrant.bitwiseAND(1)).alias("x"), (F.shiftleft(y, 1) + F.shiftright(quadrant, 1)).alias("y"))


def parent(lod: Column, x: Column, y: Column) -> Column:
    return F.struct((lod - 1).alias("lod"), F.shiftright(x, 1).alias("x"), F.shiftright(y, 1).alias("y"))


def quadrant(x: Column, y: Column) -> Column:
    return x.bitwiseAND(1) + F.shiftleft(y.bitwiseAND(1), 1)


def child_box(min_x: Column, min_y: Column, max_x: Column, max_y: Column, quadrant: Column) -> Column:
    """the quadrant's half of a box in both directions."""
    mx, my = (min_x + max_x) / 2, (min_y + max_y) / 2
    right, upper = quadrant.bitwiseAND(1) == 1, F.shiftright(quadrant, 1) == 1
    return F.struct(
        F.when(right, mx).otherwise(min_x).alias("min_x"), F.when(upper, my).otherwise(min_y).alias("min_y"),
        F.when(right, max_x).otherwise(mx).alias("max_x"), F.when(upper, max_y).otherwise(my).alias("max_y"),
    )


def half_away(c: Column) -> Column:
    """Rounding with halves away from zero."""
    return F.round(c)


def axial(dx: Column, dy: Column, baseline: float) -> tuple[Column, Column]:
    """fractional axial coordinates of a displacement on a grid of rows ``baseline * sqrt(3) / 2`` apart."""
    r = dy / (baseline * ROOT3 / 2)
    return dx / baseline - r / 2, r


def cube_round(q: Column, r: Column) -> tuple[Column, Column]:
    """the nearest hexagon: round all three cube coordinates, mend the one that moved most."""
    s = -q - r
    a, b, c = half_away(q), half_away(r), half_away(s)
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c - s)
    return F.when((da > db) & (da > dc), -b - c).otherwise(a), F.when((db >= da) & (db > dc), -a - c).otherwise(b)


def hex_distance(q: Column, r: Column) -> Column:
    return F.greatest(F.abs(q), F.abs(r), F.abs(q + r)).cast("long")


def with_hex_steps(df: DataFrame, dx: str, dy: str, baseline: float, name: str) -> DataFrame:
    """the ring number of a displacement as a new column, in steps so that no expression is repeated."""
    q, r = axial(F.col(dx), F.col(dy), baseline)
    df = df.withColumns({"__q": q, "__r": r})
    df = df.withColumns(dict(zip(("__a", "__b"), cube_round(F.col("__q"), F.col("__r")), strict=True)))
    return df.withColumn(name, hex_distance(F.col("__a"), F.col("__b"))).drop("__q", "__r", "__a", "__b")


def bits(mask: Column, most: int = 32, width: int = 32) -> Column:
    """Positions of the set bits, ascending, at most ``most``."""
    return F.slice(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(mask, i) == 1), 1, most)
