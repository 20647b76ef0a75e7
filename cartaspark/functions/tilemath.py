"""Web-mercator tile arithmetic as column expressions (XYZ scheme: y grows southwards)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

MAX_LAT = 85.051129
#: Added before rounding down, and taken off the lower right corner, so that a box that ends on a tile's edge does not cover the next tile.
EDGE, INSET = 1e-14, 1e-11


def tile_x(lon: Column, z: int | Column) -> Column:
    """Column of the tile that holds a longitude (degrees) at zoom z."""
    n = F.shiftleft(F.lit(1).cast("long"), z) if isinstance(z, int) else F.pow(F.lit(2.0), z).cast("long")
    at = F.floor((lon / 360.0 + 0.5 + EDGE) * n)
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, at)).cast("long")


def tile_y(lat: Column, z: int | Column) -> Column:
    """Row of the tile that holds a latitude (degrees) at zoom z."""
    n = F.shiftleft(F.lit(1).cast("long"), z) if isinstance(z, int) else F.pow(F.lit(2.0), z).cast("long")
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))))
    at = F.floor((0.5 - 0.25 * F.ln((1 + s) / (1 - s)) / math.pi + EDGE) * n)
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, at)).cast("long")


def cover(boxes: DataFrame, z: int, west: str = "west", south: str = "south", east: str = "east", north: str = "north") -> DataFrame:
    """One row (all columns of boxes, z, x, y) for every tile that a box touches at zoom z.

    A box whose west is beyond its east crosses the antimeridian and is split there.  The tiles of a
    box come from two sequences, so the plan has no join.
    """
    crossing = F.col(west) > F.col(east)
    clamp = lambda c: F.greatest(F.lit(-180.0), F.least(F.lit(180.0), c))
    spans = F.when(crossing, F.array(F.struct(F.lit(-180.0).alias("w"), F.col(east).alias("e")), F.struct(F.col(west).alias("w"), F.lit(180.0).alias("e")))).otherwise(
        F.array(F.struct(F.col(west).alias("w"), F.col(east).alias("e")))
    )
    boxed = boxes.withColumn("_span", F.explode(spans))
    x0, x1 = tile_x(clamp(F.col("_span.w")), z), tile_x(clamp(F.col("_span.e")) - INSET, z)
    y0, y1 = tile_y(F.col(north), z), tile_y(F.col(south) + INSET, z)
    xs = boxed.withColumn("x", F.explode(F.when(x0 <= x1, F.sequence(x0, x1)).otherwise(F.array(x0))))
    return xs.withColumn("y", F.explode(F.when(y0 <= y1, F.sequence(y0, y1)).otherwise(F.array(y0)))).withColumn("z", F.lit(z)).drop("_span")


def ancestors(tiles: DataFrame, min_zoom: int) -> DataFrame:
    """Distinct (z, x, y) of the tiles and all their ancestors down to min_zoom, in one pass."""
    levels = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("z") - min_zoom)))
    rows = tiles.select("z", "x", "y", levels.alias("_up"))
    # shift counts differ by row, so division by a power of two stands for the shift
    up = F.pow(F.lit(2.0), F.col("_up")).cast("long")
    return rows.select((F.col("z") - F.col("_up")).cast("int").alias("z"), F.floor(F.col("x") / up).cast("long").alias("x"), F.floor(F.col("y") / up).cast("long").alias("y")).distinct()


def parents(tiles: DataFrame) -> DataFrame:
    return tiles.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()


def children(tiles: DataFrame) -> DataFrame:
    """The four children of every tile."""
    four = F.array(*[F.struct((F.col("z") + 1).alias("z"), (2 * F.col("x") + dx).alias("x"), (2 * F.col("y") + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])
    return tiles.select(F.inline(four))


def flip_y(y: Column, z: Column) -> Column:
    """XYZ row to TMS row and back."""
    return F.pow(F.lit(2.0), z).cast("long") - 1 - y


def tile_path(z: Column, x: Column, y: Column, extension: Column) -> Column:
    return F.concat(F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")), F.lit("."), extension)


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Number of a tile along the Hilbert curve of its zoom, after all tiles of the zooms above; null for tiles outside their zoom (0 to 31)."""
    one = F.lit(1).cast("long")
    shift = lambda v, n: F.call_function("shiftleft", v, n)

    def step(s: Column, k: Column) -> Column:
        side = shift(one, k)
        right, low = s["x"].bitwiseAND(side) != 0, s["y"].bitwiseAND(side) != 0
        quarter = F.when(right, F.when(low, 2).otherwise(3)).otherwise(F.when(low, 1).otherwise(0)).cast("long")
        turn = lambda c: F.when(right, side - 1 - c).otherwise(c)
        return F.struct(F.when(low, s["x"]).otherwise(turn(s["y"])).alias("x"), F.when(low, s["y"]).otherwise(turn(s["x"])).alias("y"), (s["d"] + quarter * side * side).alias("d"))

    z, x, y = z.cast("int"), x.cast("long"), y.cast("long")
    levels = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    along = F.aggregate(levels, F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d")), step)["d"]
    above = F.call_function("div", shift(one, 2 * z) - 1, F.lit(3).cast("long"))
    inside = z.between(0, 31) & (x >= 0) & (y >= 0) & (x < shift(one, z)) & (y < shift(one, z))
    return F.when(inside, above + along)
