"""Map grids: lattices of round coordinates, their unit segments, and what of them lies on a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import inside
from ..functions.scalar import between_multiples
from .polygons import buffered, spread
from .sheets import transform_points


def lattice(boxes: DataFrame, step: int) -> DataFrame:
    """sheet_id, gx, gy: multiples of step inside each integer box (xmin, ymin, xmax, ymax)."""
    xs = boxes.withColumn("gx", F.explode(between_multiples(F.col("xmin"), F.col("xmax"), F.lit(step).cast("long"))))
    return xs.select("*", F.explode(between_multiples(F.col("ymin"), F.col("ymax"), F.lit(step).cast("long"))).alias("gy")).select("sheet_id", "gx", "gy")


def segments(nodes: DataFrame, step: int) -> DataFrame:
    """Distinct unit segments that meet a node: sheet_id, x1, y1, x2, y2.  Integers, so distinct is exact."""
    x, y = F.col("gx"), F.col("gy")
    four = F.array(*[F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for a, b, c, d in ((x, y, x + step, y), (x - step, y, x, y), (x, y, x, y + step), (x, y - step, x, y))])
    return nodes.select("sheet_id", F.inline(four)).distinct()


def scaled_box(ring: Column, factor: float) -> Column:
    """struct<xmin, ymin, xmax, ymax>: the envelope times a factor, rounded half to even."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    r = lambda v: F.rint(v * factor).cast("long")
    return F.struct(r(F.array_min(xs)).alias("xmin"), r(F.array_min(ys)).alias("ymin"), r(F.array_max(xs)).alias("xmax"), r(F.array_max(ys)).alias("ymax"))


def on_sheet(lines: DataFrame, cutlines: DataFrame, bounds_check_buffer: float = 0.0) -> DataFrame:
    """Pixel lines (sheet_id, px1, py1, px2, py2, ...) of which either end lies in the sheet's cutline (sheet_id, ring), widened by a buffer with mitred corners."""
    if bounds_check_buffer:
        # a widened ring may have holes: a point in an odd number of its rings is inside
        parts = buffered(spread(cutlines, "sheet_id").withColumn("_by", F.lit(bounds_check_buffer)), "_by").withColumnRenamed("parts", "_parts")
        within = lambda n: F.size(F.filter("_parts", lambda r: inside(r, F.col(f"px{n}"), F.col(f"py{n}")))) % 2 == 1
        return lines.join(parts, "sheet_id").where(within(1) | within(2)).drop("_parts")
    both = lines.join(cutlines.select("sheet_id", F.col("ring").alias("_ring")), "sheet_id")
    return both.where(inside(F.col("_ring"), F.col("px1"), F.col("py1")) | inside(F.col("_ring"), F.col("px2"), F.col("py2"))).drop("_ring")


def locate_grid_lines(cutlines: DataFrame, gcps: DataFrame, step: int, factor: float = 1.0, bounds_check_buffer: float = 0.0) -> DataFrame:
    """Grid lines of sheets in pixels and in world coordinates: sheet_id, px1, py1, px2, py2, wx1, wy1, wx2, wy2.

    cutlines: sheet_id, ring (closed, pixels); gcps: sheet_id, gcps.  The ring is taken to the world,
    its box scaled and rounded, covered with a lattice of multiples of `step`, and the unit segments of
    its nodes are taken back; a segment stays if either end lies in
    the ring widened by `bounds_check_buffer` pixels.
    """
    corners = cutlines.select("sheet_id", F.posexplode("ring").alias("pos", "p")).select("sheet_id", F.col("pos").cast("long").alias("point_id"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    world = transform_points(corners, gcps)
    box = world.groupBy("sheet_id").agg(*[F.rint(f(c) * factor).cast("long").alias(n) for f, c, n in ((F.min, "tx", "xmin"), (F.min, "ty", "ymin"), (F.max, "tx", "xmax"), (F.max, "ty", "ymax"))])
    lines = segments(lattice(box, step), step).withColumn("line", F.xxhash64("x1", "y1", "x2", "y2"))
    world_of = lambda n: (F.col(n) / factor).alias(f"w{n}")
    lines = lines.select("sheet_id", "line", *[world_of(n) for n in ("x1", "y1", "x2", "y2")])
    ends = lines.select("sheet_id", F.inline(F.array(*[F.struct((F.col("line") if k == 1 else F.xxhash64("line", F.lit(2))).alias("point_id"), F.col(f"wx{k}").alias("x"), F.col(f"wy{k}").alias("y")) for k in (1, 2)])))
    back = transform_points(ends, gcps, inverse=True)
    one, two = (back.select(F.col("sheet_id"), F.col("point_id").alias(f"e{k}"), F.col("tx").alias(f"px{k}"), F.col("ty").alias(f"py{k}")) for k in (1, 2))
    keyed = lines.withColumn("e1", F.col("line")).withColumn("e2", F.xxhash64("line", F.lit(2)))
    both = keyed.join(one, ["sheet_id", "e1"]).join(two, ["sheet_id", "e2"])
    return on_sheet(both, cutlines, bounds_check_buffer).select("sheet_id", "px1", "py1", "px2", "py2", "wx1", "wy1", "wx2", "wy2")
