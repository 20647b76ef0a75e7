"""Choosing map corners among candidate points; see kernels for the pixel work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import angle, distance


@dataclass(frozen=True)
class CornerRule:
    """A corner window: where the map lies from it (dx, dy are 1 or -1), the expected angle and the bounds."""

    dx: int
    dy: int
    anchor_angle: float
    height: int
    width: int
    max_dist_ratio: float = 1.0
    min_dist_ratio: float = 0.0
    max_angle: float = 180.0
    max_angle_cutoff: float = 180.0
    bands: int = 0
    min_points: int = 1


#: Corner windows in order: upper left, lower left, lower right, upper right.
WINDOWS = (("tl", 1, 1, 45.0), ("bl", 1, -1, -45.0), ("br", -1, -1, -135.0), ("tr", -1, 1, 135.0))


def nearest_corner(points: DataFrame, rule: CornerRule) -> DataFrame:
    """The intersection nearest to the window's outer corner: sheet_id, x, y, dist, angle_gap, problem.

    Points (sheet_id, x, y) are ordered by distance, then x * dx, then y * dy.  With bands, the first
    point is the anchor and the first `bands` points are skipped.  Distances are divided by the
    window's diagonal (less the anchor's distance); both ratio bounds and the angle cutoff are
    exclusive.  `problem` is null, "too few points" or "angle too high"; x and y are null with the first.
    """
    cx, cy = (rule.width if rule.dx < 0 else 0), (rule.height if rule.dy < 0 else 0)
    diagonal = float((rule.width**2 + rule.height**2) ** 0.5)
    order = Window.partitionBy("sheet_id").orderBy("d", F.col("x") * rule.dx, F.col("y") * rule.dy)
    rows = points.withColumn("d", distance(F.lit(cx), F.lit(cy), F.col("x"), F.col("y"))).withColumn("k", F.row_number().over(order))
    if rule.bands:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("ax", F.first("x").over(whole)).withColumn("ay", F.first("y").over(whole)).withColumn("diag", F.abs(F.lit(diagonal) - F.first("d").over(whole)))
    else:
        rows = rows.withColumn("ax", F.lit(cx)).withColumn("ay", F.lit(cy)).withColumn("diag", F.lit(diagonal))
    rows = rows.withColumn("dist", distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) / F.nullif(F.col("diag"), F.lit(0.0)))
    rows = rows.withColumn("angle_gap", F.abs(angle(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) - rule.anchor_angle))
    fits = (F.col("k") > rule.bands) & (F.col("dist") < rule.max_dist_ratio) & (F.col("dist") > rule.min_dist_ratio) & (F.col("angle_gap") < rule.max_angle_cutoff)
    best = rows.groupBy("sheet_id").agg(F.count_if(fits).alias("n"), F.min(F.when(fits, F.struct("dist", "k", "x", "y", "angle_gap"))).alias("p"))
    few = F.col("n") < rule.min_points
    problem = F.when(few | F.col("p").isNull(), "too few points").when(F.col("p.angle_gap") > rule.max_angle, "angle too high")
    take = lambda c: F.when(~few, F.col(f"p.{c}")).alias(c)
    return best.select("sheet_id", take("x"), take("y"), take("dist"), take("angle_gap"), problem.alias("problem"))


def nearest_point(points: DataFrame, cx: int, cy: int) -> DataFrame:
    """Of each sheet the point with the least squared distance, then x, y, cand_id."""
    d2 = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    best = points.groupBy("sheet_id").agg(F.min(F.struct(d2.alias("d2"), F.col("x"), F.col("y"), F.col("cand_id"))).alias("p"))
    return best.select("sheet_id", "p.*")


def override(detected: DataFrame, given: DataFrame) -> DataFrame:
    """Corners (sheet_id, pos, x, y): a given corner beats a detected one of the same position."""
    g = given.select("sheet_id", "pos", F.struct("x", "y").alias("g"))
    both = detected.select("sheet_id", "pos", F.struct("x", "y").alias("d")).join(g, ["sheet_id", "pos"], "full_outer")
    return both.select("sheet_id", "pos", F.coalesce("g", "d").alias("p")).select("sheet_id", "pos", "p.x", "p.y")


def control_points(rings: DataFrame, corners: DataFrame) -> DataFrame:
    """Ground control points: ring (sheet_id, ring; closed) vertex i goes with corner i (sheet_id, corners).

    Fails for a sheet whose ring does not have one vertex more than there are corners.
    """
    both = rings.join(corners, "sheet_id")
    fits = F.size("ring") - 1 == F.size("corners")
    checked = F.when(fits, F.col("corners")).otherwise(F.raise_error(F.concat(F.lit("corners do not match the ring of sheet "), F.col("sheet_id").cast("string"))).cast("array<struct<x:double,y:double>>"))
    pairs = both.select("sheet_id", F.col("ring"), checked.alias("corners"))
    gcps = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), "corners", lambda w, p: F.struct(p["x"].cast("double").alias("px"), p["y"].cast("double").alias("py"), w["x"].cast("double").alias("x"), w["y"].cast("double").alias("y")))
    return pairs.select("sheet_id", gcps.alias("gcps"))


def first_success(results: DataFrame) -> DataFrame:
    """Of results by candidate order (sheet_id, ord, result) the first that is not null; sheets without any have null."""
    return results.groupBy("sheet_id").agg(F.min_by("result", F.when(F.col("result").isNotNull(), F.col("ord"))).alias("result"))


def corrected_points(hits: DataFrame) -> DataFrame:
    """Grid intersections corrected from hits by colour: sheet_id, x, y, type.

    hits: sheet_id, x, y (the expected point), valid, and found: array<struct<ord, n, hx, hy>> by colour
    order.  Colours are read in order: more than one hit ends the search; of colours with one hit the
    last before that would win, but an early end has no result.
    """
    ordered = F.array_sort("found")
    many, hit = F.exists(ordered, lambda f: f["n"] > 1), F.element_at(F.filter(ordered, lambda f: f["n"] == 1), -1)
    any_hit = F.exists(ordered, lambda f: f["n"] == 1)
    kind = F.when(~F.col("valid"), "invalid").when(many, "too_many_choices").when(~any_hit, "no_choices")
    rows = hits.withColumn("_k", kind).withColumn("_h", F.when(F.col("_k").isNull(), hit))
    same = (F.col("_h.hx") == F.col("x").cast("long")) & (F.col("_h.hy") == F.col("y").cast("long"))
    return rows.select("sheet_id", F.coalesce("_h.hx", "x").alias("x"), F.coalesce("_h.hy", "y").alias("y"), F.coalesce("_k", F.when(same, "unchanged").otherwise("corrected")).alias("type"))
