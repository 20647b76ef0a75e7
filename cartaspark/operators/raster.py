"""Rasters as relations (sheet_id, r, c, value): morphology, lines, sampling, arm counts.

Work on one sheet never needs another, so windows are partitioned by sheet and row or column; no
window spans a whole table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialise

SHEET = "sheet_id"


def filter_1d(mask: DataFrame, value: str, size: int, along: str, erode: bool) -> DataFrame:
    """Erosion (minimum) or dilation (maximum) with a 1 x size or size x 1 kernel.

    The anchor is size // 2; outside the image is neutral.  `along` is "c" (within rows) or "r".
    """
    across = "r" if along == "c" else "c"
    window = Window.partitionBy(SHEET, across).orderBy(along).rowsBetween(-(size // 2), size - 1 - size // 2)
    return mask.withColumn(value, (F.min if erode else F.max)(value).over(window))


def morph(mask: DataFrame, value: str, height: int, width: int, erode: bool, iterations: int = 1) -> DataFrame:
    """A rectangular kernel as two passes."""
    for _ in range(iterations):
        for size, along in ((width, "c"), (height, "r")):
            if size > 1:
                mask = filter_1d(mask, value, size, along, erode)
    return mask


def opening(mask: DataFrame, value: str, size: int, along: str) -> DataFrame:
    """Erosion, then dilation with the same kernel: keeps runs of at least `size`."""
    return filter_1d(filter_1d(mask, value, size, along, True), value, size, along, False)


def line_runs(mask: DataFrame, value: str, size: int, along: str) -> DataFrame:
    """Straight runs of set pixels of at least `size`: sheet_id, at (the fixed coordinate), first, last."""
    across = "r" if along == "c" else "c"
    kept = opening(mask, value, size, along).where(F.col(value) > 0)
    order = Window.partitionBy(SHEET, across).orderBy(along)
    runs = kept.withColumn("_run", F.col(along) - F.row_number().over(order))
    return runs.groupBy(SHEET, F.col(across).alias("at"), "_run").agg(F.min(along).alias("first"), F.max(along).alias("last")).drop("_run")


def line_intersections(mask: DataFrame, value: str, size: int) -> DataFrame:
    """Pixels that lie on both a horizontal and a vertical run: sheet_id, r, c."""
    across = opening(mask, value, size, "c").where(F.col(value) > 0).select(SHEET, "r", "c")
    down = opening(mask, value, size, "r").where(F.col(value) > 0).select(SHEET, "r", "c")
    return across.join(down, [SHEET, "r", "c"])


def interior(points: DataFrame, height: str | Column, width: str | Column) -> DataFrame:
    """Points strictly inside the image, its border left out."""
    h, w = (F.col(v) if isinstance(v, str) else v for v in (height, width))
    return points.where((F.col("r") > 0) & (F.col("r") < h - 1) & (F.col("c") > 0) & (F.col("c") < w - 1))


def components(mask: DataFrame, value: str, rounds: int | None = None) -> DataFrame:
    """8-connected components by minimum label propagation along runs: sheet_id, r, c, label (r * 2^32 + c of the first pixel).

    Each round spreads labels along whole runs in rows, columns and both diagonals, so the number of rounds
    follows the number of turns of the shapes, not their size.  Rounds go on until no
    label changes; with `rounds`, shapes that need more raise an error.
    """
    rows = mask.where(F.col(value) > 0).select(SHEET, "r", "c", (F.shiftleft(F.col("r").cast("long"), 32) + F.col("c")).alias("label"))
    for _ in count() if rounds is None else range(rounds):
        before = rows
        for along, across in (("c", F.col("r")), ("r", F.col("c")), ("r", F.col("r") - F.col("c")), ("r", F.col("r") + F.col("c"))):
            line = rows.withColumn("_line", across)
            run = line.withColumn("_run", F.col(along) - F.row_number().over(Window.partitionBy(SHEET, "_line").orderBy(along)))
            rows = run.withColumn("label", F.min("label").over(Window.partitionBy(SHEET, "_line", "_run"))).drop("_line", "_run")
        rows = materialise(rows, "components")
        if rows.join(before.select(SHEET, "r", "c", F.col("label").alias("_old")), [SHEET, "r", "c"]).where("label <> _old").isEmpty():
            return rows
    raise RuntimeError(f"labels still change after {rounds} rounds")


def component_boxes(labelled: DataFrame) -> DataFrame:
    """x, y, w, h and centre of each component."""
    box = labelled.groupBy(SHEET, "label").agg(F.min("c").alias("x"), F.min("r").alias("y"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"))
    return box.withColumn("cx", F.floor((2 * F.col("x") + F.col("w")) / 2)).withColumn("cy", F.floor((2 * F.col("y") + F.col("h")) / 2))


def biggest(boxes: DataFrame, max_area: Column | None = None) -> DataFrame:
    """The box with the largest area of each sheet (ties: first by y, x); `max_area` is an exclusive bound."""
    rows = boxes if max_area is None else boxes.where(F.col("w") * F.col("h") < max_area)
    rest = [c for c in boxes.columns if c != SHEET]
    return rows.groupBy(SHEET).agg(F.max_by(F.struct(*rest), F.struct(F.col("w") * F.col("h"), -F.col("y"), -F.col("x"))).alias("_b")).select(SHEET, "_b.*")


def clear_corner_edges(mask: DataFrame, value: str, right: bool, down: bool, height: int, width: int, ratio: float) -> DataFrame:
    """Zero a band at the two outer edges of a corner window; `right`/`down`: the map lies that way.

    Bands have `int(ratio * size)` pixels; on the near side columns [0, wd - 1) and rows [0, hd + 1), on
    the far side columns [w - wd + 1, w - 1) and rows [h - hd + 1, h - 1).
    """
    wd, hd = int(width * ratio), int(height * ratio)
    c0, c1 = (0, wd - 1) if right else (width - wd + 1, width - 1)
    r0, r1 = (0, hd + 1) if down else (height - hd + 1, height - 1)
    band = ((F.col("c") >= c0) & (F.col("c") < c1)) | ((F.col("r") >= r0) & (F.col("r") < r1))
    return mask.withColumn(value, F.when(band, F.lit(0)).otherwise(F.col(value)))


def arm_counts(points: DataFrame, mask: DataFrame, value: str, factor: int, cwidth: int, threshold: float, height: int, width: int) -> DataFrame:
    """How many of a point's four arms are lines: sheet_id, r, c, arms.

    Arms are 10 * factor pixels long and cover offsets up to cwidth - 1 to both sides; the middle
    counts three times (once if cwidth is 0).  Pixels outside the image do not count.
    """
    reach, side = 10 * factor, max(0, cwidth - 1)
    p = points.select(SHEET, F.col("r").alias("pr"), F.col("c").alias("pc"))
    # the pixels of each point's arms meet the mask by equality, so work does not grow with the sheet
    steps = p.distinct().withColumn("t", F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1)))).withColumn("off", F.explode(F.sequence(F.lit(-side), F.lit(side))))
    steps = steps.withColumn("down", F.explode(F.array(F.lit(True), F.lit(False))))
    along = lambda p, end: F.when(F.col("t") >= 0, F.col(p) + F.col("t") < F.least(F.col(p) + reach, F.lit(end - 1))).otherwise(F.col(p) + F.col("t") >= F.greatest(F.col(p) - reach, F.lit(0)))
    steps = steps.where(F.when(F.col("down"), along("pr", height)).otherwise(along("pc", width)))
    r, c = (F.col(k) + F.when(F.col("down") == F.lit(d), F.col("t")).otherwise(F.col("off")) for k, d in (("pr", True), ("pc", False)))
    weight = F.when(F.col("off") == 0, 3 if cwidth else 1).otherwise(1 if cwidth else 0)
    at = steps.select(SHEET, "pr", "pc", r.alias("r"), c.alias("c"), weight.alias("weight"), F.when(F.col("down"), F.when(F.col("t") >= 0, "down").otherwise("up")).otherwise(F.when(F.col("t") >= 0, "right").otherwise("left")).alias("arm"))
    near = at.join(mask.where(F.col(value) > 0).select(SHEET, "r", "c"), [SHEET, "r", "c"])
    bound = threshold * factor * (2 * cwidth + 1) / 3
    lines = near.groupBy(SHEET, "pr", "pc", "arm").agg(F.sum("weight").alias("n")).where(F.col("n") > bound)
    count = lines.groupBy(SHEET, "pr", "pc").agg(F.count("*").alias("arms"))
    return p.join(count, [SHEET, "pr", "pc"], "left").select(SHEET, F.col("pr").alias("r"), F.col("pc").alias("c"), F.coalesce("arms", F.lit(0)).cast("long").alias("arms"))


def four_way_point(arms_by_factor: DataFrame) -> DataFrame:
    """The single four-armed point of each sheet: sheet_id, factor, r, c (arms_by_factor: sheet_id, factor, r, c, arms).

    Factors are tried from small to large: exactly one four-armed point wins, none ends the search
    without result, several go on to the next factor.
    """
    per = arms_by_factor.groupBy(SHEET, "factor").agg(F.count_if(F.col("arms") == 4).alias("n"), F.min(F.when(F.col("arms") == 4, F.struct("r", "c"))).alias("p"))
    won = per.groupBy(SHEET).agg(F.min(F.when(F.col("n") <= 1, F.struct("factor", "n", "p"))).alias("w"))
    return won.where("w.n = 1").select(SHEET, "w.factor", "w.p.r", "w.p.c")


def downsample(px: DataFrame, value: str, k: int) -> DataFrame:
    """Area average over k x k cells."""
    return px.groupBy(SHEET, F.floor(F.col("r") / k).alias("r"), F.floor(F.col("c") / k).alias("c")).agg(F.avg(value).alias(value))


def overview(tiles: DataFrame, value: str, size: int) -> DataFrame:
    """Pixels of the parent tiles as means of 2 x 2 pixels (z, x, y, r, c, value; tiles of size x size pixels)."""
    r = F.floor((F.col("r") + size * (F.col("y") % 2)) / 2)
    c = F.floor((F.col("c") + size * (F.col("x") % 2)) / 2)
    parent = tiles.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), r.alias("r"), c.alias("c"), value)
    return parent.groupBy("z", "x", "y", "r", "c").agg(F.avg(value).alias(value))


def median_blur(px: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Lower median over the (2 radius + 1) square, cut off at the border; as a relation, for small rasters (see kernels.median_blur)."""
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = px.select(SHEET, "r", "c", value, steps.alias("dr")).select("*", steps.alias("dc"))
    around = spread.select(SHEET, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), value)
    size = px.groupBy(SHEET).agg(F.max("r").alias("_h"), F.max("c").alias("_w"))
    inside = around.join(size, SHEET).where("r between 0 and _h and c between 0 and _w")
    return inside.groupBy(SHEET, "r", "c").agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").cast(px.schema[value].dataType).alias(value))
