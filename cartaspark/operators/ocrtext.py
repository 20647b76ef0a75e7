"""Text boxes of recognised words and characters, and the mask under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import box_overlap


def from_bottom_left(chars: DataFrame, height: str = "image_height") -> DataFrame:
    """Boxes with origin bottom left (left, bottom, right, top) as x, y, w, h with origin top left."""
    top = F.greatest("bottom", "top")
    return chars.withColumn("x", F.col("left")).withColumn("y", F.col(height) - top).withColumn("w", F.col("right") - F.col("left")).withColumn("h", F.abs(F.col("top") - F.col("bottom")))


def usable_words(words: DataFrame, confidence: int = 20) -> DataFrame:
    return words.where((F.trim("text") != "") & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("conf") > confidence))


def usable_chars(chars: DataFrame, size: int = 30) -> DataFrame:
    return chars.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") < size) & (F.col("h") < size))


def word_area(words: DataFrame, confidence: int = 20) -> DataFrame:
    """Per sheet the number of words and the area of those recognised with more than `confidence`."""
    area = F.when(F.col("conf") > confidence, F.col("w") * F.col("h")).otherwise(0)
    return words.groupBy("sheet_id").agg(F.count("*").alias("n"), F.sum(area).cast("long").alias("area"))


def chars_in_words(chars: DataFrame, words: DataFrame, ratio: float = 0.8, max_area: float = 1.1, cell: int = 64) -> DataFrame:
    """Characters that lie on a word of their sheet to more than `ratio` of their area and are at most `max_area` times its area.

    Both sides are dealt into square cells, so a sheet with very many boxes is no nested loop.
    """
    spread = lambda df: df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h")) / cell)))
    )
    key = ["sheet_id", "_cx", "_cy"]
    own = spread(chars)
    w = spread(words).select(*key, *[F.col(c).alias(f"_w{c}") for c in "xywh"])
    area = F.col("w") * F.col("h")
    shared = box_overlap(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("_wx"), F.col("_wy"), F.col("_ww"), F.col("_wh"))
    hit = own.join(w, key).where((shared > 0) & (area <= max_area * F.col("_ww") * F.col("_wh")) & (shared > ratio * area))
    return hit.select(*chars.columns).distinct()


def text_mask(pixels: DataFrame, boxes: DataFrame, value: str, border: int = 0) -> DataFrame:
    """Zero the mask under text boxes (once, border pixels wider)."""
    b = boxes.select("sheet_id", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    rows = b.select("sheet_id", F.explode(F.sequence(F.col("_y") - border, F.col("_y") + F.col("_h") - 1 + border)).alias("r"), (F.col("_x") - border).alias("c0"), (F.col("_x") + F.col("_w") - 1 + border).alias("c1"))
    under = rows.select("sheet_id", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct().withColumn("_t", F.lit(True))
    return pixels.join(under, ["sheet_id", "r", "c"], "left").withColumn(value, F.when(F.col("_t"), 0).otherwise(F.col(value))).drop("_t")
