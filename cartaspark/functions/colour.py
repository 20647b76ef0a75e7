"""Colour ranges: BGR to HSV (H 0-179, S and V 0-255) and masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values: (lower, upper) HSV bounds, inclusive.
COLOURS = {"black": ((0, 0, 0), (179, 255, 130)), "greyish": ((0, 0, 50), (179, 150, 192)), "white": ((0, 0, 200), (179, 60, 255))}


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (half degrees), saturation and value, rounded half to even."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (high - low).cast("double")
    turn = F.when(span == 0, F.lit(0.0)).when(high == r, 60.0 * (g - b) / F.nullif(span, F.lit(0.0))).when(high == g, 120 + 60.0 * (b - r) / F.nullif(span, F.lit(0.0))).otherwise(240 + 60.0 * (r - g) / F.nullif(span, F.lit(0.0)))
    h = F.rint(F.when(turn < 0, turn + 360).otherwise(turn) / 2).cast("int")
    s = F.when(high == 0, F.lit(0)).otherwise(F.rint(255.0 * span / F.nullif(high.cast("double"), F.lit(0.0))).cast("int"))
    return F.when(h >= 180, h - 180).otherwise(h), s, high.cast("int")


def in_colour(b: Column, g: Column, r: Column, colour: str | Sequence[str], ranges: dict = COLOURS) -> Column:
    """Whether a pixel is in a named range; `not_` before a name inverts it; of a list any may hold."""
    if not isinstance(colour, str):
        return reduce(lambda x, y: x | y, [in_colour(b, g, r, c, ranges) for c in colour])
    name = colour.removeprefix("not_")
    if name not in ranges:
        raise ValueError(f"unknown colour {name}")
    lower, upper = ranges[name]
    within = reduce(lambda x, y: x & y, [v.between(lo, hi) for v, lo, hi in zip(hsv(b, g, r), lower, upper, strict=True)])
    return ~within if name != colour else within
