"""Scalar helpers of the sheet pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from the first point to the second, in (-180, 180]; y grows downwards on images."""
    return F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double")))


def angle_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def normalised_rotation(a: Column) -> Column:
    """Angles of a minimal rectangle over 45 degrees stand for the other side."""
    return F.when(a > 45, a - 90).otherwise(a)


def between_multiples(lo: Column, hi: Column, step: Column) -> Column:
    """All multiples of step in [lo, hi] as an array; empty if there is none.  Negative bounds are fine."""
    first, last = lo + F.pmod(-lo, step), hi - F.pmod(hi, step)
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), step)).otherwise(F.array().cast("array<bigint>"))


def resolution(scale: Column) -> Column:
    """Map units per pixel for a scale, to four places, half to even."""
    return F.bround(2.1166 * scale / 25000.0, 4)


def scaled(v: Column, ratio: float | Column) -> Column:
    """Scale and cut off towards zero."""
    return (v * ratio).cast("long")


def rotation_canvas(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the canvas that holds an image turned by an angle."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return (h * s + w * c).cast("long"), (h * c + w * s).cast("long")


def rotate_point(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Where a pixel of the upright image lies on the turned canvas."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    nw, nh = rotation_canvas(w, h, degrees)
    dx, dy = x - F.floor(w / 2), y - F.floor(h / 2)
    return c * dx + s * dy + nw / 2, -s * dx + c * dy + nh / 2


def unrotate_point(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """The inverse of rotate_point, rounded half to even."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    nw, nh = rotation_canvas(w, h, degrees)
    dx, dy = x - nw / 2, y - nh / 2
    return F.rint(c * dx - s * dy + F.floor(w / 2)).cast("long"), F.rint(s * dx + c * dy + F.floor(h / 2)).cast("long")
