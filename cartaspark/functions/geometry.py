"""Rings, boxes and points as column expressions; a ring is an array of struct<x, y>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

RADIUS = 6378137.0


def envelope(ring: Column) -> Column:
    """struct<west, south, east, north> of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def edges(ring: Column) -> Column:
    """Consecutive pairs of a closed ring: array<struct<a, b>>."""
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))


def doubled_area(ring: Column) -> Column:
    """Twice the signed area by the shoelace formula; over 0 counter-clockwise where y grows upwards."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).cast("double"))


def canonical_ring(ring: Column) -> Column:
    """The vertices (closing one left out) of a ring in a canonical order.

    Counter-clockwise in the mathematical sense, walked backwards from the first vertex in the upper
    left quadrant of the centroid; null if there is none.
    """
    open_ = F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1))
    turned = F.when(doubled_area(ring) < 0, F.reverse(open_)).otherwise(open_)
    n = F.size(turned)
    cx = F.aggregate(turned, F.lit(0.0), lambda a, p: a + p["x"].cast("double")) / n
    cy = F.aggregate(turned, F.lit(0.0), lambda a, p: a + p["y"].cast("double")) / n
    first = F.array_min(F.filter(F.transform(turned, lambda p, i: F.when((p["x"] < cx) & (p["y"] < cy), i)), lambda i: i.isNotNull()))
    return F.when(first.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(turned, F.pmod(first - k, n))))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point in a closed ring; points on its edges are not inside."""
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0)) + e["a"]["x"])

    def on(e):
        cross = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        between = lambda v, k: (v >= F.least(e["a"][k], e["b"][k])) & (v <= F.greatest(e["a"][k], e["b"][k]))
        return (cross == 0) & between(x, "x") & between(y, "y")

    return (F.size(F.filter(edges(ring), crossing)) % 2 == 1) & ~F.exists(edges(ring), on)


def box_overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Area that two boxes share."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude (EPSG:4326) as spherical web-mercator metres (EPSG:3857)."""
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of to_mercator."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
