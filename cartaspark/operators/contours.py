"""Contours of masks: rings of border pixels with a two-level hierarchy of outer borders and holes.

Set pixels touch over edges and corners (8 neighbours), unset ones over edges (4 neighbours).  A
border runs along the cracks between set and unset pixels, with the set ones at its right; where two
set pixels touch at a corner it goes on to the other one.  Every crack has exactly one successor, so
all borders of a mask come from one table of successors, which array operations build.  A ring holds
the pixel centres along its border, without repeats in a row and without points inside straight
runs; the ring of a hole runs over the set pixels around it, as the hole's border belongs to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

#: Sides of a pixel in clockwise order: the way along it and the way out of it, as (row, column).
_ALONG = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])


@dataclass(frozen=True)
class Contour:
    """A border: its ring of (x, y), whether it is a hole's, the number of its outer border (its own, if it is one), and its first pixel."""

    ring: np.ndarray
    hole: bool
    outer: int
    first: tuple[int, int]

    @property
    def box(self) -> tuple[int, int, int, int]:
        low, high = self.ring.min(0), self.ring.max(0)
        return int(low[0]), int(low[1]), int(high[0] - low[0] + 1), int(high[1] - low[1] + 1)

    @property
    def box_area(self) -> int:
        return self.box[2] * self.box[3]

    @property
    def area(self) -> float:
        """Area inside the ring of pixel centres (shoelace), never negative."""
        return abs(signed_area(self.ring))

    @property
    def length(self) -> float:
        return float(np.hypot(*(np.roll(self.ring, -1, 0) - self.ring).T).sum())


def signed_area(ring: np.ndarray) -> float:
    """Shoelace area of a ring (its end not repeated); over 0 if it runs clockwise on the screen, where y grows downwards."""
    x, y = np.asarray(ring, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def trace(mask: np.ndarray, unset: np.ndarray | None = None) -> list[Contour]:
    """All contours of a mask: outer borders in the order of their first pixels by rows, each followed by its holes, likewise ordered.

    `unset` are the unset pixels, where others than those that the mask leaves out; see _trace_parts.
    """
    if unset is not None and (unset != ~mask.astype(bool)).any():
        return _trace_parts(mask, unset)
    on = np.pad(np.asarray(mask) != 0, 1)
    rows, cols, sides = [], [], []
    for side in range(4):
        r, c = np.nonzero(on & ~np.roll(on, -_OUT[side], (0, 1)))
        rows.append(r)
        cols.append(c)
        sides.append(np.full(len(r), side))
    r, c, side = map(np.concatenate, (rows, cols, sides))
    if not len(r):
        return []
    number = np.full((4, *on.shape), -1, np.int64)
    order = np.lexsort((side, c, r))
    r, c, side = r[order], c[order], side[order]
    number[side, r, c] = np.arange(len(r))
    ahead_r, ahead_c = r + _ALONG[side, 0], c + _ALONG[side, 1]
    far_r, far_c = ahead_r + _OUT[side, 0], ahead_c + _OUT[side, 1]
    left, straight = on[far_r, far_c], on[ahead_r, ahead_c]
    following = np.where(left, number[(side + 3) % 4, far_r, far_c], np.where(straight, number[side, ahead_r, ahead_c], number[(side + 1) % 4, r, c])).tolist()

    labels, _ = K.label(on)
    seen, walk, starts = bytearray(len(r)), [], []
    for start in range(len(r)):
        if not seen[start]:
            starts.append(len(walk))
            at = start
            while not seen[at]:
                seen[at] = 1
                walk.append(at)
                at = following[at]
    starts, walk = np.array(starts), np.array(walk)
    r, c, side = r[walk], c[walk], side[walk]
    # cells inside: rows below lower sides count up, those above upper sides down
    holes = np.add.reduceat(np.where(side == 2, r + 1, 0) - np.where(side == 0, r, 0), starts) < 0
    # an outer border's first pixel, and the pixel of a hole itself that is first by rows: the one below its first lower side
    width = on.shape[1]
    place = np.where(holes, np.minimum.reduceat(np.where(side == 2, (r + 1) * width + c, on.size), starts), np.minimum.reduceat(r * width + c, starts))
    pixels, ring = np.column_stack([c, r]) - 1, np.repeat(np.arange(len(starts)), np.diff([*starts, len(r)]))
    other = (pixels != pixels[_neighbours(ring, 1)]).any(1)
    alone = np.add.reduceat(other, starts) == 0
    other[starts[alone]] = True
    pixels, ring = pixels[other], ring[other]
    before, after = pixels[_neighbours(ring, -1)], pixels[_neighbours(ring, 1)]
    bend = (after - pixels != pixels - before).any(1) | (np.bincount(ring)[ring] < 3)
    rings = np.split(pixels[bend], np.flatnonzero(np.diff(ring[bend])) + 1)
    label = labels[r[starts], c[starts]]
    out: list[Contour] = []
    outer = -1
    for k in np.lexsort((place, holes, label)).tolist():
        if not holes[k]:
            outer = len(out)
        out.append(Contour(rings[k], bool(holes[k]), outer, (int(place[k]) // width - 1, int(place[k]) % width - 1)))
    return out


def _trace_parts(mask: np.ndarray, unset: np.ndarray) -> list[Contour]:
    """Contours of a mask with missing pixels: its outer borders, and around unset pixels the borders of all that is not unset.

    A hole belongs to the contour of the set pixel left of its first one; it is none where that pixel is missing.
    """
    labels, n = K.label(mask)
    own: list[list[Contour]] = [[x] for x in trace(mask) if not x.hole]
    for x in trace(~unset):
        if x.hole and (label := labels[x.first[0], x.first[1] - 1]):
            own[label - 1].append(x)
    starts = np.cumsum([0, *map(len, own)]).tolist()
    return [replace(x, outer=outer) for outer, group in zip(starts, own) for x in group]  # noqa: B905


def _neighbours(ring: np.ndarray, step: int) -> np.ndarray:
    """For each point the place of the one before (-1) or after (1) it on its ring; points of a ring stand together."""
    at = np.arange(len(ring)) + step
    edges = np.flatnonzero(np.diff(ring)) + 1
    first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(ring)])) - 1
    if step < 0:
        at[first] = last
    else:
        at[last] = first
    return at


def first_hole(contours: list[Contour], outer: int) -> int | None:
    """The hole that a contour lists first: the one found last when a mask is searched row by row."""
    holes = [k for k, x in enumerate(contours) if x.hole and x.outer == outer]
    return max(holes, key=lambda k: contours[k].first) if holes else None


#: Points of rings after which rows are passed on.
POINTS = 1 << 16
RINGS = "sheet_id string, contour int, parent int, x int, y int, w int, h int, area double, ring array<struct<x: int, y: int>>"


def contour_rings(masks: DataFrame) -> DataFrame:
    """A row for each contour of masks (sheet_id, height, width, data: a byte a pixel): its number, that of its outer border (null for one), box, area and ring.

    A column `unset`, likewise a byte a pixel, tells of masks with missing pixels which ones are there and unset;
    without it, or where it is null, no pixel is missing.  Masks are traced one at a time, where they are; nothing
    is shuffled.  An empty mask has no rows.
    """
    columns = ["sheet_id", "contour", "parent", "x", "y", "w", "h", "area", "ring"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"parent": "Int32"})

        for frame in frames:
            out, points = [], 0
            for row in frame.itertuples(index=False):
                mask, unset = (None if v is None else np.frombuffer(v, np.uint8).reshape(int(row.height), int(row.width)) != 0 for v in (row.data, row.unset))
                for k, x in enumerate(trace(mask, unset)):
                    out.append((row.sheet_id, k, x.outer if x.hole else None, *x.box, x.area, [{"x": a, "y": b} for a, b in x.ring.tolist()]))
                    points += len(x.ring)
                if points > POINTS:
                    yield made(out)
                    out, points = [], 0
            if out:
                yield made(out)

    unset = F.col("unset") if "unset" in masks.columns else F.lit(None).cast("binary").alias("unset")
    return masks.select("sheet_id", "height", "width", "data", unset).mapInPandas(run, RINGS)


def with_holes(rings: DataFrame) -> DataFrame:
    """Outer contours alone, each with the number of its holes and their areas together; one exchange, so that masks are traced once."""
    carried = [c for c in rings.columns if c not in ("sheet_id", "contour", "parent")]
    hole = F.col("parent").isNotNull()
    met = rings.groupBy("sheet_id", F.coalesce("parent", "contour").alias("contour")).agg(
        F.first(F.when(~hole, F.struct(*carried)), ignorenulls=True).alias("outer"), F.count_if(hole).alias("holes"), F.coalesce(F.sum(F.when(hole, F.col("area"))), F.lit(0.0)).alias("hole_area")
    )
    return met.select("sheet_id", "contour", "outer.*", "holes", "hole_area")
