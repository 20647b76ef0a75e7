"""Unions and buffers of rings by an arrangement of their edges.

Edges of all rings are swept by their least x and cut where they meet: at crossings, where an end lies
on another edge, and along shared stretches.  The pieces bound faces in which every point is wound
around equally often.  The boundary of the faces that count (wound at least once, where rings run
counter-clockwise) is chained into rings again, outer ones counter-clockwise and holes clockwise.

A union winds around each ring once.  A buffer with mitred corners winds around the ring of shifted
edges: parts in which that ring crosses itself, and edges that a shift inwards has turned around, are
wound around the other way or not at all, and so go.  Rings are given without their end repeated;
"counter-clockwise" is meant where y grows upwards.

The arrays hold the edges of many arrangements at once; `group` tells which one an edge belongs to, and
ascends.  So a batch of small sheets costs array operations of the batch's length, not calls a sheet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Places are whole numbers up to this, from the least corner on, so that products of differences are exact; whole pixels of images of any usual size are exact too.
GRID = 1 << 26
#: A mitre longer than so many shifts is cut off.
MITRE_LIMIT = 5.0
#: More than any whole place; places and groups make up one sorting key.
SPAN = GRID << 2
#: Pairs of edges looked at together, and edges of arrangements made together (one alone may have more).
PAIRS, EDGES = 1 << 17, 1 << 14
#: Arrangements made together at most, so that a group and two places make up a number of 64 bits.
GROUPS = 1 << 12


class NotOnePolygon(ValueError):
    """A union consists of several polygons, or of none."""


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def doubled_area(ring: np.ndarray) -> float:
    return float(_cross(ring, np.roll(ring, -1, 0)).sum())


def _ranges(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) with j from first[i] to last[i], that one left out, PAIRS or so at a time."""
    counts = np.maximum(last - first, 0)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        n = counts[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
        lo = hi


def _neighbours(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point of rings of these sizes, one after the other, the places of the one before and the one after it."""
    at, last = np.arange(sizes.sum()), np.cumsum(sizes)
    before, after = at - 1, at + 1
    some = sizes > 0
    before[(last - sizes)[some]], after[last[some] - 1] = last[some] - 1, (last - sizes)[some]
    return before, after


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of these sizes."""
    out = np.zeros(len(sizes))
    if len(values):
        some = sizes > 0
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _pieces(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges cut where they meet others of their group; coordinates are whole numbers before and after."""
    order = np.argsort(group * SPAN + np.minimum(start[:, 0], end[:, 0]).astype(np.int64), kind="stable")
    group = group[order]
    (sx, sy), (ex, ey) = np.ascontiguousarray(start[order].T), np.ascontiguousarray(end[order].T)
    lx, ly, hx, hy, wx, wy = np.minimum(sx, ex), np.minimum(sy, ey), np.maximum(sx, ex), np.maximum(sy, ey), ex - sx, ey - sy
    own = np.arange(len(sx))
    edges, xs, ys = [own, own], [sx, ex], [sy, ey]

    def cut(edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        edges.append(edge)
        xs.append(x)
        ys.append(y)

    # the sweep: only edges that begin before this one ends
    until = np.searchsorted(group * SPAN + lx.astype(np.int64), group * SPAN + hx.astype(np.int64), "right")
    for i, j in _ranges(own + 1, until):
        near = np.flatnonzero((ly[j] <= hy[i]) & (hy[j] >= ly[i]))
        i, j = i[near], j[near]
        gx, gy, ax, ay, bx, by = sx[j] - sx[i], sy[j] - sy[i], wx[i], wy[i], wx[j], wy[j]
        turn, along = ax * by - ay * bx, gx * ay - gy * ax
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (gx * by - gy * bx) / turn, along / turn
        met = np.flatnonzero((turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        i_met, j_met, t, u = i[met], j[met], t[met], u[met]
        x, y = np.rint(sx[i_met] + t * ax[met]), np.rint(sy[i_met] + t * ay[met])
        for edge, v in ((i_met, t), (j_met, u)):  # ends are there already
            amid = (v > 0) & (v < 1)
            cut(edge[amid], x[amid], y[amid])
        line = np.flatnonzero((turn == 0) & (along == 0))  # along one line
        for c, d in ((i[line], j[line]), (j[line], i[line])):
            for x, y in ((sx[d], sy[d]), (ex[d], ey[d])):
                on = (x >= lx[c]) & (x <= hx[c]) & (y >= ly[c]) & (y <= hy[c])
                cut(c[on], x[on], y[on])
    edge, x, y = np.concatenate(edges), np.concatenate(xs), np.concatenate(ys)
    share = ((x - sx[edge]) * wx[edge] + (y - sy[edge]) * wy[edge]) / (wx * wx + wy * wy)[edge]
    order = np.argsort(2 * edge + share, kind="stable")
    edge, x, y = edge[order], x[order], y[order]
    other = np.flatnonzero(np.concatenate(([True], (edge[1:] != edge[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    edge, code = edge[other], _code(x[other], y[other], group[edge[other]])
    on = np.flatnonzero(edge[1:] == edge[:-1])
    places, number = _numbered(code)
    return number[on], number[on + 1], places


def _code(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whole places of groups (GROUPS at most) as numbers that ascend by group, x and y."""
    return (group * GRID + x.astype(np.int64)).astype(np.uint64) * np.uint64(GRID) + y.astype(np.uint64)


def _decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and groups of such numbers."""
    high, grid = (code // np.uint64(GRID)).astype(np.int64), np.uint64(GRID)
    return np.column_stack([high % GRID, (code % grid).astype(np.int64)]).astype(float), high // GRID


def _numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and of each value its number among them."""
    order = np.argsort(code)
    ranked = code[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(code)]
    number = np.empty(len(code), np.int64)
    number[order] = np.cumsum(first) - 1
    return ranked[first], number


def _boundary(start: np.ndarray, end: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces (between numbered places) with a face that counts on their left and one that does not on their right."""
    forward = start < end
    piece, number = _numbered(np.minimum(start, end) * len(places) + np.maximum(start, end))
    net = np.bincount(number, np.where(forward, 1, -1), len(piece)).astype(np.int64)
    piece, net = piece[net != 0], net[net != 0]
    low, high = piece // len(places), piece % len(places)
    point, of = _decoded(places)
    group = of[low]
    (ax, ay), (bx, by) = np.ascontiguousarray(point[low].T), np.ascontiguousarray(point[high].T)
    x, y = (ax + bx) / 2, (ay + by) / 2
    # pieces that cross the ray to the right, itself left out; level ones cross none
    steep = np.flatnonzero(ay != by)
    key = group[steep] * SPAN + np.minimum(ay, by)[steep].astype(np.int64)
    order = np.argsort(key, kind="stable")
    steep, key = steep[order], key[order]
    cx, cy, dx, dy, top = ax[steep], ay[steep], (bx - ax)[steep], (by - ay)[steep], np.maximum(ay, by)[steep]
    sign = np.where(dy > 0, net[steep], -net[steep])
    around = np.zeros(len(piece), np.int64)
    for i, j in _ranges(np.searchsorted(key, group * SPAN, "left"), np.searchsorted(key, group * SPAN + np.floor(y).astype(np.int64), "right")):
        near = np.flatnonzero(top[j] > y[i])
        i, j = i[near], j[near]
        right = np.flatnonzero((cx[j] + (y[i] - cy[j]) * dx[j] / dy[j] > x[i]) & (steep[j] != i))
        i = i[right]
        if len(i):
            found = np.bincount(i - i[0], sign[j[right]])
            around[i[0] : i[0] + len(found)] += found.astype(np.int64)
    # pieces run to the right, or straight up: the ray leaves a rising one from its right side, others from their left
    left = np.where(by > ay, around + net, around)
    right = left - net
    keep, turn = (left > 0) & (right <= 0), (left <= 0) & (right > 0)
    both = np.flatnonzero(keep | turn)
    return np.where(turn, high, low)[both], np.where(turn, low, high)[both]


def _chain(leave: np.ndarray, arrive: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings of boundary pieces between numbered places (points): the pieces in their order, and the number of each ring's.

    Where several go on, the one furthest to the left does, so that rings that touch stay apart.
    """
    order = np.argsort(leave, kind="stable")
    first, last = np.searchsorted(leave[order], arrive, "left"), np.searchsorted(leave[order], arrive, "right")
    following = np.where(first < last, order[np.minimum(first, len(order) - 1)], -1)

    def turn(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        way, ahead = point[arrive[i]] - point[leave[i]], point[arrive[j]] - point[leave[j]]
        return np.arctan2(_cross(way, ahead), (way * ahead).sum(1))

    several = np.flatnonzero(last - first > 1)
    for i, j in _ranges(first[several], last[several]):
        i, j = several[i], order[j]
        best = np.lexsort((-j, turn(i, j), i))  # of each i the last one is the furthest to the left
        best = best[np.concatenate((i[best][1:] != i[best][:-1], [True]))]
        following[i[best]] = j[best]
    following = following.tolist()
    used, walk, sizes = bytearray(len(leave)), [], []
    for begin in range(len(leave)):
        if used[begin]:
            continue
        k, before = begin, len(walk)
        while not used[k]:
            used[k] = 1
            walk.append(k)
            ahead = following[k]
            if ahead < 0 or (used[ahead] and ahead != begin):
                left = [j for j in order[first[k] : last[k]].tolist() if not used[j] or j == begin]
                if not left:
                    break
                ahead = left[int(turn(np.full(len(left), k), np.array(left)).argmax())]
            k = ahead
        sizes.append(len(walk) - before)
    return np.array(walk, np.int64), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Rings:
    """Rings of many groups (which ascend): their points one after the other, their sizes and their groups."""

    points: np.ndarray
    sizes: np.ndarray
    group: np.ndarray

    @classmethod
    def of(cls, rings: list[np.ndarray], group: int = 0) -> Rings:
        parts = [np.asarray(r, float).reshape(-1, 2) for r in rings]
        return cls(np.concatenate([np.zeros((0, 2)), *parts]), np.array([len(r) for r in parts], np.int64), np.full(len(parts), group, np.int64))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def split(self) -> list[np.ndarray]:
        return np.split(self.points, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []

    def take(self, kept: np.ndarray) -> Rings:
        """Those of the rings that a mask has."""
        return Rings(self.points[np.repeat(kept, self.sizes)], self.sizes[kept], self.group[kept])

    def within(self, lo: int, hi: int) -> Rings:
        """The rings of groups from lo to hi, that one left out."""
        a, b = np.searchsorted(self.group, (lo, hi))
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        return Rings(self.points[ends[a] : ends[b]], self.sizes[a:b], self.group[a:b])

    @classmethod
    def joined(cls, parts: list[Rings]) -> Rings:
        """All of these, in their order."""
        return cls(*(np.concatenate([getattr(p, c) for p in (cls.of([]), *parts)]) for c in ("points", "sizes", "group")))

    def areas(self) -> np.ndarray:
        """Doubled areas, over 0 for those that run counter-clockwise."""
        return _sums(_cross(self.points, self.points[_neighbours(self.sizes)[1]]), self.sizes)

    def turned(self, which: np.ndarray) -> Rings:
        """These rings with some of them running the other way."""
        at = np.arange(len(self.points))
        return Rings(self.points[np.where(np.repeat(which, self.sizes), np.repeat(2 * self.starts + self.sizes - 1, self.sizes) - at, at)], self.sizes, self.group)


def _slices(rings: Rings) -> Iterator[Rings]:
    """Rings of whole groups, EDGES points or so at a time."""
    ends = np.cumsum(rings.sizes)
    last = np.flatnonzero(np.concatenate((rings.group[1:] != rings.group[:-1], [True]))[: len(ends)])  # of each group
    lo = 0
    while lo < len(last):
        base = ends[last[lo - 1]] if lo else 0
        hi = min(lo + GROUPS, max(lo + 1, int(np.searchsorted(ends[last], base + EDGES, "right"))))
        yield rings.within(int(rings.group[last[lo]]), int(rings.group[last[hi - 1]]) + 1)
        lo = hi


def _faces(curves: Rings, known: bool) -> Rings:
    """Rings around the faces that the closed curves of each group wind around at least once; points inside straight runs stay where they are `known` as one of the curves'.

    Places become whole numbers in a grid of each group's own: a power of two as unit, counted from an origin.
    """
    return Rings.joined([_faces_of(part, known) for part in _slices(curves) if len(part.points)])


def _faces_of(curves: Rings, known: bool) -> Rings:
    groups, own = np.unique(np.repeat(curves.group, curves.sizes), return_inverse=True)
    begin = np.searchsorted(own, np.arange(len(groups)))
    low, high = np.minimum.reduceat(curves.points, begin), np.maximum.reduceat(curves.points, begin)
    extent = (high - low).max(1)
    unit = np.exp2(np.ceil(np.log2(np.where(extent > 0, extent, 1.0) / (GRID - 2))))[:, None]
    origin = np.floor(low / unit) * unit
    start = np.rint((curves.points - origin[own]) / unit[own])
    end = start[_neighbours(curves.sizes)[1]]
    real = (start != end).any(1)
    if not real.any():
        return Rings.of([])
    one, two, places = _pieces(start[real], end[real], own[real])
    leave, arrive = _boundary(one, two, places)
    if not len(leave):
        return Rings.of([])
    point, group = _decoded(places)
    walk, sizes = _chain(leave, arrive, point)
    at = leave[walk]
    point, group = point[at], group[at]
    before, after = _neighbours(sizes)
    bend = _cross(point - point[before], point[after] - point) != 0
    if known:
        bend |= np.isin(places, _code(*start.T, own))[at]
    ring = np.repeat(np.arange(len(sizes)), sizes)
    rings = Rings(point[bend], np.bincount(ring[bend], minlength=len(sizes)), group[np.cumsum(sizes) - sizes])
    rings = rings.take(rings.sizes > 2)
    if not len(rings.sizes):
        return Rings.of([])
    wide = (np.maximum.reduceat(rings.points, rings.starts) - np.minimum.reduceat(rings.points, rings.starts)).max(1)
    rings = rings.take(np.abs(rings.areas()) > 4 * rings.sizes * wide)  # else a sliver of rounding
    own = np.repeat(rings.group, rings.sizes)
    return Rings(rings.points * unit[own] + origin[own], rings.sizes, groups[rings.group])


def unions(rings: Rings) -> Rings:
    """The rings around what any of some simple rings of each group encloses: outer ones counter-clockwise, holes clockwise."""
    return _faces(_curves(rings), True)


def _curves(rings: Rings) -> Rings:
    """Rings that enclose something, counter-clockwise; one with a place that is not known encloses nothing."""
    rings = rings.take((rings.sizes > 2) & (_sums(~np.isfinite(rings.points).all(1), rings.sizes) == 0))
    return rings.turned(rings.areas() < 0)


def union(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings around what any of some simple rings encloses: outer ones counter-clockwise, holes clockwise."""
    return unions(Rings.of(rings)).split()


def cutline(rings: list[np.ndarray], area: list[np.ndarray] | None = None) -> np.ndarray:
    """The one outer ring of a union (`area`, if it is known), run through from its end and with places cut off to whole pixels; NotOnePolygon if parts lie apart.

    The ring begins at the first of the given points that lies on it.
    """
    outer = [r for r in (union(rings) if area is None else area) if doubled_area(r) > 0]
    if len(outer) != 1:
        raise NotOnePolygon(f"expected one polygon, not {len(outer)}")
    ring = outer[0][::-1]
    given = np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rings])
    far = np.concatenate([np.hypot(*np.moveaxis(part[:, None] - ring, 2, 0)).min(1) for part in np.split(given, range(1024, len(given), 1024))])
    near = np.flatnonzero(far < 1e-6)
    first = int(np.hypot(*(ring - given[near[0]]).T).argmin()) if len(near) else 0
    return np.trunc(np.round(np.roll(ring, -first, 0), 6)).astype(int)


def buffers(rings: Rings, by: np.ndarray) -> Rings:
    """Rings around simple rings, one a group, widened by `by` each (below 0: narrowed) with mitred corners; none where nothing is left."""
    fit = (rings.sizes > 2) & (_sums(~np.isfinite(rings.points).all(1), rings.sizes) == 0) & np.isfinite(by)
    rings, by = rings.take(fit), by[fit]
    rings = rings.turned(rings.areas() < 0)
    before, _ = _neighbours(rings.sizes)
    other = (rings.points != rings.points[before]).any(1)
    rings = Rings(rings.points[other], _sums(other, rings.sizes).astype(np.int64), rings.group)
    same = rings.take((by == 0) & (rings.sizes > 0))
    rings, by = rings.take((by != 0) & (rings.sizes > 0)), by[(by != 0) & (rings.sizes > 0)]
    p, by, ring = rings.points, np.repeat(by, rings.sizes), np.repeat(np.arange(len(rings.sizes)), rings.sizes)
    before, after = _neighbours(rings.sizes)
    way = p[after] - p
    way /= np.hypot(*way.T)[:, None]
    out = np.column_stack([way[:, 1], -way[:, 0]]) * by[:, None]
    turn, ahead = _cross(way[before], way), (way[before] * way).sum(1)
    # the sides part at this corner: go on to where they meet, unless that is too far away
    part = (turn * by >= 0) & (ahead > -1 + 1e-12) | (np.abs(turn) < 1e-12) & (ahead > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        tip = (out[before] + out) / (1 + ahead)[:, None]
        near = part & (np.hypot(*tip.T) <= MITRE_LIMIT * np.abs(by))
    far = part & ~near
    count = np.where(near, 1, np.where(far, 2, 3))
    at = np.cumsum(count) - count
    shifted = np.empty((int(count.sum()), 2))
    shifted[at[near]] = (p + tip)[near]
    # cut off at right angles to the corner's bisector, MITRE_LIMIT shifts away
    k, size = np.flatnonzero(far), np.abs(by[far])
    middle = tip[k] / np.hypot(*tip[k].T)[:, None]
    side = np.column_stack([-middle[:, 1], middle[:, 0]])
    reach = MITRE_LIMIT * size
    half = (size - reach * np.abs((middle * out[k]).sum(1)) / size) / np.maximum(1e-12, np.abs((side * out[k]).sum(1)) / size)
    centre, half = p[k] + middle * reach[:, None], side * (half * np.where((side * out[before[k]]).sum(1) > 0, 1, -1))[:, None]
    shifted[at[k]], shifted[at[k] + 1] = centre + half, centre - half
    # the sides run into each other: by way of the corner, what is too much is wound around the other way
    k = np.flatnonzero(~part)
    shifted[at[k]], shifted[at[k] + 1], shifted[at[k] + 2] = p[k] + out[before[k]], p[k], p[k] + out[k]
    found = Rings.joined([_faces(Rings(shifted, np.bincount(ring, count, len(rings.sizes)).astype(np.int64), rings.group), False), same])
    order = np.argsort(found.group, kind="stable")
    if (order[1:] > order[:-1]).all():
        return found
    at = np.repeat(found.starts[order], found.sizes[order]) + np.arange(len(found.points)) - np.repeat(np.cumsum(found.sizes[order]) - found.sizes[order], found.sizes[order])
    return Rings(found.points[at], found.sizes[order], found.group[order])


def buffer(ring: np.ndarray, by: float) -> list[np.ndarray]:
    """Rings around a simple ring widened by `by` (below 0: narrowed) with mitred corners; none if nothing is left."""
    return buffers(Rings.of([ring]), np.array([by], float)).split()


def contains(rings: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Which points lie inside an area given by its rings (even-odd); points on an edge do not."""
    points = np.asarray(points, float).reshape(-1, 2)
    out, on = np.zeros(len(points), bool), np.zeros(len(points), bool)
    for ring in rings:
        for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
            x, y = points.T
            across = (a[1] > y) != (b[1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= across & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
            off = np.abs(_cross(b - a, points - a)) <= 1e-9 * max(1.0, float(np.abs([a, b]).max())) * max(1e-12, float(np.hypot(*(b - a))))
            on |= off & (points >= np.minimum(a, b) - 1e-9).all(1) & (points <= np.maximum(a, b) + 1e-9).all(1)
    return out & ~on


RING = "array<struct<x: double, y: double>>"
CUTLINES = f"sheet_id string, ring {RING}, area double, holes int, problem string"


def _rings(column: pa.Array) -> Rings:
    """Rings of an Arrow column without their ends repeated, a group a row."""
    x, y = (c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten())
    points, sizes = np.column_stack([x, y]).astype(float), column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    last = np.cumsum(sizes) - 1
    closed = sizes > 1
    closed[closed] = (points[(last - sizes + 1)[closed]] == points[last[closed]]).all(1)
    kept = np.ones(len(points), bool)
    kept[last[closed]] = False
    return Rings(points[kept], sizes - closed, np.arange(len(sizes)))


def _column(rings: Rings) -> pa.Array:
    """Rings as an Arrow column, their ends repeated."""
    ends = np.cumsum(rings.sizes + 1)
    at = np.arange(len(rings.points) + len(rings.sizes)) - np.repeat(np.arange(len(rings.sizes)), rings.sizes + 1)
    at[ends - 1] = rings.starts
    points = pa.StructArray.from_arrays([pa.array(rings.points[at, k]) for k in (0, 1)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), points)


def _sheets(batches: Iterator[pa.RecordBatch], curves: bool) -> Iterator[tuple[pa.Array, Rings]]:
    """Ids of whole sheets and their rings (groups are places among the ids) from batches (sheet_id, ring) sorted by sheet.

    As `curves` rings are counter-clockwise, and of a sheet with very many of them what they enclose together comes instead.
    """
    last, open_, least = None, [], EDGES  # the sheet that may go on, and its rings so far
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        ids, ends = runs.values, runs.run_ends.to_numpy()
        rings = _rings(batch.column(1))
        rings = Rings(rings.points, rings.sizes, np.searchsorted(ends, rings.group, "right"))
        rings = _curves(rings) if curves else rings
        if last is not None and last.equals(ids[:1]):
            rings = Rings.joined([*open_, rings])
        elif last is not None:
            yield last, Rings.joined(open_)
            least = EDGES
        if len(ids) > 1:
            yield ids[:-1], rings.within(0, len(ids) - 1)
            least = EDGES
        own = rings.within(len(ids) - 1, len(ids))
        own = Rings(own.points, own.sizes, np.zeros_like(own.group))
        if curves and len(own.points) > least:
            own = _faces(own, True)
            least = max(EDGES, 2 * len(own.points))
        last, open_ = ids[-1:], [own]
    if last is not None:
        yield last, Rings.joined(open_)


def _measures(area: Rings, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Areas and numbers of holes of n groups."""
    doubled = area.areas()
    return np.bincount(area.group, doubled, n) / 2, np.bincount(area.group, doubled < 0, n).astype(np.int32)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by a key to as many tasks as a shuffle has, however small they are: work on rings costs far more than moving them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cutlines(corners: DataFrame, extra: DataFrame) -> DataFrame:
    """The cutline of every sheet: its corners (sheet_id, ring) united with its further rings (sheet_id, ring; any number).

    Returns sheet_id, ring (closed, whole pixels), area and holes of the exact union, and a problem
    (then without a ring) where the union is not one polygon.  Rings of a sheet meet in one task; a null
    ring, and one of fewer than three points, encloses nothing.
    """
    both = corners.select("sheet_id", "ring", F.lit(0).alias("ord")).unionByName(extra.select("sheet_id", "ring", F.lit(1).alias("ord")))
    clean = both.where("ring is not null").select(F.col("sheet_id").cast("string").alias("sheet_id"), F.col("ring").cast(RING).alias("ring"), "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rings in _sheets(batches, False):
            united = unions(rings)
            area, holes = _measures(united, len(ids))
            found, place, problems = [], [], []
            for k in range(len(ids)):
                try:
                    found.append(cutline(rings.within(k, k + 1).split(), united.within(k, k + 1).split()))
                    place.append(len(found) - 1)
                    problems.append(None)
                except NotOnePolygon as e:
                    place.append(None)
                    problems.append(str(e))
            yield pa.RecordBatch.from_arrays([ids, _column(Rings.of(found)).take(pa.array(place, pa.int64())), pa.array(area), pa.array(holes), pa.array(problems, pa.string())], names=["sheet_id", "ring", "area", "holes", "problem"])

    return spread(clean, "sheet_id").sortWithinPartitions("sheet_id", "ord", "ring").drop("ord").mapInArrow(run, CUTLINES)


def union_areas(shapes: DataFrame, ring: Column) -> DataFrame:
    """sheet_id, area and holes of the union of every sheet's rings, without their cutline.

    `ring` is an expression over the columns of shapes (with sheet_id), made only after rows have moved; a null
    one has no part.  Sheets are sorted and stream by: a task holds the rings of a batch, and of a sheet that
    is larger than that what its rings so far enclose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rings in _sheets(batches, True):
            area, holes = _measures(_faces(rings, True), len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(area), pa.array(holes)], names=["sheet_id", "area", "holes"])

    sorted_ = spread(shapes, "sheet_id").sortWithinPartitions("sheet_id")
    made = sorted_.select(F.col("sheet_id").cast("string").alias("sheet_id"), ring.cast(RING).alias("ring")).where("ring is not null")
    return made.mapInArrow(run, "sheet_id string, area double, holes int")


def buffered(rings: DataFrame, by: str, *carried: str) -> DataFrame:
    """sheet_id and parts (array of closed rings) of rings (sheet_id, ring, and a column with the shift) with mitred corners, and the columns that are carried along; no parts if nothing is left.

    Rings are widened where they are; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = buffers(_rings(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(float))
                ends = np.concatenate(([0], np.cumsum(np.bincount(found.group, minlength=batch.num_rows))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(found)), *batch.columns[3:]], names=["sheet_id", "parts", *carried])

    clean = rings.where("ring is not null").select(F.col("sheet_id").cast("string").alias("sheet_id"), F.col("ring").cast(RING).alias("ring"), F.col(by).cast("double").alias("_by"), *carried)
    more = "".join(f", `{c}` {clean.schema[c].dataType.simpleString()}" for c in carried)
    return clean.mapInArrow(run, f"sheet_id string, parts array<{RING}>{more}")
