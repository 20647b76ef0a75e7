"""Array kernels on single rasters (numpy), for work that has no good relational form."""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components by runs and union-find: labels from 1 in order of their first pixel, and their number."""
    h, w = mask.shape
    out = np.zeros((h, w), np.int32)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for r in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (mask[r] != 0).astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            own = 0
            for c, d, k in before:
                if c <= b and a <= d:  # runs touch over an edge or a corner
                    k = root(k)
                    if own and own != k:
                        parent[max(own, k)] = min(own, k)
                        own = min(own, k)
                    else:
                        own = k
            if not own:
                own = len(parent)
                parent.append(own)
            runs.append((a, b, own))
            out[r, a:b] = own
        before = runs
    roots = np.array([root(i) for i in range(len(parent))])
    kept, new = np.unique(roots[1:], return_inverse=True) if len(roots) > 1 else (np.zeros(0, int), np.zeros(0, int))
    table = np.concatenate(([0], new + 1)).astype(np.int32)
    return table[out], len(kept)


def boxes(labels: np.ndarray, n: int) -> np.ndarray:
    """x, y, w, h, number of pixels of each component."""
    r, c = np.nonzero(labels)
    k = labels[r, c]
    out = np.zeros((n, 5), np.int64)
    for j, (v, f) in enumerate(((c, np.minimum), (r, np.minimum), (c, np.maximum), (r, np.maximum))):
        edge = np.full(n + 1, np.iinfo(np.int64).max if f is np.minimum else -1)
        f.at(edge, k, v)
        out[:, j] = edge[1:]
    out[:, 2:4] += 1 - out[:, :2]
    out[:, 4] = np.bincount(k, minlength=n + 1)[1:]
    return out


def _windowed(a: np.ndarray, size: int, axis: int, f) -> np.ndarray:
    neutral = a.max(initial=0) if f is np.min else a.min(initial=0)
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - 1 - size // 2)
    return f(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=neutral), size, axis), axis=-1)


def erode(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _windowed(_windowed(mask, width, 1, np.min), height, 0, np.min)


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _windowed(_windowed(mask, width, 1, np.max), height, 0, np.max)


def median_blur(a: np.ndarray, size: int) -> np.ndarray:
    """Median over a square of odd size; the border mirrors without repeating the edge."""
    if size % 2 == 0:
        raise ValueError("the size must be odd")
    if a.ndim == 3:
        return np.stack([median_blur(a[..., k], size) for k in range(a.shape[2])], -1)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, size // 2, mode="reflect"), (size, size))
    return np.median(windows.reshape(*a.shape, -1), axis=-1).astype(a.dtype)


def bgr_to_hsv(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = high - low
    safe = np.where(span == 0, 1, span)
    turn = np.where(high == r, 60 * (g - b) / safe, np.where(high == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    turn = np.where(span == 0, 0, np.where(turn < 0, turn + 360, turn))
    h = np.rint(turn / 2)
    s = np.where(high == 0, 0, np.rint(255 * span / np.where(high == 0, 1, high)))
    return np.stack([np.where(h >= 180, h - 180, h), s, high], -1).astype(np.uint8)


def colour_mask(image: np.ndarray, colour: str | list[str], ranges: dict) -> np.ndarray:
    """0 or 255 for each pixel; see functions.colour.in_colour."""
    if not isinstance(colour, str):
        return np.maximum.reduce([colour_mask(image, c, ranges) for c in colour])
    name = colour.removeprefix("not_")
    if name not in ranges:
        raise ValueError(f"unknown colour {name}")
    hsv, (lower, upper) = bgr_to_hsv(image), ranges[name]
    within = ((hsv >= np.array(lower)) & (hsv <= np.array(upper))).all(-1)
    return np.where(within != (name != colour), 255, 0).astype(np.uint8)


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average to a smaller size: every source pixel counts by the share of it that a target pixel covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * (n / m)
        cell = np.arange(n)
        overlap = np.minimum(edge[1:, None], cell[None] + 1) - np.maximum(edge[:-1, None], cell[None])
        return np.clip(overlap, 0, None) / (n / m)

    rows, cols = weights(image.shape[0], height), weights(image.shape[1], width)
    flat = image.astype(np.float64).reshape(*image.shape[:2], -1)
    out = np.einsum("ar,rck->ack", rows, flat)
    out = np.einsum("bc,ack->abk", cols, out)
    return np.rint(out).astype(image.dtype).reshape(height, width, *image.shape[2:])


#: Resampling methods: pixels on each side that a value is made of.
REACH = {"nearest": 1, "bilinear": 1, "cubic": 2, "lanczos": 3}


def reach(method: str) -> int:
    if method not in REACH:
        raise ValueError(f"unknown resampling method {method}; known: {', '.join(REACH)}")
    return REACH[method]


def weights(method: str, away: np.ndarray) -> np.ndarray:
    """Weight of a pixel at a distance along one axis: cubic convolution (a = -1/2) or Lanczos with three lobes."""
    d = np.abs(away)
    if method == "cubic":
        return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0))
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0)


def convolved(image: np.ndarray, x: np.ndarray, y: np.ndarray, method: str, fill: float) -> np.ndarray:
    """sample() by a separable kernel; pixels off the image have no weight, places off it are `fill`."""
    h, w = image.shape[:2]
    r, tail = reach(method), (1,) * (image.ndim - 2)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    total, mass = np.zeros((*x.shape, *image.shape[2:])), np.zeros(x.shape)
    for dy in range(1 - r, r + 1):
        wy = weights(method, y - (y0 + dy))
        for dx in range(1 - r, r + 1):
            xi, yi, share = x0 + dx, y0 + dy, wy * weights(method, x - (x0 + dx))
            ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            total[ok] += image[yi[ok], xi[ok]] * share[ok].reshape(-1, *tail)
            mass[ok] += share[ok]
    on = (x > -0.5) & (x < w - 0.5) & (y > -0.5) & (y < h - 0.5)
    out = np.where(on.reshape(*x.shape, *tail), total / np.where(on, mass, 1).reshape(*x.shape, *tail), fill)
    if np.issubdtype(image.dtype, np.integer):
        out = np.clip(np.rint(out), np.iinfo(image.dtype).min, np.iinfo(image.dtype).max)
    return out.astype(image.dtype)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = "bilinear", fill: float = 0) -> np.ndarray:
    """Values at fractional pixel places (pixel centres are whole numbers); outside is `fill`."""
    h, w = image.shape[:2]
    if method == "nearest":
        xi, yi = np.rint(x).astype(int), np.rint(y).astype(int)
        ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
        out = np.full((*x.shape, *image.shape[2:]), fill, image.dtype)
        out[ok] = image[yi[ok], xi[ok]]
        return out
    if reach(method) > 1:
        return convolved(image, x, y, method, fill)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    total = np.zeros((*x.shape, *image.shape[2:]))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            value = np.full((*x.shape, *image.shape[2:]), float(fill))
            value[ok] = image[yi[ok], xi[ok]]
            weight = np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0))
            total += value * (weight[..., None] if image.ndim == 3 else weight)
    return np.rint(total).astype(image.dtype)


def rotate(image: np.ndarray, degrees: float, fill: float = 255) -> np.ndarray:
    """Turn counter-clockwise on a canvas that holds all of the image."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[:nh, :nw]
    dx, dy = xx - nw / 2, yy - nh / 2
    return sample(image, c * dx - s * dy + w // 2, s * dx + c * dy + h // 2, fill=fill)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise where y grows upwards (Andrew's monotone chain)."""
    p = np.unique(points.reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p.tolist()) + half(p[::-1].tolist()))


def min_area_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(four corners, angle in degrees in [0, 90)) of the smallest enclosing rectangle, by turning callipers."""
    ring = hull(points).astype(float)
    if len(ring) < 3:
        return np.repeat(ring[:1], 4, 0), 0.0
    edge = np.roll(ring, -1, 0) - ring
    turns = np.unique(np.mod(np.arctan2(edge[:, 1], edge[:, 0]), np.pi / 2))
    best = None
    for a in turns:
        m = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = ring @ m.T
        lo, hi = q.min(0), q.max(0)
        area = np.prod(hi - lo)
        if best is None or area < best[0] - 1e-9:
            best = (area, a, np.array([lo, (hi[0], lo[1]), hi, (lo[0], hi[1])]) @ m)
    return best[2], float(np.degrees(best[1]))


def simplify(ring: np.ndarray, factor: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring (its end not repeated) with tolerance factor * perimeter."""
    ring = np.asarray(ring, float)
    if len(ring) < 3:
        return ring
    tolerance = factor * np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()

    def keep(a: int, b: int, out: list[int]) -> None:
        stack = [(a, b)]
        while stack:
            i, j = stack.pop()
            if j - i < 2:
                continue
            p, q = ring[i % len(ring)], ring[j % len(ring)]
            d = q - p
            mid = ring[np.arange(i + 1, j) % len(ring)] - p
            length = np.hypot(*d)
            far = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / length if length else np.hypot(*mid.T)
            k = int(far.argmax())
            if far[k] > tolerance:
                out.append((i + 1 + k) % len(ring))
                stack += [(i, i + 1 + k), (i + 1 + k, j)]

    start = int(np.hypot(*(ring - ring[0]).T).argmax())
    kept = [0, start]
    keep(0, start, kept)
    keep(start, len(ring), kept)
    return ring[sorted(set(kept))]


def fill_polygon(height: int, width: int, ring: np.ndarray) -> np.ndarray:
    """Even-odd fill over pixel centres."""
    out = np.zeros((height, width), bool)
    p = np.asarray(ring, float)
    q = np.roll(p, -1, 0)
    cols = np.arange(width)
    for r in range(height):
        across = (p[:, 1] > r) != (q[:, 1] > r)
        if across.any():
            a, b = p[across], q[across]
            xs = np.sort((b[:, 0] - a[:, 0]) * (r - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
            out[r] = (np.searchsorted(xs, cols, "right") % 2) == 1
    return out


def offset_ring(ring: np.ndarray, by: float) -> np.ndarray:
    """Mitre offset of a simple ring (its end not repeated); over 0 outwards."""
    p = np.asarray(ring, float)
    nxt = np.roll(p, -1, 0)
    area = (p[:, 0] * nxt[:, 1] - nxt[:, 0] * p[:, 1]).sum()
    d = nxt - p
    d /= np.maximum(np.hypot(*d.T), 1e-12)[:, None]
    normal = np.stack([d[:, 1], -d[:, 0]], 1) * np.sign(area)
    before = np.roll(normal, 1, 0)
    bisector = normal + before
    scale = by * 2 / np.maximum((bisector**2).sum(1), 1e-12)
    return p + bisector * scale[:, None]


class ThinPlateSpline:
    """Exact at its control points; affine where there are three points."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        self.source = np.asarray(source, float)
        n = len(self.source)
        self.centre, self.scale = self.source.mean(0), max(1e-12, np.ptp(self.source, axis=0).max())
        s = (self.source - self.centre) / self.scale
        self.s = s
        a = np.zeros((n + 3, n + 3))
        a[:n, :n] = self._kernel(s, s)
        a[:n, n:] = np.column_stack([np.ones(n), s])
        a[n:, :n] = a[:n, n:].T
        b = np.zeros((n + 3, 2))
        b[:n] = target
        self.weights = np.linalg.lstsq(a, b, rcond=None)[0]

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
        return np.where(d2 > 0, d2 * np.log(np.where(d2 > 0, d2, 1)), 0)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        q = (np.asarray(points, float).reshape(-1, 2) - self.centre) / self.scale
        return self._kernel(q, self.s) @ self.weights[: len(self.s)] + np.column_stack([np.ones(len(q)), q]) @ self.weights[len(self.s) :]


def remove_line(image: np.ndarray, line: tuple, line_buffer: float, blur_buffer: float, kernel: float, repeat: int) -> np.ndarray:
    """Replace the pixels around a segment by a median blur of its strip; ratios are of the image's width."""
    h, w = image.shape[:2]
    rl, rb = round(line_buffer * w), round(blur_buffer * w)
    size = max(1, round(kernel * w)) | 1
    (x1, y1), (x2, y2) = line
    d = np.array([x2 - x1, y2 - y1], float)
    length = np.hypot(*d)
    if length == 0:
        return image
    n = np.array([-d[1], d[0]]) / length

    def band(radius: float) -> np.ndarray:
        return np.array([(x1, y1) + n * radius, (x2, y2) + n * radius, (x2, y2) - n * radius, (x1, y1) - n * radius])

    outer = band(rb)
    lo, hi = np.maximum(np.floor(outer.min(0)).astype(int), 0), np.minimum(np.ceil(outer.max(0)).astype(int) + 1, (w, h))
    if (hi <= lo).any():
        return image
    strip = image[lo[1] : hi[1], lo[0] : hi[0]]
    mask = fill_polygon(strip.shape[0], strip.shape[1], band(rl) - lo)
    if not mask.any():
        return image
    pad = size // 2
    # reflected once beyond its sides, so that a strip thinner than the kernel is blurred as well
    blurred = np.pad(strip, ((pad, pad), (pad, pad), *[(0, 0)] * (strip.ndim - 2)), mode="reflect" if min(strip.shape[:2]) > 1 else "edge")
    for _ in range(1 + repeat):
        blurred = median_blur(blurred, size)
    blurred = blurred[pad : pad + strip.shape[0], pad : pad + strip.shape[1]]
    out = image.copy()
    out[lo[1] : hi[1], lo[0] : hi[0]][mask] = blurred[mask]
    return out


def inpaint(image: np.ndarray, rings: list, colour: tuple[int, int, int]) -> np.ndarray:
    """Fill polygons with a BGR colour."""
    out = image.copy()
    for ring in rings:
        out[fill_polygon(image.shape[0], image.shape[1], np.asarray(ring))] = colour
    return out


def line_mask(mask: np.ndarray, along: str, scale: int, iterations: int = 0) -> np.ndarray:
    """Opening with a line of dim // scale pixels, then dilation."""
    size = max(1, mask.shape[1 if along == "c" else 0] // scale)
    shape = (1, size) if along == "c" else (size, 1)
    out = dilate(erode(mask, *shape), *shape)
    for _ in range(iterations):
        out = dilate(out, *shape)
    return out


def intersections(mask: np.ndarray, scale: int, iterations: int = 0) -> list[tuple[int, int]]:
    """Centres (x, y) of where horizontal and vertical lines cross, strictly inside the image."""
    both = (line_mask(mask, "c", scale, iterations) > 0) & (line_mask(mask, "r", scale, iterations) > 0)
    labels, n = label(both)
    h, w = mask.shape
    found = [((2 * x + bw) // 2, (2 * y + bh) // 2) for x, y, bw, bh, _ in boxes(labels, n).tolist()]
    return [(x, y) for x, y in found if 0 < x < w - 1 and 0 < y < h - 1]
