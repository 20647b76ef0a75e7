"""Baseline JPEG of BGR images as array work: cosine transform by blocks, quality tables, Huffman codes made for the image.

Colour planes are halved both ways, as encoders do by default.  Meant for tiles and shrunk images: coding
takes 70 to 110 bytes of memory a pixel (noise at quality 100: 280), the round trip 90.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# fixed values of the standard: quantisation at quality 50, row by row, for luminance and colour
LUMINANCE = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
COLOUR = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
# fixed values: luminance and two colour differences of red, green and blue
TO_PLANES = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

#: Places of a block (8 r + c) along its diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_u, _r = np.mgrid[:8, :8]
COSINES = np.where(_u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _r + 1) * _u * np.pi / 16)


def tables(quality: int) -> np.ndarray:
    """The quantisation of luminance and colour (2 x 64, row by row) at a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError(f"quality {quality} is not between 1 and 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    base = np.array([t.split() for t in (LUMINANCE, COLOUR)], int)
    return np.clip((base * scale + 50) // 100, 1, 255)


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised cosine coefficients (blocks down, blocks across, 64 in zigzag order) of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).astype(np.float64) - 128
    waves = np.einsum("ur,arbc,vc->abuv", COSINES, blocks, COSINES, optimize=True).reshape(h // 8, w // 8, 64)
    return np.rint(np.round(waves / table, 6)).astype(np.int32)[..., ZIGZAG]


def plane_of(quantised: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The plane (uint8) that quantised coefficients stand for."""
    waves = np.empty(quantised.shape)
    waves[..., ZIGZAG] = quantised
    waves = (waves * table).reshape(*quantised.shape[:2], 8, 8)
    plane = np.einsum("ur,abuv,vc->arbc", COSINES, waves, COSINES, optimize=True)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8).reshape(8 * quantised.shape[0], -1)


def _planes(image: np.ndarray, quality: int) -> list[np.ndarray]:
    """Quantised luminance and colour differences; sides are filled up to multiples of 16 with the edge's pixels."""
    h, w = image.shape[:2]
    whole = np.pad(image[..., :3], ((0, -h % 16), (0, -w % 16), (0, 0)), "edge")[..., ::-1] @ TO_PLANES.T
    light, *colours = np.moveaxis(whole, -1, 0)
    halved = [c.reshape(c.shape[0] // 2, 2, -1, 2).mean((1, 3)) + 128 for c in colours]
    own = tables(quality)
    return [coefficients(np.clip(np.rint(p), 0, 255), own[min(k, 1)]) for k, p in enumerate([light, *halved])]


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice the size both ways; a pixel takes three quarters of the one it lies in and a quarter of the next."""
    for axis in (0, 1):
        own = np.moveaxis(plane.astype(np.float64), axis, 0)
        before, after = np.concatenate([own[:1], own[:-1]]), np.concatenate([own[1:], own[-1:]])
        both = np.stack([0.75 * own + 0.25 * before, 0.75 * own + 0.25 * after], 1)
        plane = np.moveaxis(both.reshape(-1, *own.shape[1:]), 0, axis)
    return plane


def round_trip(image: np.ndarray, quality: int) -> np.ndarray:
    """The BGR image that remains after coding and decoding."""
    h, w = image.shape[:2]
    own = tables(quality)
    light, *colours = (plane_of(q, own[min(k, 1)]) for k, q in enumerate(_planes(image, quality)))
    colours = [_doubled(c[: (h + 1) // 2, : (w + 1) // 2])[:h, :w] - 128 for c in colours]
    whole = np.stack([light[:h, :w].astype(np.float64), *colours], -1) @ np.linalg.inv(TO_PLANES).T
    return np.clip(np.rint(whole[..., ::-1]), 0, 255).astype(np.uint8)


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths (16 at most) of the symbols that occur, such that a code of ones alone is free."""
    counts = np.append(counts, 0)
    while True:
        heap = [(int(counts[s]), int(s), (int(s),)) for s in [*np.flatnonzero(counts), len(counts) - 1]]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for _, s, _ in heap), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= 16:
            del depth[len(counts) - 1]
            return depth
        counts = np.where(counts > 0, np.maximum(counts // 2, 1), 0)


def _codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and their lengths by symbol, and the table as it is written to the file."""
    depth = _lengths(counts)
    order = sorted(depth, key=lambda s: (depth[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= depth[s] - last
        codes[s], sizes[s], last = code, depth[s], depth[s]
        code += 1
    return codes, sizes, bytes(np.bincount([depth[s] for s in order], minlength=17)[1:].tolist()) + bytes(order)


def _symbols(units: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of all blocks in the order of the scan: (Huffman table, symbol, bits that follow, their number).

    units: (n, 6, 64), four blocks of luminance and one of each colour.  Tables: 0 and 1 for the first
    coefficients of luminance and colour, 2 and 3 for the others.
    """
    blocks = units.reshape(-1, 64).copy()
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):  # the first coefficient is told by its difference from the block before
        first = units[:, part, 0]
        blocks.reshape(units.shape)[:, part, 0] = np.diff(first.ravel(), prepend=0).reshape(first.shape)
    n = len(blocks)
    colour = np.tile([0, 0, 0, 0, 1, 1], len(units))
    block, k = np.nonzero(blocks[:, 1:])
    k += 1
    value = blocks[block, k]
    before = np.where(np.diff(block, prepend=-1) == 0, np.concatenate([[0], k[:-1]]), 0)
    run = k - before - 1
    long = np.repeat(np.arange(len(run)), run // 16)  # runs of 16 zeros have a symbol of their own
    nth = np.arange(len(long)) - np.repeat(np.cumsum(run // 16) - run // 16, run // 16)
    full = np.full(n, 0)
    np.maximum.at(full, block, k)
    ended = np.flatnonzero(full < 63)
    width = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    first = blocks[:, 0]
    none = lambda m: np.zeros(m, np.int64)
    parts = [  # place in the scan, table, symbol, value, width
        (256 * np.arange(n), colour, width(first), first, width(first)),
        (256 * block + 4 * k, 2 + colour[block], (run % 16 << 4) + width(value), value, width(value)),
        (256 * block[long] + 4 * k[long] - 3 + nth, 2 + colour[block[long]], none(len(long)) + 0xF0, none(len(long)), none(len(long))),
        (256 * ended + 255, 2 + colour[ended], none(len(ended)), none(len(ended)), none(len(ended))),
    ]
    place, table, symbol, value, size = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    value = np.where(value < 0, value + (1 << size) - 1, value)
    return table[order], symbol[order], value[order], size[order]


def encode(image: np.ndarray, quality: int = 75) -> bytes:
    """A JPEG file of a BGR image (a fourth channel is left out); ValueError for images without pixels or over 65,535 pixels high or wide."""
    h, w = image.shape[:2]
    if not (1 <= h <= 65535 and 1 <= w <= 65535):
        raise ValueError(f"an image of {w} x {h} pixels is no JPEG")
    light, *colours = _planes(image, quality)
    down, across = colours[0].shape[:2]
    fours = light.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down * across, 4, 64)
    table, symbol, value, size = _symbols(np.concatenate([fours, *(c.reshape(-1, 1, 64) for c in colours)], 1))
    made = [_codes(np.bincount(symbol[table == t], minlength=256)) for t in range(4)]
    codes, lengths = np.stack([m[0] for m in made]), np.stack([m[1] for m in made])
    word, total = codes[table, symbol] << size | value, lengths[table, symbol] + size
    begin = np.cumsum(total) - total
    shift = np.repeat(begin + total - 1, total) - np.arange(int(total.sum()))
    bits = (np.repeat(word, total) >> shift & 1).astype(np.uint8)
    scan = np.packbits(np.pad(bits, (0, -len(bits) % 8), constant_values=1)).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])),
        *(part(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables(quality))),
        part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])),
        *(part(0xC4, bytes([t // 2 << 4 | t % 2]) + m[2]) for t, m in enumerate(made)),
        part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])), scan, b"\xff\xd9",
    ])
