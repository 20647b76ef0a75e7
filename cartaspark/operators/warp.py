"""Sheets resampled to web tiles by the thin-plate spline of their control points, as a whole or block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .sheets import SheetOptions, _each, pixels_of

RADIUS = 6378137.0
TILE = "sheet_id string, z int, x long, y long, height int, width int, data binary"
NEED = "sheet_id string, z int, x long, y long, x0 int, y0 int, x1 int, y1 int, rows int, columns int, blocks array<struct<by:int,bx:int>>"
#: Side of the square blocks that images are cut into.
BLOCK = 512


def to_mercator(lonlat: np.ndarray) -> np.ndarray:
    lat = np.clip(lonlat[:, 1], -85.051129, 85.051129)
    return np.column_stack([np.radians(lonlat[:, 0]) * RADIUS, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * RADIUS])


class Placing:
    """Where the pixels of a sheet's tiles lie on its image of height x width."""

    def __init__(self, gcps, o: SheetOptions, height: int, width: int, zoom: int, size: int):
        world = 2 * np.pi * RADIUS
        self.height, self.width, self.size, self.cutlines = height, width, size, [np.array(ring, float) for ring in o.pixel_cutlines]
        pixel = np.array([[p["px"], p["py"]] for p in gcps])
        merc = to_mercator(np.array([[p["x"], p["y"]] for p in gcps]))
        n = size << zoom
        self.place = np.column_stack([(merc[:, 0] / world + 0.5) * n, (0.5 - merc[:, 1] / world) * n])
        self.spline = K.ThinPlateSpline(self.place, pixel)
        back = K.ThinPlateSpline(pixel, self.place) if self.cutlines else None
        reach = np.concatenate([self.place, *(back(ring) for ring in self.cutlines)])
        lo, hi = np.floor(reach.min(0) / size).astype(int), np.floor((reach.max(0) - 1e-9) / size).astype(int)
        self.tiles = [(tx, ty) for ty in range(lo[1], hi[1] + 1) for tx in range(lo[0], hi[0] + 1)]

    def pixels(self, tx: int, ty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x and y on the image of every pixel of a tile, and which of them lie on it."""
        yy, xx = np.mgrid[: self.size, : self.size]
        at = self.spline(np.column_stack([(xx + tx * self.size + 0.5).ravel(), (yy + ty * self.size + 0.5).ravel()]))
        px, py = at[:, 0].reshape(self.size, self.size), at[:, 1].reshape(self.size, self.size)
        return px, py, (px > -0.5) & (px < self.width - 0.5) & (py > -0.5) & (py < self.height - 0.5)

    def window(self, tx: int, ty: int, halo: int) -> tuple[int, int, int, int]:
        """Left, top, right, bottom (not included) of the part of the image that a tile's pixels are made of; empty where it has none."""
        px, py, on = self.pixels(tx, ty)
        if not on.any():
            return 0, 0, 0, 0
        x, y = px[on], py[on]
        return max(0, int(np.floor(x.min())) - halo + 1), max(0, int(np.floor(y.min())) - halo + 1), min(self.width, int(np.floor(x.max())) + halo + 1), min(self.height, int(np.floor(y.max())) + halo + 1)

    def paint(self, tx: int, ty: int, part: np.ndarray, x0: int, y0: int, method: str) -> bytes:
        """A tile (BGRA) from the part of the image whose upper left pixel is (x0, y0)."""
        px, py, on = self.pixels(tx, ty)
        size = self.size
        inside = K.fill_polygon(size, size, self.place - (tx * size + 0.5, ty * size + 0.5))
        if self.cutlines and part.size:
            more = np.zeros(part.shape[:2], bool)
            for ring in self.cutlines:
                more |= K.fill_polygon(*part.shape[:2], ring - (x0, y0))
            r, c = (np.clip(np.rint(v) - first, 0, k - 1).astype(int) for v, first, k in ((py, y0, part.shape[0]), (px, x0, part.shape[1])))
            inside |= more[r, c]
        inside &= on
        tile = np.zeros((size, size, 4), np.uint8)
        if inside.any():
            tile[inside, :3] = K.sample(part, px[inside] - x0, py[inside] - y0, method)
            tile[inside, 3] = 255
        return tile.tobytes()


def warp_to_tiles(images: DataFrame, gcps: DataFrame, zoom: int, size: int = 256) -> DataFrame:
    """Every sheet resampled to the web tiles that it touches: sheet_id, z, x, y, height, width, data (BGRA).

    Pixels outside both the ring of control points and the sheet's `pixel_cutlines` (rings on the upright
    image) are transparent, and so are tiles' parts off the image.  A task holds a sheet and its tiles;
    see warp_blocks for large sheets.
    """

    def work(row):
        o, image = SheetOptions.of(getattr(row, "extra", None)), pixels_of(row)
        at = Placing(row.gcps, o, *image.shape[:2], zoom, size)
        return [(row.sheet_id, zoom, tx, ty, size, size, at.paint(tx, ty, image, 0, 0, o.warp_resampling_method)) for tx, ty in at.tiles]

    return _each(images.join(gcps, "sheet_id"), TILE, work)


def cut_blocks(images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Images (sheet_id, height, width, data) as blocks: sheet_id, by, bx, rows, columns, data.  Those at the right and the bottom may be smaller."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                image = pixels_of(row)
                for top in range(0, image.shape[0], block):  # one strip of blocks at a time
                    strip = [image[top : top + block, left : left + block] for left in range(0, image.shape[1], block)]
                    yield pd.DataFrame([(row.sheet_id, top // block, k, *part.shape[:2], part.tobytes()) for k, part in enumerate(strip)], columns=["sheet_id", "by", "bx", "rows", "columns", "data"])

    return images.select("sheet_id", "height", "width", "data").mapInPandas(run, "sheet_id string, by int, bx int, rows int, columns int, data binary")


def tile_needs(sheets: DataFrame, gcps: DataFrame, zoom: int, size: int = 256, block: int = BLOCK) -> DataFrame:
    """The tiles of each sheet (sheet_id, height, width, extra) with the window and the blocks of its image that they are made of; no pixel is read."""

    def work(row):
        o = SheetOptions.of(row.extra)
        at, halo = Placing(row.gcps, o, int(row.height), int(row.width), zoom, size), K.reach(o.warp_resampling_method)
        out = []
        for tx, ty in at.tiles:
            x0, y0, x1, y1 = at.window(tx, ty, halo)
            blocks = [{"by": by, "bx": bx} for by in range(y0 // block, -(-y1 // block)) for bx in range(x0 // block, -(-x1 // block))]
            out.append((row.sheet_id, zoom, tx, ty, x0, y0, x1, y1, int(row.height), int(row.width), blocks))
        return out

    return _each(sheets.select("sheet_id", "height", "width", "extra").join(gcps, "sheet_id"), NEED, work)


def warp_blocks(images: DataFrame, gcps: DataFrame, zoom: int, size: int = 256, block: int = BLOCK) -> DataFrame:
    """The rows of warp_to_tiles, tile by tile: a sheet's tiles are made in parallel from the blocks that each needs.

    Which blocks those are follows from sizes and control points.  A task that makes tiles holds one tile
    and its window of the image, however large the sheet is.  A sheet is read twice, its pixels once.
    """
    sized = images if "extra" in images.columns else images.withColumn("extra", F.lit(None).cast("string"))
    need = tile_needs(sized, gcps, zoom, size, block)
    known = sized.select("sheet_id", "extra").join(gcps.select("sheet_id", "gcps"), "sheet_id")
    wanted = need.select("*", F.explode_outer("blocks").alias("b")).select("sheet_id", "z", "x", "y", "x0", "y0", "x1", "y1", F.col("rows").alias("height"), F.col("columns").alias("width"), "b.by", "b.bx")
    met = wanted.join(cut_blocks(images, block), ["sheet_id", "by", "bx"], "left").join(known, "sheet_id")

    def paint(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        first = parts.iloc[0]
        o = SheetOptions.of(first["extra"])
        x0, y0, x1, y1 = (int(first[c]) for c in ("x0", "y0", "x1", "y1"))
        window = np.zeros((y1 - y0, x1 - x0, 3), np.uint8)
        for by, bx, rows, columns, data in parts[["by", "bx", "rows", "columns", "data"]].itertuples(index=False):
            if data is None:  # a tile off the image
                continue
            part, top, left = np.frombuffer(data, np.uint8).reshape(int(rows), int(columns), 3), int(by) * block - y0, int(bx) * block - x0
            t, e = max(0, -top), max(0, -left)
            part = part[t : t + window.shape[0] - max(0, top), e : e + window.shape[1] - max(0, left)]
            window[top + t : top + t + part.shape[0], left + e : left + e + part.shape[1]] = part
        sheet, z, x, y = key
        at = Placing(first["gcps"], o, int(first["height"]), int(first["width"]), int(z), size)
        return pd.DataFrame([(sheet, int(z), int(x), int(y), size, size, at.paint(int(x), int(y), window, x0, y0, o.warp_resampling_method))], columns=["sheet_id", "z", "x", "y", "height", "width", "data"])

    return met.groupBy("sheet_id", "z", "x", "y").applyInPandas(paint, TILE)  # a tile's window at most
