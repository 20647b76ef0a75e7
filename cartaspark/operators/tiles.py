"""Tile images: mosaics of sheets, overviews, transparency, encoding.

A tile is a row (z, x, y, data: size x size BGRA bytes).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import jpeg

KEY = ["z", "x", "y"]
TILE = "z int, x long, y long, data binary"


def mosaic(parts: DataFrame, priority: DataFrame | None = None, size: int = 256) -> DataFrame:
    """Paint the sheets' parts (sheet_id, z, x, y, data) of each tile over each other; the highest priority, then the largest id, on top.

    Rows are sorted by tile and painted one after the other, so a tile under any number of sheets
    needs the memory of one.
    """
    ranked = parts.select("sheet_id", *KEY, "data")
    ranked = ranked.join(priority.select("sheet_id", "prio"), "sheet_id", "left") if priority is not None else ranked.withColumn("prio", F.lit(0))
    dealt = ranked.repartition(*KEY).sortWithinPartitions(*KEY, F.coalesce("prio", F.lit(0)), "sheet_id").select(*KEY, "data")

    def paint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, image = None, None
        for frame in frames:
            out = []
            for z, x, y, data in frame.itertuples(index=False):
                if (z, x, y) != key:
                    if key:
                        out.append((*key, image.tobytes()))
                    key, image = (z, x, y), np.zeros((size, size, 4), np.uint8)
                part = np.frombuffer(data, np.uint8).reshape(size, size, 4)
                on = part[..., 3] > 0
                image[on] = part[on]
            yield pd.DataFrame(out, columns=[*KEY, "data"])
        if key:
            yield pd.DataFrame([(*key, image.tobytes())], columns=[*KEY, "data"])

    return dealt.mapInPandas(paint, TILE)


def halving(size: int, resampling: str) -> np.ndarray:
    """The weights (size x 2 size) with which a row of 2 size pixels becomes one of size: mean of two, or Lanczos with three lobes."""
    if resampling == "mean":
        return np.repeat(np.eye(size), 2, 1) / 2
    if resampling != "lanczos":
        raise ValueError(f"unknown resampling {resampling}; known: mean, lanczos")
    away = (np.arange(2 * size)[None, :] - (2 * np.arange(size)[:, None] + 0.5)) / 2
    weights = np.where(np.abs(away) < 3, np.sinc(away) * np.sinc(away / 3), 0)
    return weights / weights.sum(1, keepdims=True)


def overview_tiles(tiles: DataFrame, size: int = 256, resampling: str = "mean") -> DataFrame:
    """Parent tiles of all given tiles, colours weighted by alpha; missing children are transparent.

    Like the children of a tile, its kernel ends at the tile's edge.
    """
    weights = halving(size, resampling)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((2 * size, 2 * size, 4))
        for x, y, data in zip(rows["x"], rows["y"], rows["data"], strict=True):
            r, c = (int(y) & 1) * size, (int(x) & 1) * size
            whole[r : r + size, c : c + size] = np.frombuffer(data, np.uint8).reshape(size, size, 4)
        whole[..., :3] *= whole[..., 3:]
        small = np.einsum("ir,rck,jc->ijk", weights, whole, weights, optimize=True)
        alpha = np.clip(small[..., 3:], 0, 255)
        colour = np.where(alpha > 0, small[..., :3] / np.maximum(alpha, 0.25), 0)
        out = np.rint(np.clip(np.concatenate([colour, alpha], -1), 0, 255)).astype(np.uint8)
        return pd.DataFrame([(*map(int, key), out.tobytes())], columns=[*KEY, "data"])

    up = tiles.select((F.col("z") - 1).cast("int").alias("pz"), F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py"), "x", "y", "data")
    return up.groupBy("pz", "px", "py").applyInPandas(merge, TILE)  # four children at most


def with_transparency(tiles: DataFrame) -> DataFrame:
    """Add is_transparent: no pixel has any alpha."""

    @F.pandas_udf("boolean")
    def clear(data: pd.Series) -> pd.Series:
        return data.map(lambda d: not np.frombuffer(d, np.uint8)[3::4].any())

    return tiles.withColumn("is_transparent", clear("data"))


def drop_transparent(tiles: DataFrame) -> DataFrame:
    return with_transparency(tiles).where(~F.col("is_transparent")).drop("is_transparent")


def png(image: np.ndarray) -> bytes:
    """A PNG of a BGRA image."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image[..., [2, 1, 0, 3]].reshape(h, -1)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_png(tiles: DataFrame, size: int = 256) -> DataFrame:
    """data as PNG files."""

    @F.pandas_udf("binary")
    def encoded(data: pd.Series) -> pd.Series:
        return data.map(lambda d: png(np.frombuffer(d, np.uint8).reshape(size, size, 4)))

    return tiles.withColumn("data", encoded("data"))


def encode_jpeg(tiles: DataFrame, quality: int | Column = 75, size: int = 256) -> DataFrame:
    """data as JPEG files; mask has a bit for each pixel, set where the tile is opaque, row by row, and is null where all are.

    JPEG has no alpha: pixels keep the colour that they have below it.  A quality may be a column.
    """

    @F.pandas_udf("struct<data binary, mask binary>")
    def encoded(data: pd.Series, quality: pd.Series) -> pd.DataFrame:
        out = []
        for raw, q in zip(data, quality, strict=True):
            image = np.frombuffer(raw, np.uint8).reshape(size, size, 4)
            on = image[..., 3] > 0
            out.append((jpeg.encode(image, int(q)), None if on.all() else np.packbits(on).tobytes()))
        return pd.DataFrame(out, columns=["data", "mask"])

    made = tiles.withColumn("_jpeg", encoded("data", F.lit(quality).cast("int") if isinstance(quality, int) else quality.cast("int")))
    return made.withColumn("data", F.col("_jpeg.data")).withColumn("mask", F.col("_jpeg.mask")).drop("_jpeg")
