"""Scanned images as block-free rasters: (sheet_id, height, width, data) with BGR bytes, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .listing import sheet_id_of


def _bgr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = []
        for channels, raw in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, channels)
            data.append((np.repeat(own, 3, 1) if channels == 1 else own[:, :3]).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(data, pa.binary())], names=["sheet_id", "height", "width", "data"])


def read_images(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Images that the JVM decodes (png, jpeg, gif, bmp), as BGR: grey ones get three equal channels, alpha is left out.  See also image_problems."""
    images = _images(spark, folder, extension).where("image.nChannels > 0")
    other = images.where("image.nChannels <> 3").select("sheet_id", "image.height", "image.width", "image.nChannels", "image.data")
    return images.where("image.nChannels = 3").select("sheet_id", "image.height", "image.width", "image.data").unionByName(other.mapInArrow(_bgr, "sheet_id string, height int, width int, data binary"))


def image_problems(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """sheet_id and problem of the files that cannot be decoded."""
    return _images(spark, folder, extension).where("image.nChannels <= 0 or image is null").select("sheet_id", F.lit("not a readable image").alias("problem"))


def _images(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    rows = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", f"*{extension}").load(folder)
    return rows.select(sheet_id_of(F.col("image.origin"), extension).alias("sheet_id"), "image")


def best_version(spark: SparkSession, versions: list[tuple[DataFrame, int]]) -> DataFrame:
    """Of several images of a sheet (image frames with a priority, 0 first) the one with the least priority."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [df.withColumn("_p", F.lit(p)) for df, p in versions])
    rest = [c for c in every.columns if c not in ("sheet_id", "_p")]
    return every.groupBy("sheet_id").agg(F.min_by(F.struct(*rest), "_p").alias("_v")).select("sheet_id", "_v.*")


def pixels(images: DataFrame) -> DataFrame:
    """sheet_id, r, c, b, g, r_ of every pixel; for small images and tests."""
    n = F.col("height") * F.col("width")
    at = images.select("sheet_id", "width", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), (3 * F.col("i") + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return at.select("sheet_id", F.floor(F.col("i") / F.col("width")).cast("long").alias("r"), (F.col("i") % F.col("width")).cast("long").alias("c"), byte(0).alias("blue"), byte(1).alias("green"), byte(2).alias("red"))
