"""Tile stores: versioned Parquet tables partitioned by zoom, and foreign z/x/y folders."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values
FORMATS = {"webp": "webp", "jpg": "jpeg", "jpeg": "jpeg", "png": "png"}


def tile_format(extension: str) -> str:
    if extension not in FORMATS:
        raise ValueError(f"unknown tile extension {extension}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[extension]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """z, x, y and the other columns of a store's last version; a filter on z reads only that zoom's files.

    A folder without versions is read as a plain Parquet table.
    """
    found = _versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/v{max(found)}" if found else path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in fs.listStatus(at)] if fs.exists(at) else []
    return [int(name[1:]) for name in names if re.fullmatch(r"v\d+", name)]


def write_store(tiles: DataFrame, path: str) -> None:
    """Write a new version; one rename makes it visible, so a reader always finds a whole store and a failed run changes nothing.

    The version before stays for those who still read it; older ones are deleted.
    """
    spark = tiles.sparkSession
    root = path.rstrip("/")
    fresh = f"{root}/_new-{uuid.uuid4().hex}"
    tiles.repartition("z", "x").sortWithinPartitions("x", "y").write.partitionBy("z").parquet(fresh)
    jvm = spark.sparkContext._jvm
    before = _versions(spark, path)
    new, at = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(f"{root}/v{max(before, default=0) + 1}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the rename of FileContext fails where that of FileSystem would move the folder into the other writer's
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, at, how)
    except Py4JJavaError as error:
        fs.delete(new, True)
        if "FileAlreadyExists" in str(error.java_exception):
            raise RuntimeError(f"another writer made {at} meanwhile") from error
        raise
    for old in sorted(before)[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/v{old}"), True)


def read_folder(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """z, x, y, data of a z/x/y.ext folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder)
    part = lambda n: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.[^/]*$", n)
    return rows.select(part(1).cast("int").alias("z"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"), F.col("content").alias("data"))


def metadata(tiles: DataFrame, name: str, description: str, attribution: str, extension: str, version: str = "1") -> DataFrame:
    """One row `value`: the tile set's metadata as JSON."""
    kind = F.lit(tile_format(extension))
    zooms = tiles.agg(F.min("z").cast("int").alias("lo"), F.max("z").cast("int").alias("hi"))
    return zooms.select(metadata_json(F.lit(name), F.lit(description), F.lit(attribution), kind, F.lit(version), F.col("lo"), F.col("hi")).alias("value"))


def metadata_json(name: Column, description: Column, attribution: Column, kind: Column, version: Column, min_zoom: Column, max_zoom: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("baselayer").alias("type"), kind.alias("format"), attribution.alias("attribution"), description.alias("description"), name.alias("name"), version.alias("version"), max_zoom.alias("maxzoom"), min_zoom.alias("minzoom")
        )
    )


def absolute_sources(text: Column, folder: str) -> Column:
    """Make the relative source paths of a virtual mosaic's XML absolute."""
    return F.regexp_replace(text, r'<SourceFilename relativeToVRT="1">(.*)</SourceFilename>', f'<SourceFilename relativeToVRT="0">{folder}/$1</SourceFilename>')
