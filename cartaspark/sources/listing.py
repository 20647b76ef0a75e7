"""Lists of sheets and folders of raster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_list(text: Column) -> Column:
    """Sheet ids of a list file's text: one a line, stripped, blanks dropped, every `.tif` removed, distinct."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\.tif", ""))
    return F.array_distinct(F.filter(lines, lambda s: s != ""))


def read_retile_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(parse_list(F.col("value"))).alias("sheet_id")).distinct()


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines of a list of raster paths, in their order (pos)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "path"))
    return rows.select("pos", F.trim("path").alias("path")).where("path <> ''")


def read_rasters(spark: SparkSession, folder: str | None = None, listed: list[str] | None = None, glob: str = "*.tif") -> DataFrame:
    """Raster files as bytes (path, length, content): a folder or a list of paths, not both."""
    if (folder is None) == (listed is None):
        raise ValueError("give either a folder or a list of paths")
    reader = spark.read.format("binaryFile")
    return reader.option("pathGlobFilter", glob).load(folder) if folder else reader.load(listed)


def sheet_id_of(path: Column, extension: str) -> Column:
    """File name without the extension; as a file name may hold it several times, every occurrence goes."""
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit(extension), F.lit(""))


def write_pull_list(files: DataFrame, path: str) -> None:
    """Names a line, sorted."""
    files.select("sheet_file").orderBy("sheet_file").coalesce(1).write.mode("overwrite").text(path)
