"""GeoJSON bounds: FeatureCollections, one-feature files and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import envelope
from ..operators.bounds import feature_collection, feature_line, last_by_id

GEOMETRY = "struct<type:string, coordinates:array<array<array<double>>>>"


def _features(texts: DataFrame) -> DataFrame:
    """pos, sheet_id, digest, geom_json, props of the features of whole documents (column value)."""
    parsed = texts.select(F.try_parse_json("value").alias("doc"))
    listed = parsed.select(F.expr("coalesce(try_variant_get(doc, '$.features', 'array<variant>'), array(doc))").alias("features"))
    rows = listed.select(F.posexplode("features").alias("pos", "f"))
    return rows.select(
        "pos",
        F.expr("try_variant_get(f, '$.properties.id', 'string')").alias("sheet_id"),
        F.expr("try_variant_get(f, '$.properties.digest', 'string')").alias("digest"),
        F.expr("to_json(try_variant_get(f, '$.geometry', 'variant'))").alias("geom_json"),
        F.expr("to_json(try_variant_get(f, '$.properties', 'variant'))").alias("props"),
    )


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """sheet_id, digest, geom_json, props of a FeatureCollection; features without id are dropped, of equal ids the last counts."""
    return last_by_id(_features(spark.read.text(path, wholetext=True)), "pos")


def read_feature_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a folder of `.geojsonl` files that hold one document each; of equal ids the last file name counts."""
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.geojsonl").select("value", F.col("_metadata.file_path").alias("file"))
    rows = texts.select("file", F.try_parse_json("value").alias("f")).select(
        "file",
        F.expr("try_variant_get(f, '$.properties.id', 'string')").alias("sheet_id"),
        F.expr("try_variant_get(f, '$.properties.digest', 'string')").alias("digest"),
        F.expr("to_json(try_variant_get(f, '$.geometry', 'variant'))").alias("geom_json"),
        F.expr("to_json(try_variant_get(f, '$.properties', 'variant'))").alias("props"),
    )
    return last_by_id(rows, "file")


def read_boxes(spark: SparkSession, path: str, dummy: bool = False) -> DataFrame:
    """sheet_id, west, south, east, north of a FeatureCollection.

    With `dummy`, ids are dummy_0, dummy_1 ... in file order; otherwise a feature without id is an error.
    """
    rows = _features(spark.read.text(path, wholetext=True))
    if dummy:
        named = rows.withColumn("sheet_id", F.concat(F.lit("dummy_"), F.col("pos")))
    else:
        named = last_by_id(rows.withColumn("sheet_id", F.coalesce("sheet_id", F.raise_error(F.lit("feature without id")).cast("string"))), "pos")
    return boxes_of(named)


def boxes_of(features: DataFrame) -> DataFrame:
    """Boxes of the outer rings of polygon features (sheet_id, geom_json)."""
    ring = F.transform(F.get(F.from_json("geom_json", GEOMETRY)["coordinates"], F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return features.select("sheet_id", envelope(ring).alias("b")).select("sheet_id", "b.*")


def write_collection(features: DataFrame, path: str) -> None:
    feature_collection(features).coalesce(1).write.mode("overwrite").text(path)


def write_lines(features: DataFrame, path: str) -> None:
    """One feature a line, in parallel."""
    features.select(feature_line().alias("value")).write.mode("overwrite").text(path)
