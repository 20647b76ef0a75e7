"""Keyed snapshots of sheet bounds: difference, upsert, digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys in which 1 and 1.0 differ; an Arrow batch at a time."""

    @F.udf("string", useArrow=True)
    def canonical(s: str | None) -> str | None:
        return None if s is None else json.dumps(json.loads(s), sort_keys=True)

    return canonical(text)


def diff_bounds(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """What changed between two snapshots (sheet_id, geom_json, digest): sheet_id, geom_json, reason.

    One full outer join; every sheet gives no row, one, or (geometry changed) two.  Missing
    geometries and digests compare as equal to each other.  Geometries are compared with sorted keys;
    `strict` also tells 1 from 1.0.
    """
    normal = canonical_json if strict else (lambda c: F.to_json(F.parse_json(c)))
    side = lambda df, tag: df.select("sheet_id", F.struct(F.col("geom_json"), F.col("digest"), normal(F.col("geom_json")).alias("shape")).alias(tag))
    both = side(old, "o").join(side(new, "n"), "sheet_id", "full_outer")
    row = lambda geom, why: F.struct(geom.alias("geom_json"), F.concat(F.lit("Sheet "), F.col("sheet_id"), F.lit(f" {why}")).alias("reason"))
    og, ng = F.col("o.geom_json"), F.col("n.geom_json")
    moved = ~F.col("o.shape").eqNullSafe(F.col("n.shape"))
    # fixed values: the wording of the reasons
    rows = (
        F.when(F.col("o").isNull(), F.array(row(ng, "added")))
        .when(F.col("n").isNull(), F.array(row(og, "deleted")))
        .when(moved, F.array(row(og, "geometry changed (old)"), row(ng, "geometry changed (new)")))
        .when(~F.col("o.digest").eqNullSafe(F.col("n.digest")), F.array(row(ng, "digest changed")))
    )
    return both.where(F.col("sheet_id").isNotNull()).select("sheet_id", F.inline(rows))


def upsert_bounds(new: DataFrame, base: DataFrame | None = None, delete_ids: DataFrame | None = None) -> DataFrame:
    """New rows over base rows by sheet_id, without the deleted ids; a deleted id that is new comes back."""
    if base is None:
        return new
    kept = base if delete_ids is None else base.join(delete_ids, "sheet_id", "left_anti")
    return new.unionByName(kept.join(new.select("sheet_id"), "sheet_id", "left_anti"))


def last_by_id(features: DataFrame, order: str) -> DataFrame:
    """Of features with equal ids the last; those without an id are dropped."""
    rest = [c for c in features.columns if c not in ("sheet_id", order)]
    packed = features.where(F.col("sheet_id").isNotNull()).groupBy("sheet_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_f"))
    return packed.select("sheet_id", "_f.*")


def added_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("sheet_id").join(old, "sheet_id", "left_anti").distinct()


def deleted_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    return added_ids(new, old)


def common_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("sheet_id").intersect(new.select("sheet_id"))


def changed_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sheets of both snapshots whose digests differ: sheet_id, old_digest, new_digest; missing digests are equal to each other."""
    side = lambda df, tag: df.select("sheet_id", F.col("digest").alias(tag))
    both = side(old, "old_digest").join(side(new, "new_digest"), "sheet_id")
    return both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))


def with_digest(features: DataFrame, contents: DataFrame) -> DataFrame:
    """Add the SHA-256 of each sheet's exported content (sheet_id, content)."""
    return features.drop("digest").join(content_digest(contents), "sheet_id", "left")


def content_digest(contents: DataFrame) -> DataFrame:
    return contents.select("sheet_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One row `value` with the whole FeatureCollection text, a feature a line, ordered by sheet_id.

    For files small enough for one row; the scalable form is one feature per line (write.text).
    """
    line = feature_line()
    rows = features.select("sheet_id", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_id", "line"))), lambda r: r["line"]), ",\n")
    return rows.agg(F.concat(F.lit('{ "type": "FeatureCollection", "features": [\n'), body, F.lit("\n]}\n")).alias("value"))


def feature_line() -> Column:
    """A GeoJSON feature from sheet_id, geom_json and, if given, digest."""
    return F.concat(
        F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.col("sheet_id").alias("id"), F.col("digest"))), F.lit(', "geometry": '), F.coalesce(F.col("geom_json"), F.lit("null")), F.lit("}")
    )
