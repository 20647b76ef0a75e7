"""Incremental maintenance of a tile pyramid: which tiles and sheets a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tilemath import ancestors, children, cover, parents

KEY = ["z", "x", "y"]


def sheet_tiles(sheets: DataFrame, z: int, redo: DataFrame | None = None) -> DataFrame:
    """Edges sheet_id-(z, x, y) of sheets (and forced areas) and the base tiles that their boxes touch."""
    boxes = sheets.select("sheet_id", "west", "south", "east", "north")
    if redo is not None:
        boxes = boxes.join(redo.select("sheet_id"), "sheet_id", "left_anti").unionByName(redo.select("sheet_id", "west", "south", "east", "north"))
    return cover(boxes, z).select("sheet_id", *KEY).distinct()


def missing_sheets(changed: DataFrame, sheets: DataFrame) -> DataFrame:
    return changed.select("sheet_id").distinct().join(sheets, "sheet_id", "left_anti")


def affected_tiles(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Base tiles of changed sheets."""
    return edges.join(changed.select("sheet_id").distinct(), "sheet_id", "left_semi").select(*KEY).distinct()


def sheets_to_pull(edges: DataFrame, affected: DataFrame, dummies: DataFrame | None = None) -> DataFrame:
    """Real sheets that share an affected tile, as file names."""
    hit = edges.join(affected, KEY, "left_semi").select("sheet_id").distinct()
    if dummies is not None:
        hit = hit.join(dummies.select("sheet_id"), "sheet_id", "left_anti")
    return hit.select(F.concat("sheet_id", F.lit(".tif")).alias("sheet_file"))


def requirements(sheets: DataFrame, changed: DataFrame, redo: DataFrame | None, z: int) -> tuple[DataFrame, DataFrame]:
    """(sheets to pull, affected base tiles) for changed sheets and forced areas; see missing_sheets for ids without bounds."""
    edges = sheet_tiles(sheets, z, redo)
    ids = changed.select("sheet_id") if redo is None else changed.select("sheet_id").unionByName(redo.select("sheet_id"))
    affected = affected_tiles(edges, ids)
    return sheets_to_pull(edges, affected, redo), affected


def sibling_tiles(affected: DataFrame, max_zoom: int, min_zoom: int) -> DataFrame:
    """Tiles that must be fetched to rebuild the ancestors: children of affected parents that are not affected, at all levels."""
    every = ancestors(affected, min_zoom)
    needed = children(every.where(F.col("z") < max_zoom))
    return needed.select(F.col("z").cast("int").alias("z"), "x", "y").join(every, KEY, "left_anti")


def copy_plan(wanted: DataFrame, stored: DataFrame, archive: DataFrame) -> DataFrame:
    """Wanted tiles that are not stored yet and that the archive has, with the archive's columns."""
    return archive.join(wanted.select(*KEY), KEY, "left_semi").join(stored.select(*KEY), KEY, "left_anti")


def tiles_to_delete(stored: DataFrame, keep: DataFrame, z: int) -> DataFrame:
    """Stored tiles of one zoom level that are not kept."""
    return stored.where(F.col("z") == z).select(*KEY).join(keep.select(*KEY), KEY, "left_anti")


def merged_archive(new: DataFrame, old: DataFrame) -> DataFrame:
    """New tiles before old ones; tiles that are wholly transparent (is_transparent) are left out."""
    both = new.unionByName(old.join(new.select(*KEY), KEY, "left_anti"))
    return both.where(~F.col("is_transparent")) if "is_transparent" in both.columns else both


def top_sheet(edges: DataFrame, priority: DataFrame) -> DataFrame:
    """For each tile the sheet that paints on top: highest priority (sheet_id, prio), then largest id."""
    ranked = edges.join(priority.select("sheet_id", "prio"), "sheet_id")
    return ranked.groupBy(*KEY).agg(F.max(F.struct("prio", "sheet_id")).alias("_t")).select(*KEY, F.col("_t.sheet_id").alias("sheet_id"))


def zoom_stats(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count("*").alias("n_tiles"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


__all__ = ["KEY", "affected_tiles", "copy_plan", "merged_archive", "missing_sheets", "parents", "requirements", "sheet_tiles", "sheets_to_pull", "sibling_tiles", "tiles_to_delete", "top_sheet", "zoom_stats"]
