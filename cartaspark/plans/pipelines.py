"""Whole procedures: sheets to exports, tile builds, incremental updates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bounds, corners, jpeg, retile as R, sheets as S, tiles as T, warp as W
from ..sources import archive, geojson, tilestore
from ..sources.scratch import materialise


class MissingSheets(ValueError):
    """Changed sheets that have no bounds; `sheets` (sheet_id) names all of them."""

    def __init__(self, sheets: DataFrame, n: int, some: list[str]):
        super().__init__(f"{n} sheets without bounds, among them {', '.join(some)}")
        self.sheets = sheets


def process_sheets(sheets: DataFrame, images: DataFrame, zoom: int, finder: S.Finder | None = None, done: DataFrame | None = None, grid_lines: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None, text_boxes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scanned sheets to georeferenced blocks and bounds.

    sheets: sheet_id, ring (closed, lon/lat, from upper left counter-clockwise), extra (JSON or null);
    images: sheet_id, height, width, data.  Sheets in `done` (sheet_id) are skipped.  Returns the stages
    areas, rotations, corners, gcps, blocks, exports (blocks as JPEG of the sheet's quality, with masks),
    bounds and problems.  Areas, deskewed images, corners and blocks
    are written to the shared folder once, as several stages read them; the rest runs when it is used.
    Corners are sought on the image with its grid lines, many of them lie on crossings; what is warped
    is the image without them.  `grid_lines` is a table (see sheets.remove_grid_lines), or a callable that
    gets the corners (sheet_id, corners) and control points (sheet_id, gcps) found and returns such a
    table; it is called between these stages.  `text_boxes`: recognised text that finders must ignore
    (see sheets.boxes_in_windows).
    """
    todo = sheets if done is None else sheets.join(done.select("sheet_id"), "sheet_id", "left_anti")
    scans = S.fill_insets(images.join(todo.select("sheet_id", "extra"), "sheet_id"))
    areas = materialise(S.map_areas(scans), "areas")
    turns = S.rotations(areas)
    upright = materialise(S.rotate_images(scans, turns), "upright")
    found = materialise(S.find_corners(upright, finder, text_boxes), "corners")
    good = found.where("problem is null").select("sheet_id", "corners")
    gcps = corners.control_points(todo.select("sheet_id", "ring"), good)
    lines = grid_lines(good, gcps) if callable(grid_lines) else grid_lines
    clean = upright if lines is None else materialise(S.remove_grid_lines(upright, lines), "clean")
    blocks = materialise(W.warp_blocks(clean, gcps, zoom), "blocks")
    digest = blocks.groupBy("sheet_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "z", "x", "y", F.sha2("data", 256)))), ","), 256).alias("digest"))
    quality = todo.select("sheet_id", S.whole_option("jpeg_export_quality").alias("_quality"))
    exports = T.encode_jpeg(blocks.join(quality, "sheet_id"), F.col("_quality")).drop("_quality")
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    exported = todo.select("sheet_id", geometry.alias("geom_json")).join(digest, "sheet_id")
    problems = areas.select("sheet_id", "problem").unionByName(found.select("sheet_id", "problem")).where("problem is not null").distinct()
    return {"areas": areas, "rotations": turns, "corners": found, "gcps": gcps, "blocks": blocks, "exports": exports, "bounds": exported, "problems": problems}


def build_tiles(blocks: DataFrame, min_zoom: int, max_zoom: int, priority: DataFrame | None = None, size: int = 256, resampling: str = "mean") -> DataFrame:
    """A full pyramid from blocks at max_zoom, without wholly transparent tiles."""
    level = materialise(T.mosaic(blocks.where(F.col("z") == max_zoom), priority, size), "level")
    levels = [level]
    for _ in range(max_zoom - min_zoom):  # as many rounds as zoom levels; each is read twice
        level = materialise(T.overview_tiles(level, size, resampling), "level")
        levels.append(level)
    return T.drop_transparent(reduce(DataFrame.unionByName, levels))


def tile(blocks: DataFrame, path: str, name: str, description: str, attribution: str, max_zoom: int, min_zoom: int = 0, extension: str = "png", priority: DataFrame | None = None, size: int = 256, resampling: str = "lanczos", quality: int = 75) -> DataFrame:
    """Build a pyramid from blocks, encode it (png, or jpeg of a quality), write it as a tile store; returns its metadata (one row `value`), also written under `path`/_metadata."""
    kind = tilestore.tile_format(extension)
    if kind not in ("png", "jpeg"):
        raise ValueError(f"no codec for {kind} at hand; only png and jpeg tiles can be written")
    jpeg.tables(quality)  # a wrong quality must not cost a pyramid
    tiles = build_tiles(blocks, min_zoom, max_zoom, priority, size, resampling)
    tiles = T.encode_png(tiles, size) if kind == "png" else T.encode_jpeg(tiles, quality, size).drop("mask")
    tilestore.write_store(tiles, path)
    about = [F.lit(v) for v in (name, description, attribution, kind, "1", min_zoom, max_zoom)]
    value = blocks.sparkSession.range(1).select(tilestore.metadata_json(*about).alias("value"))
    value.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_metadata")
    return value


def partition(sources: list[DataFrame], path: str, extension: str, about: str = "{}", part_bytes: int = archive.PART_BYTES) -> None:
    """Write encoded tiles (z, x, y, data) of several sources as one set of archives of bounded size.

    Where sources share a tile the first one's counts; a tile whose source says that it is transparent
    (is_transparent) is left out, and so are the same tiles of later sources.
    """
    if not sources:
        raise ValueError("no tiles given")
    flagged = [s if "is_transparent" in s.columns else s.withColumn("is_transparent", F.lit(False)) for s in sources]
    whole = reduce(lambda new, old: new.unionByName(old.join(new.select(*R.KEY), R.KEY, "left_anti")), [s.select(*R.KEY, "data", "is_transparent") for s in flagged])
    archive.write_archives(whole.where(~F.col("is_transparent")), path, extension, about, part_bytes)


def collect_bounds(spark: SparkSession, folder: str, base: str | None = None, delete_ids: list[str] | None = None) -> DataFrame:
    """The features of a folder of `.geojsonl` files over those of an earlier collection (a path), of which the deleted ids are left out."""
    if delete_ids and base is None:
        raise ValueError("ids can only be deleted from an earlier collection")
    old = None if base is None else geojson.read_collection(spark, base)
    gone = spark.createDataFrame([(i,) for i in delete_ids], "sheet_id string") if delete_ids else None
    return bounds.upsert_bounds(geojson.read_feature_files(spark, folder), old, gone)


def check_changed(changed: DataFrame, sheets: DataFrame) -> None:
    missing = R.missing_sheets(changed, sheets)
    n = missing.count()
    if n:
        raise MissingSheets(missing, n, [r[0] for r in missing.orderBy("sheet_id").take(20)])


def pull_list(sheets: DataFrame, changed: DataFrame, redo: DataFrame | None, zoom: int) -> DataFrame:
    check_changed(changed, sheets)
    return R.requirements(sheets, changed, redo, zoom)[0]


def retile(sheets: DataFrame, changed: DataFrame, redo: DataFrame | None, blocks: DataFrame, archive: DataFrame, min_zoom: int, max_zoom: int, priority: DataFrame | None = None, size: int = 256, resampling: str = "mean") -> DataFrame:
    """The tiles that a change replaces, all zoom levels.

    Base tiles are painted again from the blocks of all sheets that touch them; an affected tile that no
    sheet covers any more becomes transparent.  Upper levels are merged from new tiles and their
    siblings, which come from the archive (z, x, y, data).
    """
    check_changed(changed, sheets)
    affected = materialise(R.requirements(sheets, changed, redo, max_zoom)[1], "affected")
    base = T.mosaic(blocks.join(affected, R.KEY, "left_semi"), priority, size)
    empty = affected.join(base.select(*R.KEY), R.KEY, "left_anti").select(F.col("z").cast("int").alias("z"), "x", "y", F.lit(bytes(4 * size * size)).alias("data"))
    level = materialise(base.unionByName(empty), "level")
    levels = [level]
    siblings = materialise(R.sibling_tiles(affected, max_zoom, min_zoom), "siblings")
    for z in range(max_zoom - 1, min_zoom - 1, -1):
        old = R.copy_plan(siblings.where(F.col("z") == z + 1), level, archive.where(F.col("z") == z + 1)).select("z", "x", "y", "data")
        level = materialise(T.overview_tiles(level.unionByName(old), size, resampling), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def update_tileset(old_bounds: DataFrame, new_bounds: DataFrame, blocks: DataFrame, archive: DataFrame, min_zoom: int, max_zoom: int, priority: DataFrame | None = None, size: int = 256, resampling: str = "mean") -> DataFrame:
    """Compare two snapshots of bounds and return the whole updated tile set; the archive itself if nothing changed."""
    redo = geojson.boxes_of(bounds.diff_bounds(old_bounds, new_bounds).withColumn("sheet_id", F.concat(F.lit("dummy_"), F.xxhash64("sheet_id", "reason").cast("string"))))
    redo = materialise(redo, "redo")
    if redo.isEmpty():
        return archive
    nothing = new_bounds.select("sheet_id").limit(0)
    fresh = retile(geojson.boxes_of(new_bounds), nothing, redo, blocks, archive, min_zoom, max_zoom, priority, size, resampling)
    return R.merged_archive(T.with_transparency(fresh), T.with_transparency(archive.select("z", "x", "y", "data"))).drop("is_transparent")
