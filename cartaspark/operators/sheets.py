"""Stages that turn scanned sheets into georeferenced blocks; every stage is a DataFrame of its own.

Images are rows (sheet_id, height, width, data: BGR bytes).  A stage works on one sheet at a time in
an Arrow worker; sheets are independent, so stages scale with their number.  `extra` is an optional
JSON object of options per sheet (see DEFAULTS).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.colour import COLOURS
from ..sources.scratch import materialise
from . import contours as C, jpeg, kernels as K, polygons as P

IMAGE = "sheet_id string, height int, width int, data binary"


#: Options that are accepted and change nothing: what is warped is kept as it is until it is exported.
WITHOUT_EFFECT = {"warp_jpeg_export_quality"}


@dataclass(frozen=True)
class SheetOptions:
    """Options of a sheet and their defaults."""

    auto_rotate_thresh: float = 0.0
    resize_factor: float = 0.25
    resize_width: int | None = None
    resize_height: int | None = None
    band_color: str | None = "black"
    band_color_choices: tuple = ()
    collar_erode: int = -2
    use_bbox_area: bool = True
    poly_approx_factor: float = 0.001
    map_area_ratio_thresh: float = 0.5
    max_contour_ratio: float = 1.0
    corner_ratio: float = 400 / 9000
    corner_overrides: tuple | None = None
    shrunk_map_area_corners: tuple | None = None
    inset_pixel_cutlines: tuple = ()
    inset_inpaint_color: tuple = (255, 255, 255)
    pixel_cutlines: tuple = ()
    line_color: str = "black"
    find_line_scale: int = 4
    find_line_iter: int = 1
    cwidth: int = 1
    ext_thresh: float = 20.0
    max_corner_angle_diff: float = 10.0
    max_corner_angle_diff_cutoff: float = 30.0
    expect_band_count: int = 0
    corner_max_dist_ratio: float = 1.0
    corner_min_dist_ratio: float = 0.0
    min_expected_points: int = 1
    remove_corner_edges_ratio: float | None = None
    corner_erode: int = 0
    min_corner_contour_area_ratio: float = 0.0
    max_corner_contour_area_ratio: float | None = None
    min_corner_dist_ratio: float = 0.0
    pixel_adjustment: int = 0
    picked_corner_max_dist_from_contour_ratio: float | None = None
    warp_resampling_method: str = "bilinear"
    warp_output_height: int = 6500
    shrunk_jpeg_quality: int = 95
    jpeg_export_quality: int = 75
    finder: str = "nearest_intersection"
    remove_text: bool = True
    text_removal_engine: str = "tesseract"
    text_removal_border: int = 0
    text_removal_iterations: int = 1

    def __post_init__(self):
        if self.resize_width is not None and self.resize_height is not None:
            raise ValueError("give a resize width or a resize height, not both")
        K.reach(self.warp_resampling_method)
        for quality in (self.shrunk_jpeg_quality, self.jpeg_export_quality):
            jpeg.tables(quality)

    @classmethod
    def of(cls, extra: str | None) -> SheetOptions:
        """The options of a JSON object; one that is not known raises ValueError."""
        given = json.loads(extra) if isinstance(extra, str) and extra else {}
        unknown = sorted(given.keys() - {f.name for f in fields(cls)} - WITHOUT_EFFECT)
        if unknown:
            raise ValueError(f"unknown options {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k not in WITHOUT_EFFECT})


DEFAULTS = asdict(SheetOptions())


def whole_option(name: str) -> Column:
    """The whole number that the column `extra` gives for an option, or its default."""
    return F.coalesce(F.get_json_object("extra", f"$.{name}").try_cast("int"), F.lit(DEFAULTS[name]))


Finder = Callable[[np.ndarray, tuple[int, int], float, SheetOptions], tuple[float, float]]


class NotFound(Exception):
    """No corner fits."""


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), 3)


def _image(sheet_id: str, image: np.ndarray) -> tuple:
    return sheet_id, image.shape[0], image.shape[1], np.ascontiguousarray(image).tobytes()


def _each(images: DataFrame, schema: str, work: Callable, nullable: set[str] | None = None) -> DataFrame:
    """Apply work(row) -> list of output tuples to every row, a sheet at a time.  `nullable`: integer columns that may be null."""
    names = [x.strip().split(" ")[0] for x in schema.replace("<", "(").split(",")] if "<" not in schema else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = work(row)
                if out:
                    made = pd.DataFrame(out, columns=names or columns)
                    yield made.astype(dict.fromkeys(nullable, "Int32")) if nullable else made

    from pyspark.sql.types import StructType

    columns = StructType.fromDDL(schema).names
    return images.mapInPandas(run, schema)


def shrink_size(height: int, width: int, o: SheetOptions) -> tuple[int, int]:
    ratio = o.resize_width / width if o.resize_width else o.resize_height / height if o.resize_height else o.resize_factor
    return max(1, int(height * ratio)), max(1, int(width * ratio))


def biggest_contour(mask: np.ndarray, erode: int, use_box_area: bool, most: float) -> C.Contour:
    """The contour with the largest box, or the first hole of the one with the largest area, among those whose box takes less than `most` of the mask.

    The mask is first eroded by a square of `erode` pixels, or dilated if that is below 0.  Of equal ones the last by rows wins.
    """
    if erode:
        mask = (K.erode if erode > 0 else K.dilate)(mask, abs(erode), abs(erode))
    found = C.trace(mask)
    fits = [k for k, x in enumerate(found) if x.box_area < most * mask.size]
    if not fits:
        raise NotFound("contours too large" if found else "no contour")
    if use_box_area:
        return found[max(fits, key=lambda k: (found[k].box_area, found[k].first))]
    best = max(fits, key=lambda k: (found[k].area, found[k].first))
    hole = C.first_hole(found, best)
    if hole is None:
        raise NotFound("the largest contour has no hole")
    return found[hole]


def map_area(image: np.ndarray, o: SheetOptions) -> dict:
    """Box, ring, minimal rectangle and angle of the map on the shrunk image, and how much smaller that is: by the first colour that leads to a large enough map.

    The shrunk image is coded as JPEG and decoded first, which takes single pixels out.
    """
    small = jpeg.round_trip(K.shrink(image, *shrink_size(*image.shape[:2], o)), o.shrunk_jpeg_quality)
    h, w = small.shape[:2]
    problem = "no map area"
    for colour in (o.band_color,) if o.band_color is not None else o.band_color_choices:
        mask = K.colour_mask(small, colour, COLOURS)
        try:
            ring = np.array(o.shrunk_map_area_corners, int) if o.shrunk_map_area_corners else biggest_contour(mask, o.collar_erode, o.use_bbox_area, o.max_contour_ratio).ring
        except NotFound as e:
            problem = f"no map area: {e}"
            continue
        low, high = ring.min(0), ring.max(0) + 1
        if np.prod(high - low) / (w * h) < o.map_area_ratio_thresh:
            problem = "no map area: too small"
            continue
        rectangle, angle = K.min_area_rectangle(ring)
        return {"box": [int(low[0]), int(low[1]), int(high[0] - low[0]), int(high[1] - low[1])], "ring": ring, "rectangle": rectangle, "angle": angle, "ratio": (w / image.shape[1], h / image.shape[0])}
    raise NotFound(problem)


AREA = "sheet_id string, x long, y long, w long, h long, angle double, ratio double, problem string"


def _problem(e: Exception) -> str:
    """What the table of problems says of a failed sheet."""
    return str(e) if isinstance(e, NotFound) else f"{type(e).__name__}: {e}"


def map_areas(images: DataFrame) -> DataFrame:
    """The map of every sheet on its shrunk image; `problem` says why there is none."""

    def work(row):
        try:
            a = map_area(pixels_of(row), SheetOptions.of(getattr(row, "extra", None)))
        except Exception as e:  # one bad sheet must not stop the others
            return [(row.sheet_id, None, None, None, None, None, None, _problem(e))]
        return [(row.sheet_id, *a["box"], a["angle"], a["ratio"][0], None)]

    return _each(images, AREA, work)


def fill_insets(images: DataFrame) -> DataFrame:
    """Insets filled with their colour (given as R, G, B); all columns but the image stay."""

    def work(row):
        image = pixels_of(row)
        try:
            o = SheetOptions.of(getattr(row, "extra", None))
        except (TypeError, ValueError):  # the next stage reports it
            return [(*_image(row.sheet_id, image), row.extra)]
        if o.inset_pixel_cutlines:
            image = K.inpaint(image, list(o.inset_pixel_cutlines), tuple(o.inset_inpaint_color)[::-1])
        return [(*_image(row.sheet_id, image), getattr(row, "extra", None))]

    return _each(images, IMAGE + ", extra string", work)


def rotations(areas: DataFrame) -> DataFrame:
    """sheet_id, angle to turn by, rotated: angles over 45 degrees stand for the other side."""
    turn = F.when(F.col("angle") > 45, F.col("angle") - 90).otherwise(F.col("angle"))
    return areas.where("problem is null").select("sheet_id", turn.alias("angle"))


def rotate_images(images: DataFrame, angles: DataFrame) -> DataFrame:
    """Images turned upright, with original size and angle: ..., original_height, original_width, angle, rotated."""

    def work(row):
        o = SheetOptions.of(getattr(row, "extra", None))
        image = pixels_of(row)
        turned = not abs(row.angle) < o.auto_rotate_thresh
        out = K.rotate(image, row.angle) if turned else image
        return [(*_image(row.sheet_id, out), row.extra, int(row.height), int(row.width), float(row.angle), turned)]

    return _each(images.join(angles, "sheet_id"), IMAGE + ", extra string, original_height int, original_width int, angle double, rotated boolean", work)


def text_mask(height: int, width: int, boxes: list[tuple[int, int, int, int]], engine: str, border: int, iterations: int) -> np.ndarray:
    """Pixels under text boxes (x, y, w, h; the far sides included), widened by a square of `border` pixels, `iterations` times (below 0: narrowed).

    With the engine "easyocr" all that is marked so far is widened after each box, so earlier boxes grow
    with each later one; with "tesseract" it is widened once, after the last.
    """
    if engine not in ("tesseract", "easyocr"):
        raise ValueError(f"unknown text engine {engine}")
    mask = np.zeros((height, width), np.uint8)
    if border >= 0:
        for x0, y0, x1, y1 in grown_boxes(height, width, np.array(boxes, np.int64).reshape(-1, 4), np.arange(len(boxes), 0, -1), engine, border, iterations).tolist():
            mask[y0:y1, x0:x1] = 255
        return mask

    def narrowed(mask: np.ndarray) -> np.ndarray:
        for _ in range(iterations):
            mask = K.erode(mask, -border, -border)
        return mask

    for x, y, w, h in boxes:
        mask[max(0, y) : max(0, y + h + 1), max(0, x) : max(0, x + w + 1)] = 255
        if engine == "easyocr":
            mask = narrowed(mask)
    return narrowed(mask) if engine == "tesseract" else mask


def grown_boxes(height: int, width: int, boxes: np.ndarray, later: np.ndarray, engine: str, border: int, iterations: int) -> np.ndarray:
    """Where text_mask with a border of 0 or more marks each box (x, y, w, h): x0, y0, x1, y1 (ends left out), empty outside the image.

    Widening a union is the union of what was widened, so every box grows by itself: with "easyocr" once for
    each of the boxes from itself to the last, of which there are `later`.
    """
    size = np.array([width, height])
    low, high = np.clip(boxes[:, :2], 0, size), np.clip(boxes[:, :2] + boxes[:, 2:] + 1, 0, size)
    steps = max(0, iterations if border else 0) * (later if engine == "easyocr" else np.ones(len(boxes), np.int64))[:, None]
    marked = (low < high).all(1, keepdims=True)
    return np.where(marked, np.concatenate([np.clip(low - (border - 1 - border // 2) * steps, 0, size), np.clip(high + border // 2 * steps, 0, size)], 1), 0)


def paint(canvas: np.ndarray, areas: np.ndarray, image: np.ndarray) -> None:
    """Set areas (x0, y0, x1, y1; in images that ascend) in images whose rows are bits of 64-bit words."""
    rows, words = np.arange(canvas.shape[1]), canvas.shape[2]
    bits = np.clip(np.arange(64 * words + 1)[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    below = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << bits % np.uint64(64)) - np.uint64(1))
    rank = np.arange(len(image)) - np.searchsorted(image, image)
    order = np.argsort(rank, kind="stable")
    for own in np.split(order, np.cumsum(np.bincount(rank))[:-1]):  # of each image one area at a time
        x0, y0, x1, y1 = areas[own].T
        within = (rows >= y0[:, None]) & (rows < y1[:, None])
        canvas[image[own]] |= np.where(within[:, :, None], (below[x1] & ~below[x0])[:, None], np.uint64(0))


#: The order of engines in what text_pixels returns for a sheet.
ENGINES = ("tesseract", "easyocr")


def text_pixels(boxes: DataFrame, order: str, height: int, width: int, border: int, iterations: int) -> DataFrame:
    """sheet_id, engine, pixels: how many pixels text_mask marks for text boxes (sheet_id, x, y, w, h, in the order of a column), by either engine; a border of 0 or more.

    Sheets are sorted, last boxes first, and stream by: a task holds a batch of rows and the images of its
    sheets, never all boxes of one.  A box with a null marks nothing; sheets without a marked pixel have no row.
    """
    if border < 0:
        raise ValueError("the border must not be negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(ids: pa.Array, canvas: np.ndarray) -> pa.RecordBatch:
            pixels = np.bitwise_count(canvas).sum((2, 3), dtype=np.int64)
            sheet, engine = np.nonzero(pixels)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(sheet)), pa.array(np.array(ENGINES)[engine], pa.string()), pa.array(pixels[sheet, engine])], names=["sheet_id", "engine", "pixels"])

        last, seen, open_ = None, 0, None  # the sheet that may go on, its boxes so far and its images
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0))
            ids, ends = runs.values, runs.run_ends.to_numpy().astype(np.int64)
            canvas = np.zeros((len(ids), 2, height, -(-width // 64)), np.uint64)
            sheet = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            later = np.arange(batch.num_rows) - np.concatenate(([0], ends))[sheet] + 1
            if last is not None and last.equals(ids[:1]):
                canvas[0] = open_
                later[: ends[0]] += seen
            elif last is not None:
                yield counted(last, open_[None])
            numbers = [batch.column(c) for c in range(1, 5)]
            there = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in numbers])
            places = np.column_stack([c.fill_null(0).to_numpy() for c in numbers])[there]
            for k, engine in enumerate(ENGINES):
                areas = grown_boxes(height, width, places, later[there], engine, border, iterations)
                paint(canvas[:, k], areas, sheet[there])
            yield counted(ids[:-1], canvas[:-1])
            last, seen, open_ = ids[-1:], int(later[-1]), canvas[-1].copy()
        if last is not None:
            yield counted(last, open_[None])

    kind = boxes.schema["sheet_id"].dataType.simpleString()
    sorted_ = P.spread(boxes.select("sheet_id", *(F.col(c).cast("long") for c in "xywh"), order), "sheet_id").sortWithinPartitions("sheet_id", F.desc(order))
    return sorted_.drop(order).mapInArrow(run, f"sheet_id {kind}, engine string, pixels long")


def _mask(image: np.ndarray, o: SheetOptions) -> np.ndarray:
    """The lines of a window; what its fourth channel marks as text is none, if the sheet asks for that."""
    mask = K.colour_mask(image[..., :3], o.line_color, COLOURS)
    if image.shape[2] > 3 and o.remove_text:
        mask[image[..., 3] > 0] = 0
    return mask


def _without_edges(mask: np.ndarray, direction: tuple[int, int], o: SheetOptions) -> np.ndarray:
    """The mask without the bands at its two outer edges, if the sheet asks for that; see raster.clear_corner_edges."""
    if o.remove_corner_edges_ratio is None:
        return mask
    h, w = mask.shape
    hd, wd = int(h * o.remove_corner_edges_ratio), int(w * o.remove_corner_edges_ratio)
    out = mask.copy()
    cols = slice(0, max(0, wd - 1)) if direction[0] > 0 else slice(max(0, w - wd + 1), max(0, w - 1))
    rows = slice(0, hd + 1) if direction[1] > 0 else slice(max(0, h - hd + 1), max(0, h - 1))
    out[:, cols] = 0
    out[rows] = 0
    return out


def _anchor(shape: tuple, direction: tuple[int, int]) -> tuple[int, int]:
    return (shape[1] if direction[0] < 0 else 0), (shape[0] if direction[1] < 0 else 0)


def _gap(a, b, want: float) -> float:
    return abs(np.degrees(np.arctan2(b[1] - a[1], b[0] - a[0])) - want)


def nearest_intersection(image, direction, anchor_angle, o, points=None, bounds=True):
    """The line crossing nearest to the window's outer corner, within the rules for distance and angle."""
    mask = _mask(image, o)
    points = K.intersections(mask, o.find_line_scale, o.find_line_iter) if points is None else points
    anchor, diagonal = _anchor(mask.shape, direction), float(np.hypot(*mask.shape))
    points = sorted(points, key=lambda p: (np.hypot(p[0] - anchor[0], p[1] - anchor[1]), p[0] * direction[0], p[1] * direction[1]))
    if o.expect_band_count and points:
        diagonal = abs(diagonal - np.hypot(points[0][0] - anchor[0], points[0][1] - anchor[1]))
        anchor, points = points[0], points[o.expect_band_count :]
    reach = [(np.hypot(p[0] - anchor[0], p[1] - anchor[1]) / diagonal, p) for p in points]
    if bounds:
        reach = [(d, p) for d, p in reach if o.corner_min_dist_ratio < d < o.corner_max_dist_ratio and _gap(anchor, p, anchor_angle) < o.max_corner_angle_diff_cutoff]
    if len(reach) < max(1, o.min_expected_points if bounds else 1):
        raise NotFound("too few points")
    _, best = min(reach, key=lambda x: x[0])
    if _gap(anchor, best, anchor_angle) > o.max_corner_angle_diff:
        raise NotFound("angle too high")
    return best


def arms(mask: np.ndarray, x: int, y: int, factor: int, cwidth: int, threshold: float) -> int:
    """How many of a point's arms are lines; see raster.arm_counts."""
    h, w = mask.shape
    n, on = 10 * factor, mask > 0
    offsets = [0] + [s * i for i in range(cwidth) for s in (1, -1)]
    total = [0, 0, 0, 0]
    for i in offsets:
        if 0 <= x + i < w:
            total[0] += int(on[y : min(y + n, h - 1), x + i].sum())
            total[1] += int(on[max(y - n, 0) : y, x + i].sum())
        if 0 <= y + i < h:
            total[2] += int(on[y + i, x : min(x + n, w - 1)].sum())
            total[3] += int(on[y + i, max(x - n, 0) : x].sum())
    return sum(t > threshold * factor * (2 * cwidth + 1) / 3 for t in total)


def four_way(image, direction, anchor_angle, o):
    """The only crossing with four arms, with arm lengths growing until one is left."""
    mask = _without_edges(_mask(image, o), direction, o)
    points = K.intersections(mask, o.find_line_scale, o.find_line_iter)
    for factor in (1, 2, 4, 8):
        found = [p for p in points if arms(mask, *p, factor, o.cwidth, o.ext_thresh) == 4]
        if not found:
            raise NotFound("no crossing with four arms")
        if len(found) == 1:
            return found[0]
    raise NotFound("several crossings with four arms")


def distance_outside(ring: np.ndarray, point: tuple[float, float]) -> float:
    """Distance of a point from a ring; below 0 inside it."""
    a = np.asarray(ring, float)
    way, gap = np.roll(a, -1, 0) - a, np.asarray(point, float) - a
    length = (way**2).sum(1)
    t = np.clip((gap * way).sum(1) / np.where(length == 0, 1, length), 0, 1)
    least = float(np.hypot(*(gap - t[:, None] * way).T).min())
    return -least if least and len(a) > 2 and P.contains([a], point)[0] else least


def biggest_contour_corner(image, direction, anchor_angle, o):
    """The outer corner of the largest component's box, moved by `pixel_adjustment` towards the map.

    The box must have its least share of the window, and the corner its least distance (in diagonals)
    from the window's.  With `picked_corner_max_dist_from_contour_ratio`, a corner too far from the
    contour's ring is refused, and one outside it moves towards the map by its distance from it.
    """
    mask = _without_edges(_mask(image, o), direction, o)
    contour = biggest_contour(mask, o.corner_erode, True, o.max_corner_contour_area_ratio or np.inf)
    x, y, w, h = contour.box
    diagonal, anchor = float(np.hypot(*mask.shape)), _anchor(image.shape, direction)
    if w * h < o.min_corner_contour_area_ratio * mask.size:
        raise NotFound("contour too small")
    corner = (x if direction[0] > 0 else x + w, y if direction[1] > 0 else y + h)
    corner = tuple(v + o.pixel_adjustment * d for v, d in zip(corner, direction, strict=True))
    if np.hypot(corner[0] - anchor[0], corner[1] - anchor[1]) / diagonal < o.min_corner_dist_ratio:
        raise NotFound("corner too near to the window's")
    if _gap(anchor, corner, anchor_angle) > o.max_corner_angle_diff:
        raise NotFound("angle too high")
    if o.picked_corner_max_dist_from_contour_ratio is not None:
        off = distance_outside(contour.ring, corner)
        if off > o.picked_corner_max_dist_from_contour_ratio * diagonal:
            raise NotFound("corner too far from the contour")
        if off > 0:
            corner = tuple(v + off * d for v, d in zip(corner, direction, strict=True))
    return corner


def contour_intersection(image, direction, anchor_angle, o):
    """The nearest crossing inside the largest component's box."""
    mask = _mask(image, o)
    x, y, w, h = biggest_contour(mask, o.corner_erode, True, o.max_corner_contour_area_ratio or np.inf).box
    points = [p for p in K.intersections(mask, o.find_line_scale, o.find_line_iter) if x < p[0] < x + w and y < p[1] < y + h]
    return nearest_intersection(image, direction, anchor_angle, o, points, bounds=False)


FINDERS: dict[str, Finder] = {"nearest_intersection": nearest_intersection, "four_way": four_way, "biggest_contour": biggest_contour_corner, "contour_intersection": contour_intersection}
WINDOWS = (((1, 1), 45.0), ((1, -1), -45.0), ((-1, -1), -135.0), ((-1, 1), 135.0))


@dataclass(frozen=True)
class Window:
    """Where one corner is sought: x, y, width and height in the full image, the way from the window's outer corner to the map, and its angle.  `given` beats what is found."""

    x: int
    y: int
    width: int
    height: int
    direction: tuple[int, int]
    angle: float
    given: tuple[float, float] | None


def corner_windows(image_shape: tuple, area: dict, o: SheetOptions) -> list[Window]:
    """The windows of a sheet's corners, in the order of its ring.

    The number of corner overrides (four, if there are none) chooses the stage: four corners lie in the
    corners of the map's box; any other number lies at the bends of its ring, which is simplified by
    `poly_approx_factor` of its length.  Sizes are `corner_ratio` of the box, rounded half to even.
    """
    rw, rh = (1 / r for r in area["ratio"])
    x0, y0, w, h = (int(v * r) for v, r in zip(area["box"], (rw, rh, rw, rh), strict=True))
    w, h = min(w, image_shape[1] - x0), min(h, image_shape[0] - y0)
    given = [None if g is None else (float(g[0]), float(g[1])) for g in (o.corner_overrides or (None,) * 4)]
    if len(given) == 4:
        cw, ch = round(o.corner_ratio * w), round(o.corner_ratio * h)
        places = [(0 if d[0] > 0 else w - 1 - cw, 0 if d[1] > 0 else h - 1 - ch) for d, _ in WINDOWS]
        return [Window(x0 + x, y0 + y, cw, ch, *window, own) for (x, y), window, own in zip(places, WINDOWS, given, strict=True)]
    if all(g is not None for g in given):
        return [Window(0, 0, 0, 0, (1, 1), 45.0, own) for own in given]
    bends = K.simplify(area["ring"], o.poly_approx_factor)
    return ring_windows(np.trunc(bends * (rw, rh)), round(o.corner_ratio * w), given)


def ring_windows(points: np.ndarray, size: int, given: list) -> list[Window]:
    """Square windows whose centres lie half a window inside a ring, one for each of its points, in canonical order (functions.geometry.canonical_ring)."""
    points = canonical(np.asarray(points, float))
    if len(given) != len(points):
        raise ValueError(f"{len(given)} corner overrides for {len(points)} corners: give all corners, or one or null for each")
    inner = [r for r in P.buffer(points, -size / 2) if P.doubled_area(r) > 0]
    centres = K.offset_ring(points, -size / 2)
    if len(inner) != 1 or len(inner[0]) != len(points):
        raise NotFound("the map is too narrow for its corner windows")
    out = []
    for point, centre, own in zip(points, np.trunc(centres), given, strict=True):
        direction = tuple(1 if c > p else -1 for c, p in zip(centre, point, strict=True))
        x, y = (int(v - size / 2) for v in centre)
        out.append(Window(x, y, size, size, direction, dict(WINDOWS)[direction], own))
    return out


def canonical(points: np.ndarray) -> np.ndarray:
    """A ring's points in the order of functions.geometry.canonical_ring: backwards from the first one above and left of the centre, lowest first."""
    if P.doubled_area(points) < 0:
        points = points[::-1]
    ahead = np.roll(points, -1, 0)
    length = np.hypot(*(ahead - points).T)
    centre = ((points + ahead) / 2 * length[:, None]).sum(0) / length.sum()
    first = [k for k in range(len(points)) if (points[k] < centre).all()]
    if not first:
        raise NotFound("no corner in the upper left")
    start = min(first, key=lambda k: (points[k, 1], points[k, 0]))
    return points[(start - np.arange(len(points))) % len(points)]


def _window_of(image: np.ndarray, window: Window) -> np.ndarray:
    """The part of the image under a window; parts off the image are left out."""
    return image[max(0, window.y) : max(0, window.y + window.height), max(0, window.x) : max(0, window.x + window.width)]


def _found(part: np.ndarray, window: Window, o: SheetOptions, finder: Finder | None) -> tuple[float, float]:
    if window.given is not None:
        return window.given
    if not part.size:
        raise NotFound("a corner's window lies off the image")
    x, y = (finder or FINDERS[o.finder])(part, window.direction, window.angle, o)
    return float(max(0, window.x) + x), float(max(0, window.y) + y)


CORNERS = "sheet_id string, corners array<struct<x:double,y:double>>, problem string"
WINDOW = "sheet_id string, corner int, corners int, x int, y int, width int, height int, dx int, dy int, angle double, gx double, gy double, part_height int, part_width int, data binary, extra string, problem string"


def cut_windows(images: DataFrame) -> DataFrame:
    """A row for each corner of each sheet, with the pixels of its window alone; `problem` where a sheet has none (corner -1).

    Scans stay where they are: the map is found and its windows are cut in one pass, and only windows,
    a few hundredths of a scan, move on.
    """

    def work(row):
        extra = getattr(row, "extra", None)
        try:
            o, image = SheetOptions.of(extra), pixels_of(row)
            windows = corner_windows(image.shape, map_area(image, o), o)
        except Exception as e:  # one bad sheet must not stop the others
            return [(row.sheet_id, -1, 0, *[None] * 12, extra, _problem(e))]
        out = []
        for k, v in enumerate(windows):
            part = np.ascontiguousarray(_window_of(image, v) if v.given is None else image[:0, :0])
            out.append((row.sheet_id, k, len(windows), v.x, v.y, v.width, v.height, *v.direction, v.angle, *(v.given or (None, None)), part.shape[0], part.shape[1], part.tobytes(), extra, None))
        return out

    return _each(images, WINDOW, work, {"x", "y", "width", "height", "dx", "dy", "part_height", "part_width"})


def boxes_in_windows(windows: DataFrame, text_boxes: DataFrame) -> DataFrame:
    """sheet_id, corner, boxes: the text boxes (sheet_id, ord, x, y, w, h; pixels of the upright image) that meet each window, in order, from the window's corner on.

    Only boxes of the same sheet meet, and of windows only their places, not their pixels.
    """
    own = windows.where("problem is null and gx is null").select("sheet_id", "corner", F.greatest(F.lit(0), "x").alias("_x"), F.greatest(F.lit(0), "y").alias("_y"), "part_width", "part_height")
    met = text_boxes.join(own, "sheet_id").where((F.col("x") + F.col("w") >= F.col("_x")) & (F.col("y") + F.col("h") >= F.col("_y")) & (F.col("x") < F.col("_x") + F.col("part_width")) & (F.col("y") < F.col("_y") + F.col("part_height")))
    box = F.struct("ord", (F.col("x") - F.col("_x")).cast("int").alias("x"), (F.col("y") - F.col("_y")).cast("int").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    return met.groupBy("sheet_id", "corner").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def find_corners(images: DataFrame, finder: Finder | None = None, text_boxes: DataFrame | None = None) -> DataFrame:
    """Corners of every sheet, in pixels of the full image; `problem` says why there are none.

    The corners of a sheet are sought in parallel; of several problems the one of the first corner is reported.
    With `text_boxes` (see boxes_in_windows) finders get a fourth channel that marks recognised text.
    """
    windows = cut_windows(images)
    if text_boxes is not None:
        windows = materialise(windows, "windows")
        windows = windows.join(boxes_in_windows(windows, text_boxes), ["sheet_id", "corner"], "left")

    marked = text_boxes is not None

    def work(row):
        if row.problem is not None:
            return [(row.sheet_id, int(row.corner), int(row.corners), None, None, row.problem)]
        given = None if row.gx is None or np.isnan(row.gx) else (float(row.gx), float(row.gy))
        window = Window(int(row.x), int(row.y), int(row.width), int(row.height), (int(row.dx), int(row.dy)), float(row.angle), given)
        try:
            o, part = SheetOptions.of(row.extra), np.frombuffer(row.data, np.uint8).reshape(int(row.part_height), int(row.part_width), 3)
            if marked:
                boxes = [(b["x"], b["y"], b["w"], b["h"]) for b in (row.boxes if row.boxes is not None else ())]
                part = np.dstack([part, text_mask(*part.shape[:2], boxes, o.text_removal_engine, o.text_removal_border, o.text_removal_iterations)])
            return [(row.sheet_id, int(row.corner), int(row.corners), *_found(part, window, o, finder), None)]
        except Exception as e:
            return [(row.sheet_id, int(row.corner), int(row.corners), None, None, _problem(e))]

    found = _each(windows.repartition("sheet_id", "corner"), "sheet_id string, corner int, corners int, x double, y double, problem string", work)
    point = F.struct("corner", F.struct("x", "y").alias("p"))
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("corner", "problem")))["problem"]
    packed = found.groupBy("sheet_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda c: c["p"]).alias("corners"), first.alias("problem"))
    return packed.select("sheet_id", F.when(F.col("problem").isNull(), F.col("corners")).alias("corners"), "problem")


CORRECTED = "sheet_id string, x double, y double, new_x double, new_y double, type string"


def correct_points(images: DataFrame, points: DataFrame, colours: tuple[str, ...], height: int, width: int, scale: int = 4, iterations: int = 1) -> DataFrame:
    """Expected grid crossings (sheet_id, x, y) moved to the line crossing in their surroundings of 2 * height by 2 * width pixels.

    Colours are tried in order: several crossings end the search without result; the last colour with
    one crossing wins.
    """
    packed = points.groupBy("sheet_id").agg(F.collect_set(F.struct("x", "y")).alias("points"))

    def correct(image: np.ndarray, x: float, y: float) -> tuple[float, float, str]:
        px, py = int(x), int(y)
        x0, y0 = max(0, px - width), max(0, py - height)
        part = image[y0 : max(0, py + height), x0 : max(0, px + width)]
        if not part.size:
            return px, py, "invalid"
        hit = None
        for colour in colours:
            found = K.intersections(K.colour_mask(part, colour, COLOURS), scale, iterations)
            if len(found) > 1:
                return x, y, "too_many_choices"
            hit = found[0] if found else hit
        if hit is None:
            return x, y, "no_choices"
        at = (hit[0] + x0, hit[1] + y0)
        return *at, "unchanged" if at == (px, py) else "corrected"

    def work(row):
        image = pixels_of(row)
        return [(row.sheet_id, float(p["x"]), float(p["y"]), *(v if isinstance(v, str) else float(v) for v in correct(image, p["x"], p["y"]))) for p in row.points]

    return _each(images.select("sheet_id", "height", "width", "data").join(packed, "sheet_id"), CORRECTED, work)


def cutline_properties(sheets: DataFrame) -> DataFrame:
    """sheet_id, props: a sheet's index properties (map) overlaid by id, crs, gcps and pixel cutline (strings); later keys win."""
    own = F.create_map(F.lit("id"), F.col("sheet_id"), F.lit("crs"), F.col("crs"), F.lit("gcps"), F.to_json("gcps"), F.lit("pixel_cutline"), F.to_json("cutline"))
    base = F.map_filter("props", lambda k, v: ~k.isin("id", "crs", "gcps", "pixel_cutline"))
    return sheets.select("sheet_id", F.map_concat(base, own).alias("props"))


def transform_points(points: DataFrame, gcps: DataFrame, inverse: bool = False) -> DataFrame:
    """Thin-plate spline of points (sheet_id, point_id, x, y) by the sheet's control points (sheet_id, gcps: px, py, x, y)."""

    ThinPlate = K.ThinPlateSpline

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, spline, known = None, None, {}
        for frame in frames:
            ids, packed = frame["sheet_id"].to_numpy(), frame["gcps"].to_numpy()
            xy, out = frame[["x", "y"]].to_numpy(float), np.empty((len(frame), 2))
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # rows of a sheet stand together, as the join sorts them
                if ids[lo] != last or spline is None:
                    g = packed[lo]
                    pixel, world = np.array([[p["px"], p["py"]] for p in g], float), np.array([[p["x"], p["y"]] for p in g], float)
                    source, target = (world, pixel) if inverse else (pixel, world)
                    last, spline, known = ids[lo], ThinPlate(source, target), dict(zip(map(tuple, source.tolist()), target.tolist(), strict=True))
                out[lo:hi] = spline(xy[lo:hi])
                for i in range(lo, hi):  # a control point has its own value to the last bit
                    own = known.get((xy[i, 0], xy[i, 1]))
                    if own is not None:
                        out[i] = own
            yield pd.DataFrame({"sheet_id": frame["sheet_id"], "point_id": frame["point_id"], "tx": out[:, 0], "ty": out[:, 1]})

    met = points.select("sheet_id", "point_id", "x", "y").join(gcps.select("sheet_id", "gcps").where(F.size("gcps") > 0).hint("merge"), "sheet_id")
    return met.select("sheet_id", "point_id", "x", "y", "gcps").mapInPandas(run, "sheet_id string, point_id long, tx double, ty double")


def remove_grid_lines(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Images without their grid lines (sheet_id, ord, x1, y1, x2, y2, line_buf_ratio, blur_buf_ratio, blur_kern_ratio, blur_repeat), removed in order; a sheet without lines stays as it is."""
    packed = lines.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2", "line_buf_ratio", "blur_buf_ratio", "blur_kern_ratio", "blur_repeat"))).alias("lines"))

    def work(row):
        image = pixels_of(row)
        for v in row.lines if row.lines is not None else ():
            image = K.remove_line(image, ((v["x1"], v["y1"]), (v["x2"], v["y2"])), v["line_buf_ratio"], v["blur_buf_ratio"], v["blur_kern_ratio"], int(v["blur_repeat"]))
        return [(*_image(row.sheet_id, image), getattr(row, "extra", None))]

    return _each(images.join(packed, "sheet_id", "left"), IMAGE + ", extra string", work)
