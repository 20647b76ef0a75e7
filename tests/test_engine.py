"""Operators, sources, procedures and streaming on small inputs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartaspark.functions import geometry as G, scalar as S, tilemath as M
from cartaspark.operators import bounds as B, corners as C, gridlines as L, raster as X, retile as R, sheets as H, tiles as T, warp as W
from cartaspark.plans import pipelines as P
from cartaspark.sources import geojson, listing, tilestore
from cartaspark.streaming import bounds as stream


def one(df):
    return df.collect()[0]


# bounds


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return f"file://{path}"


def feature(id_, x, **properties):
    own = {"id": id_, **properties} if id_ else properties
    return {"type": "Feature", "properties": own, "geometry": {"type": "Polygon", "coordinates": [[[x, 0.0], [x, -1.0], [x + 1, -1.0], [x + 1, 0.0], [x, 0.0]]]}}


def test_read_collection_last_wins_and_no_id_goes(spark, tmp_path):
    path = collection(tmp_path / "b.geojson", [feature("a", 1.0), feature(None, 2.0), feature("a", 3.0, digest="d"), feature("b", 4.0)])
    rows = {r["sheet_id"]: r for r in geojson.read_collection(spark, path).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["digest"] == "d"
    boxes = {r["sheet_id"]: r["west"] for r in geojson.read_boxes(spark, path, dummy=True).collect()}
    assert boxes == {"dummy_0": 1.0, "dummy_1": 2.0, "dummy_2": 3.0, "dummy_3": 4.0}
    with pytest.raises(Exception, match="feature without id"):
        geojson.read_boxes(spark, path).collect()


def test_feature_files_and_writers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, i in enumerate(("x", "y")):
        (folder / f"{k}.geojsonl").write_text(json.dumps(feature(i, float(k)), indent=1))
    rows = geojson.read_feature_files(spark, f"file://{folder}")
    assert sorted(r["sheet_id"] for r in rows.collect()) == ["x", "y"]
    geojson.write_collection(rows, f"file://{tmp_path}/out")
    part = next(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    text = (tmp_path / "out" / part).read_text()
    assert [f["properties"]["id"] for f in json.loads(text)["features"]] == ["x", "y"]
    assert text.startswith('{ "type": "FeatureCollection", "features": [\n')


def frame(spark, rows):
    return spark.createDataFrame(rows, "sheet_id string, geom_json string, digest string")


def test_diff(spark):
    old = frame(spark, [("gone", "1", "d"), ("same", '{"a":1,"b":2}', None), ("moved", "1", "d"), ("redone", "1", "d"), ("number", "[1]", "d")])
    new = frame(spark, [("new", "2", "d"), ("same", '{"b":2,"a":1}', None), ("moved", "2", "e"), ("redone", "1", None), ("number", "[1.0]", "d")])
    got = {(r["reason"], r["geom_json"]) for r in B.diff_bounds(old, new).collect()}
    assert got == {("Sheet new added", "2"), ("Sheet gone deleted", "1"), ("Sheet moved geometry changed (old)", "1"), ("Sheet moved geometry changed (new)", "2"), ("Sheet redone digest changed", "1")}
    strict = {r["reason"] for r in B.diff_bounds(old, new, strict=True).collect()}
    assert strict - {r for r, _ in got} == {"Sheet number geometry changed (old)", "Sheet number geometry changed (new)"}
    assert B.diff_bounds(old, old).count() == 0
    turned = {r["reason"] for r in B.diff_bounds(new, old).collect()}
    assert {"Sheet new deleted", "Sheet gone added"} <= turned


def test_upsert(spark):
    base, new = frame(spark, [("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")]), frame(spark, [("b", "2", "y"), ("d", "2", "y")])
    ids = spark.createDataFrame([("a",), ("d",)], "sheet_id string")
    got = {r["sheet_id"]: r["geom_json"] for r in B.upsert_bounds(new, base, ids).collect()}
    assert got == {"b": "2", "c": "1", "d": "2"}
    again = {r["sheet_id"] for r in B.upsert_bounds(new, B.upsert_bounds(new, base, ids), ids).collect()}
    assert again == set(got)
    assert B.upsert_bounds(new).count() == 2


# tiles


def test_cover_edges_and_antimeridian(spark):
    boxes = spark.createDataFrame([("w", 179.5, -1.0, -179.5, 1.0), ("edge", 0.0, 0.0, 90.0, 66.0), ("world", -180.0, -85.06, 180.0, 85.06)], "sheet_id string, west double, south double, east double, north double")
    got = {}
    for r in M.cover(boxes, 2).collect():
        got.setdefault(r["sheet_id"], set()).add((r["x"], r["y"]))
    assert got["w"] == {(0, 1), (0, 2), (3, 1), (3, 2)}
    assert got["edge"] == {(2, 1)}
    assert len(got["world"]) == 16


def test_parents_children_ancestors(spark):
    tiles = spark.createDataFrame([(3, 5, 6), (3, 4, 7)], "z int, x long, y long")
    assert {tuple(r) for r in M.parents(tiles).collect()} == {(2, 2, 3)}
    assert {tuple(r) for r in M.children(M.parents(tiles)).collect()} >= {(3, 5, 6), (3, 4, 7)}
    every = {tuple(r) for r in M.ancestors(tiles, 0).collect()}
    assert every == {(3, 5, 6), (3, 4, 7), (2, 2, 3), (1, 1, 1), (0, 0, 0)}
    siblings = {tuple(r) for r in R.sibling_tiles(tiles, 3, 0).collect()}
    assert not siblings & every and len(siblings) == 2 + 3 + 3
    assert one(spark.range(1).select(M.flip_y(F.lit(5), F.lit(3)).alias("y")))["y"] == 2


def test_store_swap_and_reading(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    tiles = spark.createDataFrame([(1, 0, 1, b"a"), (0, 0, 0, b"b")], "z int, x long, y long, data binary")
    tilestore.write_store(tiles, path)
    tilestore.write_store(tiles.where("z = 1"), path)
    assert tilestore.read_store(spark, path).count() == 1
    former = tilestore.read_store(spark, path)
    tilestore.write_store(tiles, path)
    assert former.count() == 1 and tilestore.read_store(spark, path).count() == 2  # a reader of the version before goes on
    tilestore.write_store(tiles, path)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["v3", "v4"]
    with pytest.raises(Exception, match="broken"):
        tilestore.write_store(tiles.withColumn("data", F.raise_error(F.lit("broken"))), path)
    assert tilestore.read_store(spark, path).count() == 2
    (tmp_path / "f/2/3").mkdir(parents=True)
    (tmp_path / "f/2/3/1.png").write_bytes(b"x")
    assert tuple(one(tilestore.read_folder(spark, f"file://{tmp_path}/f", "png")))[:3] == (2, 3, 1)
    assert json.loads(one(tilestore.metadata(tiles, "n", "d", "a", "jpg"))["value"])["format"] == "jpeg"
    with pytest.raises(ValueError):
        tilestore.tile_format("gif")


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a.tif \n\nb\n a\nx.tif.tif\n")
    assert sorted(r[0] for r in listing.read_retile_list(spark, f"file://{tmp_path}/l.txt").collect()) == ["a", "b", "x"]
    with pytest.raises(ValueError):
        listing.read_rasters(spark)
    assert one(spark.range(1).select(listing.sheet_id_of(F.lit("/d/a.tif.tif"), ".tif").alias("i")))["i"] == "a"


# scalars and geometry


def test_scalars(spark):
    r = one(
        spark.range(1).select(
            S.between_multiples(F.lit(-7).cast("long"), F.lit(11).cast("long"), F.lit(5).cast("long")).alias("m"), S.between_multiples(F.lit(1).cast("long"), F.lit(4).cast("long"), F.lit(5).cast("long")).alias("none"),
            S.resolution(F.lit(25000.0)).alias("res"), S.normalised_rotation(F.lit(80.0)).alias("rot"), S.scaled(F.lit(-7), 0.5).alias("cut"),
            S.rotation_canvas(F.lit(60), F.lit(40), F.lit(90.0))[0].alias("w"),
        )
    )
    assert r["m"] == [-5, 0, 5, 10] and r["none"] == [] and r["res"] == 2.1166 and r["rot"] == -10 and r["cut"] == -3 and r["w"] in (39, 40)


def test_rings(spark):
    ring = spark.createDataFrame([("a", [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)])], "sheet_id string, ring array<struct<x:double,y:double>>")
    r = one(ring.select(G.doubled_area(F.col("ring")).alias("a"), G.inside(F.col("ring"), F.lit(1.0), F.lit(1.0)).alias("i"), G.inside(F.col("ring"), F.lit(3.0), F.lit(1.0)).alias("o"), G.canonical_ring(F.col("ring")).alias("c")))
    assert r["a"] == -8 and r["i"] and not r["o"]
    assert [tuple(p) for p in r["c"]] == [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    bad = ring.select("sheet_id", F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))).alias("corners"))
    with pytest.raises(Exception, match="corners do not match"):
        C.control_points(ring, bad.select(F.col("sheet_id").alias("sheet_id"), "corners")).collect()
    lines = spark.createDataFrame([("a", 1.0, 1.0, 9.0, 9.0), ("a", 8.0, 8.0, 9.0, 9.0)], "sheet_id string, px1 double, py1 double, px2 double, py2 double")
    assert L.on_sheet(lines, ring).count() == 1


def test_components_do_not_stop_early(spark):
    # corridors joined at alternate ends: each round carries the first label on by a few turns
    rows = [("s", r, c, 1) for r in range(25) for c in range(9) if r % 2 == 0 or c == (8 if r % 4 == 1 else 0)]
    mask = spark.createDataFrame(rows, "sheet_id string, r long, c long, m int")
    assert {r["label"] for r in X.components(mask, "m").collect()} == {0}
    with pytest.raises(RuntimeError):
        X.components(mask, "m", rounds=2)


def test_components_as_relation_equal_the_kernel(spark):
    from cartaspark.operators import kernels as K

    mask = np.random.default_rng(4).integers(0, 2, (9, 9))
    rows = [("s", int(r), int(c), int(mask[r, c])) for r in range(9) for c in range(9)]
    got = X.component_boxes(X.components(spark.createDataFrame(rows, "sheet_id string, r long, c long, m int"), "m"))
    labels, n = K.label(mask)
    assert sorted(tuple(r) for r in got.select("x", "y", "w", "h").collect()) == sorted(tuple(b[:4]) for b in K.boxes(labels, n).tolist())
    assert X.biggest(got).count() == 1


def test_first_success_and_corrections(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, None)], "sheet_id string, ord int, result string")
    assert {r[0]: r[1] for r in C.first_success(rows).collect()} == {"a": "x", "b": None}
    hits = spark.createDataFrame(
        [("one", 5.0, 5.0, True, [(0, 1, 5.0, 5.0), (1, 1, 7.0, 7.0)]), ("many", 5.5, 5.0, True, [(0, 1, 5.0, 5.0), (1, 2, 7.0, 7.0)]), ("none", 5.5, 5.0, True, [(0, 0, None, None)]), ("bad", 5.0, 5.0, False, [(0, 1, 5.0, 5.0)]), ("same", 5.0, 5.0, True, [(0, 1, 5.0, 5.0)])],
        "sheet_id string, x double, y double, valid boolean, found array<struct<ord:int,n:int,hx:double,hy:double>>",
    )
    got = {r["sheet_id"]: (r["x"], r["type"]) for r in C.corrected_points(hits).collect()}
    assert got == {"one": (7.0, "corrected"), "many": (5.5, "too_many_choices"), "none": (5.5, "no_choices"), "bad": (5.0, "invalid"), "same": (5.0, "unchanged")}


# sheets and pyramids


def scanned_sheet(turn=0.0):
    """A white scan with a black frame of lines that cross at the corners."""
    from cartaspark.operators import kernels as K

    image = np.full((400, 500, 3), 255, np.uint8)
    for k in (60, 339):
        image[k : k + 3, 40:460] = 0
    for k in (80, 417):
        image[20:380, k : k + 3] = 0
    return K.rotate(image, turn) if turn else image


SHEET = "sheet_id string, ring array<struct<x:double,y:double>>, extra string"
RING = [(10.0, 50.0), (10.0, 49.0), (11.2, 49.0), (11.2, 50.0), (10.0, 50.0)]
EXTRA = json.dumps({"corner_ratio": 0.35, "find_line_scale": 3, "find_line_iter": 0, "max_corner_angle_diff": 40, "max_corner_angle_diff_cutoff": 45, "collar_erode": 0, "resize_factor": 0.5, "auto_rotate_thresh": 1.0, "map_area_ratio_thresh": 0.3})


def process(spark, image, **options):
    h, w = image.shape[:2]
    images = spark.createDataFrame([("s1", h, w, bytearray(image.tobytes()))], H.IMAGE)
    sheets = spark.createDataFrame([("s1", RING, EXTRA)], SHEET)
    return P.process_sheets(sheets, images, 6, **options)


def test_process_finds_corners_and_exports(spark):
    out = process(spark, scanned_sheet())
    assert out["problems"].count() == 0
    corners = [tuple(p) for p in one(out["corners"])["corners"]]
    want = [(81, 61), (81, 340), (418, 340), (418, 61)]
    assert all(abs(a - c) <= 2 and abs(b - d) <= 2 for (a, b), (c, d) in zip(corners, want, strict=True))
    blocks = out["blocks"].collect()
    assert blocks and all(len(b["data"]) == 4 * 256 * 256 for b in blocks)
    exports = {(r["z"], r["x"], r["y"]): r for r in out["exports"].collect()}
    assert exports.keys() == {(b["z"], b["x"], b["y"]) for b in blocks}
    assert all(bytes(r["data"]).startswith(b"\xff\xd8\xff") and len(r["mask"]) == 256 * 32 for r in exports.values())
    row = one(out["bounds"])
    assert json.loads(row["geom_json"])["type"] == "Polygon" and len(row["digest"]) == 64
    pyramid = P.build_tiles(out["blocks"], 4, 6)
    assert {r["z"] for r in pyramid.select("z").distinct().collect()} == {4, 5, 6}


def test_done_sheets_are_skipped(spark):
    out = process(spark, scanned_sheet(), done=spark.createDataFrame([("s1",)], "sheet_id string"))
    assert out["areas"].count() == 0


def test_a_failing_finder_is_reported(spark):
    def never(image, direction, angle, options):
        raise H.NotFound("nothing here")

    out = process(spark, scanned_sheet(), finder=never)
    assert [r["problem"] for r in out["problems"].collect()] == ["nothing here"]
    assert out["gcps"].count() == 0


def test_rotation_is_measured(spark):
    image = scanned_sheet(4.0)
    area = H.map_area(image, H.SheetOptions.of(EXTRA))
    assert min(abs(area["angle"] - a) for a in (86.0, 4.0)) < 1.5


def test_options():
    with pytest.raises(ValueError):
        H.SheetOptions(resize_width=1, resize_height=1)
    assert H.SheetOptions.of(None) == H.SheetOptions()
    assert H.SheetOptions.of('{"finder": "four_way", "jpeg_export_quality": 50}').finder == "four_way"
    with pytest.raises(ValueError, match="unknown options colour, finderr"):
        H.SheetOptions.of('{"finderr": "four_way", "colour": 1}')


def test_finders_on_one_corner():
    o = H.SheetOptions.of(json.dumps({"find_line_scale": 3, "find_line_iter": 0, "max_corner_angle_diff": 60, "max_corner_angle_diff_cutoff": 60, "ext_thresh": 20.0}))
    image = np.full((60, 60, 3), 255, np.uint8)
    image[30, 10:] = image[10:, 25] = 0
    for name in ("nearest_intersection", "contour_intersection", "four_way"):
        assert H.FINDERS[name](image, (1, 1), 45.0, o) == (25, 30), name
    assert H.FINDERS["biggest_contour"](image, (1, 1), 45.0, o) == (10, 10)
    with pytest.raises(H.NotFound):
        H.nearest_intersection(np.full((60, 60, 3), 255, np.uint8), (1, 1), 45.0, o)


def test_rules_of_the_largest_contour():
    find = lambda image, direction=(1, 1), angle=45.0, **o: H.biggest_contour_corner(image, direction, angle, H.SheetOptions(max_corner_angle_diff=60, **o))
    image = np.full((60, 60, 3), 255, np.uint8)
    image[20:40, 20:40] = 0
    image[50:52, 50:52] = 0
    assert find(image) == (20, 20) and find(image, (-1, -1), -135.0) == (40, 40)
    assert find(image, pixel_adjustment=3) == (23, 23)
    assert find(image, max_corner_contour_area_ratio=0.05) == (50, 50)  # the box of 400 of 3,600 pixels is too large
    assert find(image, picked_corner_max_dist_from_contour_ratio=0.1) == (20, 20)
    for o in ({"min_corner_contour_area_ratio": 0.2}, {"max_corner_contour_area_ratio": 0.0005}, {"min_corner_dist_ratio": 0.4}):
        with pytest.raises(H.NotFound):
            find(image, **o)
    cross = np.full((60, 60, 3), 255, np.uint8)
    cross[30, 10:] = cross[10:, 30] = 0  # the box's corner lies 20 pixels off both lines
    assert find(cross, picked_corner_max_dist_from_contour_ratio=0.5) == (30.0, 30.0)
    with pytest.raises(H.NotFound):
        find(cross, picked_corner_max_dist_from_contour_ratio=0.1)
    framed = image.copy()
    framed[:5] = framed[:, :4] = 0  # bands of int(0.1 * 60) pixels: columns [0, 5), rows [0, 7)
    assert find(framed) == (0, 0) and find(framed, corner_erode=-1) == (0, 0)
    thin = np.full((60, 60, 3), 255, np.uint8)
    thin[20:23, 20:50] = thin[20:50, 20:23] = thin[20:50, 47:50] = thin[47:50, 20:50] = 0
    assert find(thin, corner_erode=2) == (21, 21)  # a frame of three pixels outlives a square of two
    assert find(thin, corner_erode=-2) == (20, 20)
    assert find(framed) == (0, 0) and find(framed, remove_corner_edges_ratio=0.1) == (20, 20)


def test_least_number_of_points():
    image = np.full((60, 60, 3), 255, np.uint8)
    image[30, 10:] = image[10:, 25] = 0
    for least, ok in ((1, True), (2, False)):
        o = H.SheetOptions(find_line_scale=3, find_line_iter=0, max_corner_angle_diff=60, max_corner_angle_diff_cutoff=60, min_expected_points=least)
        if ok:
            assert H.nearest_intersection(image, (1, 1), 45.0, o) == (25, 30)
        else:
            with pytest.raises(H.NotFound):
                H.nearest_intersection(image, (1, 1), 45.0, o)


def test_pixel_cutlines_widen_the_sheet(spark):
    image = np.full((40, 40, 3), 7, np.uint8)
    gcps = spark.createDataFrame([("a", [(10.0, 10.0, 10.0, 20.0), (10.0, 30.0, 10.0, 10.0), (30.0, 30.0, 20.0, 10.0), (30.0, 10.0, 20.0, 20.0)])], "sheet_id string, gcps array<struct<px:double,py:double,x:double,y:double>>")
    shown = []
    for extra in (None, '{"pixel_cutlines": [[[28, 12], [38, 12], [38, 28], [28, 28]]]}'):
        images = spark.createDataFrame([("a", 40, 40, bytearray(image.tobytes()), extra)], H.IMAGE + ", extra string")
        blocks = W.warp_to_tiles(images, gcps, 4, 64).collect()
        shown.append(sum(int((np.frombuffer(r["data"], np.uint8)[3::4] > 0).sum()) for r in blocks))
    assert 1.2 < shown[1] / shown[0] < 1.5  # 20 x 20 pixels and 8 x 16 more


def test_halving():
    for way in ("mean", "lanczos"):
        m = T.halving(8, way)
        assert np.allclose(m.sum(1), 1) and np.allclose(m, m[::-1, ::-1])
    assert (T.halving(8, "lanczos") < 0).any()
    with pytest.raises(ValueError):
        T.halving(8, "cubic")


def test_tile_and_collect_bounds(spark, tmp_path):
    blocks = spark.createDataFrame([("a", 1, 0, 0, tile((1, 2, 3), 255)), ("b", 1, 1, 1, tile((5, 5, 5), 0))], "sheet_id string, z int, x long, y long, data binary")
    path = f"file://{tmp_path}/tiles"
    about = json.loads(one(P.tile(blocks, path, "n", "d", "a", max_zoom=1, size=4))["value"])
    assert (about["format"], about["minzoom"], about["maxzoom"], about["name"]) == ("png", 0, 1, "n")
    got = tilestore.read_store(spark, path).collect()
    assert sorted((r["z"], r["x"], r["y"]) for r in got) == [(0, 0, 0), (1, 0, 0)] and all(bytes(r["data"]).startswith(b"\x89PNG") for r in got)
    with pytest.raises(ValueError):
        P.tile(blocks, path, "n", "d", "a", max_zoom=1, extension="webp")

    feature = lambda i, x: {"type": "Feature", "properties": {"id": i}, "geometry": {"type": "Point", "coordinates": [x, 0]}}
    collection(tmp_path / "old.geojson", [feature("p", 1), feature("q", 1), feature("r", 1)])
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts/q.geojsonl").write_text(json.dumps(feature("q", 2)))
    found = P.collect_bounds(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/old.geojson", ["r"])
    assert sorted((r["sheet_id"], json.loads(r["geom_json"])["coordinates"][0]) for r in found.collect()) == [("p", 1), ("q", 2)]
    assert P.collect_bounds(spark, f"file://{tmp_path}/parts").count() == 1
    with pytest.raises(ValueError):
        P.collect_bounds(spark, f"file://{tmp_path}/parts", None, ["r"])


def six_cornered():
    """A white scan with a black collar around an L, and inside it lines that cross at its six corners."""
    image = np.full((500, 600, 3), 255, np.uint8)
    ring = [(60, 60), (60, 440), (540, 440), (540, 240), (300, 240), (300, 60)]
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        lo, hi = (min(x1, x2), min(y1, y2)), (max(x1, x2), max(y1, y2))
        image[lo[1] : hi[1] + 3, lo[0] : hi[0] + 3] = 0
    for x, y in ring:  # lines run on a little beyond their crossings
        image[y : y + 3, x - 15 : x + 15] = image[y - 15 : y + 15, x : x + 3] = 0
    collar = [(35, 35), (35, 465), (565, 465), (565, 215), (325, 215), (325, 35)]
    for (x1, y1), (x2, y2) in zip(collar, collar[1:] + collar[:1], strict=True):
        image[min(y1, y2) : max(y1, y2) + 3, min(x1, x2) : max(x1, x2) + 3] = 0
    return image, ring


SIX = json.dumps({"corner_ratio": 0.15, "corner_min_dist_ratio": 0.1, "find_line_scale": 3, "find_line_iter": 0, "max_corner_angle_diff": 90, "max_corner_angle_diff_cutoff": 90, "collar_erode": 0, "resize_factor": 0.5, "map_area_ratio_thresh": 0.3, "poly_approx_factor": 0.02, "corner_overrides": [None] * 6, "auto_rotate_thresh": 1.0, "max_contour_ratio": 0.95})


def test_a_sheet_with_six_corners(spark):
    image, ring = six_cornered()
    lonlat = [(10.0, 50.0), (10.0, 49.0), (11.2, 49.0), (11.2, 49.5), (10.6, 49.5), (10.6, 50.0), (10.0, 50.0)]
    images = spark.createDataFrame([("six", *image.shape[:2], bytearray(image.tobytes()))], H.IMAGE)
    sheets = spark.createDataFrame([("six", lonlat, SIX)], SHEET)
    out = P.process_sheets(sheets, images, 6)
    assert out["problems"].collect() == []
    found = np.array([tuple(p) for p in one(out["corners"])["corners"]])
    assert found.shape == (6, 2) and np.abs(found - np.array(ring)).max() <= 3
    assert len(one(out["gcps"])["gcps"]) == 6 and out["blocks"].count() > 0


def test_text_is_no_line(spark):
    image = scanned_sheet()
    image[30:33, 40:460] = 0  # a word struck through above the frame looks like one more line
    images = spark.createDataFrame([("s1", *image.shape[:2], bytearray(image.tobytes()))], H.IMAGE)
    sheets = spark.createDataFrame([("s1", RING, EXTRA)], SHEET)
    boxes = spark.createDataFrame([("s1", 1, 35, 26, 430, 10), ("other", 1, 0, 0, 500, 400)], "sheet_id string, ord int, x int, y int, w int, h int")
    found = [[(p["x"], p["y"]) for p in one(P.process_sheets(sheets, images, 6, text_boxes=t)["corners"])["corners"]] for t in (None, boxes)]
    assert abs(found[0][0][1] - 31) <= 1 and abs(found[1][0][1] - 61) <= 1  # the first corner's row, with and without the word
    mask = H.text_mask(20, 20, [(2, 2, 3, 3), (10, 10, 2, 2)], "easyocr", 3, 1)
    assert mask[0, 0] and mask[9, 9] and not mask[8, 8] and (H.text_mask(20, 20, [(2, 2, 3, 3)], "tesseract", -3, 1) > 0).sum() == 4
    with pytest.raises(ValueError):
        H.text_mask(1, 1, [], "none", 0, 1)


def test_grid_lines_from_corners(spark):
    image = scanned_sheet()
    image[200:202, 80:420] = 0

    def lines(corners, gcps):
        assert set(gcps.columns) >= {"sheet_id", "gcps"}
        xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
        y = (F.array_min(ys) + F.array_max(ys)) / 2
        return corners.select("sheet_id", F.lit(1).alias("ord"), F.array_min(xs).alias("x1"), y.alias("y1"), F.array_max(xs).alias("x2"), y.alias("y2"), F.lit(0.012).alias("line_buf_ratio"), F.lit(0.05).alias("blur_buf_ratio"), F.lit(0.04).alias("blur_kern_ratio"), F.lit(1).alias("blur_repeat"))

    dark = []
    for hook in (None, lines):
        blocks = process(spark, image, grid_lines=hook)["blocks"].collect()
        pixels = np.concatenate([np.frombuffer(b["data"], np.uint8).reshape(-1, 4) for b in blocks])
        dark.append(int(((pixels[:, 0] < 128) & (pixels[:, 3] > 0)).sum()))
    assert dark[1] < dark[0]


def test_lines_near_the_edge(spark):
    ring = [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0), (0.0, 0.0)]
    cut = spark.createDataFrame([("s", ring)], "sheet_id string, ring array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([("s", 104.0, 104.0, 120.0, 120.0), ("s", 50.0, 50.0, 300.0, 50.0), ("s", -9.0, 5.0, -20.0, 5.0)], "sheet_id string, px1 double, py1 double, px2 double, py2 double")
    assert [L.on_sheet(lines, cut, b).count() for b in (0.0, 5.0, 10.0, -60.0)] == [1, 2, 3, 0]


def test_windows_of_corners():
    area = {"box": [10, 20, 100, 50], "ratio": (0.5, 0.5), "ring": np.array([(10, 20), (10, 70), (110, 70), (110, 20)])}
    windows = H.corner_windows((200, 300, 3), area, H.SheetOptions(corner_ratio=0.125))
    assert [(v.x, v.y, v.width, v.height) for v in windows] == [(20, 40, 25, 12), (20, 127, 25, 12), (194, 127, 25, 12), (194, 40, 25, 12)]  # 12.5 is rounded to 12; far ones begin a pixel earlier
    given = H.corner_windows((200, 300, 3), area, H.SheetOptions(corner_overrides=((1, 2),) * 5))
    assert [v.given for v in given] == [(1.0, 2.0)] * 5
    with pytest.raises(ValueError):
        H.corner_windows((200, 300, 3), area, H.SheetOptions(corner_overrides=(None,) * 5))
    some = H.ring_windows(np.array([(0, 0), (100, 0), (100, 80), (0, 80)]), 20, [None, (5, 5), None, None])
    assert [(v.x, v.y, v.direction, v.given) for v in some] == [(0, 0, (1, 1), None), (0, 60, (1, -1), (5, 5)), (80, 60, (-1, -1), None), (80, 0, (-1, 1), None)]
    with pytest.raises(H.NotFound):
        H.ring_windows(np.array([(0, 0), (100, 0), (100, 8), (0, 8)]), 20, [None] * 4)


def test_a_broken_sheet_beside_a_good_one(spark):
    good = scanned_sheet()
    blank = np.full((60, 80, 3), 255, np.uint8)
    rows = [("good", *good.shape[:2], bytearray(good.tobytes()), EXTRA), ("blank", 60, 80, bytearray(blank.tobytes()), EXTRA), ("typo", *good.shape[:2], bytearray(good.tobytes()), '{"finderr": 1}'), ("colour", *good.shape[:2], bytearray(good.tobytes()), '{"band_color": "mauve"}')]
    images = spark.createDataFrame([r[:4] for r in rows], H.IMAGE)
    sheets = spark.createDataFrame([(r[0], RING, r[4]) for r in rows], SHEET)
    out = P.process_sheets(sheets, images, 6)
    problems = {r["sheet_id"]: r["problem"] for r in out["problems"].collect()}
    assert problems.keys() == {"blank", "typo", "colour"} and "unknown options finderr" in problems["typo"] and "mauve" in problems["colour"]
    assert [r["sheet_id"] for r in out["gcps"].collect()] == ["good"]


def test_rules_of_the_map_area():
    image = np.full((100, 120, 3), 255, np.uint8)
    image[:, :] = 0  # the whole image is one component: not below the bound
    o = H.SheetOptions(resize_factor=1.0, collar_erode=0, map_area_ratio_thresh=0.2)
    with pytest.raises(H.NotFound):
        H.map_area(image, o)
    image[20:80, 10:110] = 255  # its hole is
    assert H.map_area(image, o)["box"] == [9, 19, 102, 62]
    image[30:40, 30:40] = 0
    image[33:37, 33:37] = 255
    # contour mode: the first hole of the largest contour below the bound
    assert H.map_area(image, H.SheetOptions(resize_factor=1.0, collar_erode=0, map_area_ratio_thresh=0.0, use_bbox_area=False, max_contour_ratio=0.1))["box"] == [32, 32, 6, 6]
    # a given colour beats the choices, null leaves it to them
    grey = np.full((100, 120, 3), 255, np.uint8)
    grey[10:90, 10:110] = 140
    with pytest.raises(H.NotFound):
        H.map_area(grey, H.SheetOptions(resize_factor=1.0, collar_erode=0, band_color_choices=("greyish",)))
    assert H.map_area(grey, H.SheetOptions(resize_factor=1.0, collar_erode=0, band_color=None, band_color_choices=("black", "greyish")))["box"] == [10, 10, 100, 80]


def test_grid_lines_points_and_properties(spark):
    ring = [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0), (0.0, 0.0)]
    cut = spark.createDataFrame([("s", ring)], "sheet_id string, ring array<struct<x:double,y:double>>")
    gcps = spark.createDataFrame([("s", [(0.0, 0.0, 0.0, 20.0), (100.0, 0.0, 20.0, 20.0), (0.0, 100.0, 0.0, 0.0), (100.0, 100.0, 20.0, 0.0)])], "sheet_id string, gcps array<struct<px:double,py:double,x:double,y:double>>")
    got = {tuple(round(v, 3) for v in r[1:]) for r in L.locate_grid_lines(cut, gcps, 10).collect()}
    assert (50.0, 50.0, 100.0, 50.0, 10.0, 10.0, 20.0, 10.0) in got
    assert all(0 <= a <= 100 and 0 <= b <= 100 or 0 <= c <= 100 and 0 <= d <= 100 for a, b, c, d, *_ in got)
    points = spark.createDataFrame([("s", 1, 0.0, 100.0), ("s", 2, 50.0, 50.0)], "sheet_id string, point_id long, x double, y double")
    moved = {r["point_id"]: (r["tx"], r["ty"]) for r in H.transform_points(points, gcps).collect()}
    assert moved[1] == (0.0, 0.0) and np.allclose(moved[2], (10, 10))
    image = scanned_sheet()
    images = spark.createDataFrame([("s", *image.shape[:2], bytearray(image.tobytes()))], H.IMAGE)
    expected = spark.createDataFrame([("s", 84.0, 58.0), ("s", 250.0, 200.0), ("s", -500.0, 5.0)], "sheet_id string, x double, y double")
    kinds = {r["x"]: (r["new_x"], r["new_y"], r["type"]) for r in H.correct_points(images, expected, ("black",), 15, 15, 2, 0).collect()}
    assert kinds[84.0] == (81.0, 61.0, "corrected") and kinds[250.0][2] == "no_choices" and kinds[-500.0][2] == "invalid"
    sheets = cut.join(gcps, "sheet_id").select("sheet_id", "gcps", F.col("ring").alias("cutline"), F.lit("EPSG:4326").alias("crs"), F.create_map(F.lit("id"), F.lit("old"), F.lit("name"), F.lit("n")).alias("props"))
    props = one(H.cutline_properties(sheets))["props"]
    assert props["id"] == "s" and props["name"] == "n" and json.loads(props["gcps"])[0]["px"] == 0


def tile(colour, alpha, size=4):
    out = np.zeros((size, size, 4), np.uint8)
    out[...] = (*colour, alpha)
    return bytearray(out.tobytes())


def test_mosaic_overview_and_transparency(spark):
    parts = spark.createDataFrame([("a", 1, 0, 0, tile((1, 1, 1), 255)), ("b", 1, 0, 0, tile((9, 9, 9), 255)), ("c", 1, 1, 1, tile((5, 5, 5), 0))], "sheet_id string, z int, x long, y long, data binary")
    prio = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "sheet_id string, prio int")
    painted = {(r["x"], r["y"]): bytes(r["data"])[0] for r in T.mosaic(parts, prio, 4).collect()}
    assert painted == {(0, 0): 1, (1, 1): 0}
    assert {(r["x"], r["y"]): bytes(r["data"])[0] for r in T.mosaic(parts, None, 4).collect()}[0, 0] == 9
    base = T.mosaic(parts, prio, 4)
    top = np.frombuffer(one(T.overview_tiles(base, 4))["data"], np.uint8).reshape(4, 4, 4)
    assert top[0, 0].tolist() == [1, 1, 1, 255] and top[3, 3].tolist() == [0, 0, 0, 0]
    assert T.drop_transparent(base).count() == 1
    assert bytes(one(T.encode_png(base.where("x = 0"), 4))["data"]).startswith(b"\x89PNG")


def test_retile_and_update(spark):
    polygon = lambda x: json.dumps({"type": "Polygon", "coordinates": [[[x, 10.0], [x, 5.0], [x + 5, 5.0], [x + 5, 10.0], [x, 10.0]]]})
    old = frame(spark, [("a", polygon(10.0), "1"), ("b", polygon(100.0), "1")])
    new = frame(spark, [("a", polygon(10.0), "2"), ("b", polygon(100.0), "1")])
    edges = R.sheet_tiles(geojson.boxes_of(new), 3)
    blocks = edges.select("sheet_id", "z", "x", "y", F.when(F.col("sheet_id") == "a", F.lit(tile((7, 7, 7), 255))).otherwise(F.lit(tile((3, 3, 3), 255))).alias("data"))
    archive = P.build_tiles(edges.select("sheet_id", "z", "x", "y", F.lit(tile((1, 1, 1), 255)).alias("data")), 0, 3, size=4)
    got = P.update_tileset(old, new, blocks, archive, 0, 3, size=4)
    base = {(r["x"], r["y"]): bytes(r["data"])[0] for r in got.where("z = 3").collect()}
    of_a = {(r["x"], r["y"]) for r in edges.where("sheet_id = 'a'").collect()}
    assert base == {(r["x"], r["y"]): 7 if (r["x"], r["y"]) in of_a else 1 for r in edges.collect()}
    assert got.where("z = 0").count() == 1 and got.groupBy("z", "x", "y").count().where("count > 1").count() == 0
    assert P.update_tileset(old, old, blocks, archive, 0, 3, size=4) is archive
    with pytest.raises(P.MissingSheets, match="zzz"):
        P.pull_list(geojson.boxes_of(new), spark.createDataFrame([("zzz",)], "sheet_id string"), None, 3)
    gone = P.update_tileset(old, new.where("sheet_id = 'b'"), blocks.where("sheet_id = 'b'"), archive, 0, 3, size=4)
    assert {(r["x"], r["y"]) for r in gone.where("z = 3").collect()} == {(r["x"], r["y"]) for r in edges.where("sheet_id = 'b'").collect()}


# streaming


def test_stream_of_bounds(spark, tmp_path):
    schema = "event_id long, op string, sheet_id string, geom_json string, digest string"
    source, store = tmp_path / "events", tmp_path / "bounds"
    frame(spark, [("a", "1", "x"), ("b", "1", "x")]).write.parquet(f"file://{store}/0")
    events = spark.createDataFrame([(1, "upsert", "a", "2", "y"), (2, "delete", "b", None, None), (3, "upsert", "c", "3", "z"), (4, "upsert", "c", "4", "z")], schema)
    events.coalesce(1).write.parquet(f"file://{source}")
    seen, at = [], [0]

    def write(df, batch):
        at[0] += 1
        df.write.parquet(f"file://{store}/{at[0]}")

    query = stream.maintain(spark, spark.readStream.schema(schema).parquet(f"file://{source}"), lambda: spark.read.parquet(f"file://{store}/{at[0]}"), write, lambda df, n: seen.extend(r["reason"] for r in df.collect()), f"file://{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert {(r["sheet_id"], r["geom_json"]) for r in spark.read.parquet(f"file://{store}/{at[0]}").collect()} == {("a", "2"), ("c", "4")}
    assert set(seen) == {"Sheet a geometry changed (old)", "Sheet a geometry changed (new)", "Sheet b deleted", "Sheet c added"}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:07:00", "a")], "ts string, op string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in stream.windowed_counts(rows).collect()) == [1, 2]


def test_text_masks_by_grown_boxes():
    """Boxes that grow by themselves mark what widening the whole mask after each box marks."""
    from cartaspark.operators import kernels as K

    rng = np.random.default_rng(8)
    for _ in range(40):
        boxes = list(zip(*rng.integers(-6, 30, (2, 5)).tolist(), *rng.integers(-3, 9, (2, 5)).tolist(), strict=True))
        border, iterations = (int(v) for v in rng.integers(0, (5, 3)))
        for engine in ("tesseract", "easyocr"):
            want = np.zeros((24, 31), np.uint8)
            for k, (x, y, w, h) in enumerate(boxes):
                want[max(0, y) : max(0, y + h + 1), max(0, x) : max(0, x + w + 1)] = 255
                for _ in range(iterations if border and (engine == "easyocr" or k == 4) else 0):
                    want = K.dilate(want, border, border)
            assert (H.text_mask(24, 31, boxes, engine, border, iterations) == want).all()


def test_pixels_under_text_of_many_sheets(spark):
    """Sheets stream by in batches smaller than they are, with boxes without a place among them."""
    rng = np.random.default_rng(9)
    rows = [(f"s{k % 7}" if k % 3 else None, k, *rng.integers(0, 60, 2).tolist(), *rng.integers(1, 9, 2).tolist()) for k in range(100)]
    rows += [("s1", 100, None, 2, 3, 4), ("empty", 101, None, 2, 3, 4), ("outside", 102, 500, 2, 3, 4)]
    boxes = spark.createDataFrame(rows, "sheet_id string, patch long, x long, y long, w long, h long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = {(r["sheet_id"], r["engine"]): r["pixels"] for r in H.text_pixels(boxes, "patch", 70, 130, 3, 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for sheet in {r[0] for r in rows} - {"empty", "outside"}:
        # a box without a place grows nothing itself, but those before it grow once more
        own = [r[2:] if r[2] is not None else (500, 0, 1, 1) for r in rows if r[0] == sheet]
        want |= {(sheet, e): int((H.text_mask(70, 130, own, e, 3, 1) > 0).sum()) for e in H.ENGINES}
    assert found == want
