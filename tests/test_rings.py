"""Contours, unions and buffers of rings and projections against brute force and known values."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cartaspark.functions import projections as J
from cartaspark.operators import contours as C, polygons as P


def flood(cells, steps):
    """Components of a set of cells."""
    left, out = set(cells), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            cell = todo.pop()
            if cell in left:
                left.remove(cell)
                own.add(cell)
                todo += [(cell[0] + i, cell[1] + j) for i, j in steps]
        out.append(own)
    return out


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([0.3, 0.5, 0.7]))
def test_contours_against_flood_fill(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    on = {(r, c) for r in range(h) for c in range(w) if mask[r, c]}
    parts = flood(on, EIGHT)
    off = flood({(r, c) for r in range(-1, h + 1) for c in range(-1, w + 1)} - on, FOUR)
    holes = [o for o in off if (-1, -1) not in o]
    found = C.trace(mask)
    box = lambda cells, more=0: (min(c for _, c in cells) - more, min(r for r, _ in cells) - more, np.ptp([c for _, c in cells]) + 1 + 2 * more, np.ptp([r for r, _ in cells]) + 1 + 2 * more)
    assert [x.box for x in found if not x.hole] == [box(p) for p in sorted(parts, key=min)]
    assert sorted((x.box, x.first) for x in found if x.hole) == sorted((box(o, 1), min(o)) for o in holes)
    for x in found:
        assert all(mask[r, c] for c, r in x.ring.tolist())
        outer = found[x.outer]
        assert not outer.hole and any({(r, c) for c, r in x.ring.tolist()} <= p and (outer.ring[0][1], outer.ring[0][0]) in p for p in parts)
    # rings: neighbours along straight runs only, and the cells that they enclose
    for x in found:
        step = np.roll(x.ring, -1, 0) - x.ring
        assert ((step[:, 0] == 0) | (step[:, 1] == 0) | (abs(step[:, 0]) == abs(step[:, 1]))).all()


def test_a_frame_with_two_holes():
    mask = np.zeros((12, 12), int)
    mask[2:10, 2:10] = 1
    mask[4:6, 4:6] = mask[7:9, 7:9] = 0
    found = C.trace(mask)
    assert [(x.hole, x.outer, x.first, x.box, x.area) for x in found] == [(False, 0, (2, 2), (2, 2, 8, 8), 49.0), (True, 0, (4, 4), (3, 3, 4, 4), 7.0), (True, 0, (7, 7), (6, 6, 4, 4), 7.0)]
    assert found[0].ring.tolist() == [[2, 2], [9, 2], [9, 9], [2, 9]] and found[0].length == 28
    assert C.first_hole(found, 0) == 2 and C.first_hole(found[:1], 0) is None
    assert C.trace(np.zeros((3, 3))) == [] and C.trace(np.ones((1, 1)))[0].ring.tolist() == [[0, 0]]


def test_contours_as_rows(spark):
    ring = np.zeros((6, 7), np.uint8)
    ring[1:5, 1:6] = 1
    ring[2:4, 2:5] = 0
    rows = [("a", 6, 7, bytearray(ring.tobytes()), "x"), ("none", 2, 2, bytearray(4), "x")]
    found = C.contour_rings(spark.createDataFrame(rows, "sheet_id string, height int, width int, data binary, ring string"))
    assert [(r["sheet_id"], r["contour"], r["parent"], r["x"], r["y"], r["w"], r["h"], r["area"]) for r in found.orderBy("contour").collect()] == [("a", 0, None, 1, 1, 5, 4, 12.0), ("a", 1, 0, 1, 1, 5, 4, 10.0)]
    assert [(r["holes"], r["hole_area"]) for r in C.with_holes(found).collect()] == [(1, 10.0)]


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 7), st.integers(1, 7), st.booleans()), min_size=1, max_size=8))
def test_unions_of_boxes_against_cells(boxes):
    cells = {(a, b) for x, y, w, h, _ in boxes for a in range(x, x + w) for b in range(y, y + h)}
    rings = [box(x, y, w, h)[:: -1 if turned else 1] for x, y, w, h, turned in boxes]
    found = P.union(rings)
    assert sum(P.doubled_area(r) for r in found) / 2 == len(cells)
    parts = flood(cells, FOUR)
    assert sum(P.doubled_area(r) > 0 for r in found) == len(parts)
    if len(parts) == 1:
        ring = P.cutline(rings)
        assert P.doubled_area(ring) < 0
    else:
        with pytest.raises(P.NotOnePolygon):
            P.cutline(rings)


def test_unions_of_triangles_against_points():
    rng = np.random.default_rng(3)
    points = rng.random((4000, 2)) * 10
    for _ in range(20):
        rings = [rng.random((3, 2)) * 10 for _ in range(5)]
        covered = np.any([P.contains([r], points) for r in rings], axis=0)
        assert (covered != P.contains(P.union(rings), points)).mean() < 1e-3


def test_buffers():
    ell = np.array([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)], float)
    area = lambda rings: [round(P.doubled_area(r) / 2, 4) for r in rings]
    assert area(P.buffer(ell, 1)) == [108.0] and area(P.buffer(ell[::-1], -1)) == [28.0]
    assert P.buffer(ell, -2.5) == [] and P.buffer(ell[:2], 1) == []
    assert area(P.buffer(ell, 0)) == [64.0]
    # the waist of a dumb-bell collapses: two parts are left
    waist = np.array([(0, 0), (10, 0), (10, 4), (20, 4), (20, 0), (30, 0), (30, 10), (20, 10), (20, 6), (10, 6), (10, 10), (0, 10)], float)
    assert area(P.buffer(waist, -1.5)) == [49.0, 49.0]
    # the mouth of a narrow bay closes: a hole is left
    bay = np.array([(0, 0), (30, 0), (30, 20), (16, 20), (16, 14), (20, 14), (20, 6), (10, 6), (10, 14), (14, 14), (14, 20), (0, 20)], float)
    assert sorted(area(P.buffer(bay, 1.5))) == [-35.0, 759.0]
    # a mitre of a sharp corner is cut off five shifts away
    spike = P.buffer(np.array([(0, 0), (10, 0), (0, 0.2)], float), 1)[0]
    assert np.hypot(*(spike - (10, 0)).T).max() < 12 and spike[:, 0].max() < 10 + 5.1
    assert P.contains([ell], [(1, 1), (5, 5), (0, 5), (4, 4), (-1, 2)]).tolist() == [True, False, False, False, False]


def test_cutlines_of_sheets(spark):
    ring = lambda r: [(float(x), float(y)) for x, y in r]
    schema = "sheet_id string, ring array<struct<x:double,y:double>>"
    corners = spark.createDataFrame([("a", ring(box(0, 0, 10, 10))), ("b", ring(box(0, 0, 4, 4))), ("c", None), ("d", ring(box(1, 1, 2, 2)))], schema)
    more = spark.createDataFrame([("a", ring(box(8, 2, 6, 3))), ("b", ring(box(6, 6, 2, 2))), ("d", ring(box(1, 1, 2, 2)[:2]))], schema)
    found = {r["sheet_id"]: r for r in P.cutlines(corners, more).collect()}
    assert found.keys() == {"a", "b", "d"}
    assert (found["a"]["area"], found["a"]["holes"], found["a"]["problem"]) == (112.0, 0, None)
    assert [tuple(p) for p in found["a"]["ring"]] == [(0, 0), (0, 10), (10, 10), (10, 5), (14, 5), (14, 2), (10, 2), (10, 0), (0, 0)]
    assert found["b"]["ring"] is None and "not 2" in found["b"]["problem"] and found["d"]["area"] == 4.0
    narrow = corners.withColumn("by", F.when(F.col("sheet_id") == "a", -1.0).otherwise(-3.0))
    parts = {r["sheet_id"]: len(r["parts"]) for r in P.buffered(narrow, "by").collect()}
    assert parts == {"a": 1, "b": 0, "d": 0}


def test_published_values_of_projections(spark):
    row = spark.range(1)
    value = lambda *columns: tuple(row.select(*columns).first())
    # CN Tower (zone 17 north) by its published UTM coordinates
    x, y = J.utm(17).forward(F.lit(-79.387139), F.lit(43.642567))
    assert np.allclose(value(x, y), (630084, 4833438), atol=1.0)
    # on the central meridian the easting is the false one, the northing the scaled arc; the quarter of the WGS 84 meridian is 10,001,965.729 m
    x, y = J.TransverseMercator(lon0=0.0).forward(F.lit(0.0), F.lit(90.0 - 1e-9))
    assert np.allclose(value(x, y), (0, 10001965.729), atol=2e-3)
    lon, lat = J.utm(33, south=True).inverse(*J.utm(33, south=True).forward(F.lit(17.9), F.lit(-33.2)))
    assert np.allclose(value(lon, lat), (17.9, -33.2), atol=1e-11)
    # there and back between datums, and no change without a shift
    shift = (283.0, 682.0, 231.0, 0.0, 0.0, 0.0, 0.0)
    there = J.shift_datum(F.lit(77.5), F.lit(23.0), J.ELLIPSOIDS["Everest1830"], J.ELLIPSOIDS["WGS84"], shift)
    back = J.shift_datum(*there, J.ELLIPSOIDS["WGS84"], J.ELLIPSOIDS["Everest1830"], tuple(-v for v in shift))
    assert np.allclose(value(*back), (77.5, 23.0), atol=1e-9) and abs(value(*there)[0] - 77.5) > 1e-4
    same = J.shift_datum(F.lit(-12.0), F.lit(61.0), J.ELLIPSOIDS["GRS80"], J.ELLIPSOIDS["GRS80"], (0.0,) * 7)
    assert np.allclose(value(*same), (-12.0, 61.0), atol=1e-11)


def test_contours_of_masks_with_missing_pixels():
    """A hole ends at missing pixels; set pixels do not meet over them."""
    mask = np.zeros((8, 8), bool)
    mask[2, 1:7] = mask[3:5, [1, 6]] = True
    unset = ~mask
    assert [(x.hole, x.box) for x in C.trace(mask, unset)] == [(False, (1, 2, 6, 3))]
    unset[5:] = False  # the lower part of the image is missing
    found = C.trace(mask, unset)
    assert [(x.hole, x.outer, x.box) for x in found] == [(False, 0, (1, 2, 6, 3)), (True, 0, (1, 2, 6, 4))] and found[1].first == (3, 2)
    mask[2, 6] = mask[3, 1] = False  # and so is the pixel left of the hole's first one: it is no contour's
    assert not any(x.hole for x in C.trace(mask, unset))


@pytest.mark.parametrize("kept", [1, 2, 3, 6])
def test_contour_rings_of_sheets_in_parts(spark, tmp_path, kept):
    """Numbers of vectors that four does not divide leave a sheet with missing quarters."""
    import duckdb

    from cartaspark.plans.queries import ORACLES, QUERIES

    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(f"vec_id < 40 or vec_id between 45 and {44 + kept} or vec_id = 63").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT sheet_id, x, y, w, h, holes FROM ({ORACLES['contour_rings']})").fetchall()
    assert sorted(map(tuple, QUERIES["contour_rings"](spark, str(tmp_path)).collect())) == sorted(want)


def test_buffers_of_many_rings_are_made_together(monkeypatch):
    """Rings of a batch widened at once are those widened one by one, by few passes over their edges."""
    rng = np.random.default_rng(5)
    rings, by = [], rng.choice([-2.0, -1.0, 0.0, 1.5, 3.0], 60)
    for k in range(60):
        angle = np.sort(rng.random(int(rng.integers(3, 9)))) * 2 * np.pi
        rings.append((np.column_stack([np.cos(angle), np.sin(angle)]) * (rng.random(len(angle)) * 10 + 2)[:, None])[:: -1 if k % 2 else 1])
    rings[7], rings[8], rings[9] = rings[7][:2], np.full((4, 2), np.nan), np.ones((3, 2))  # nothing is enclosed
    passes, real = [], P._pieces
    monkeypatch.setattr(P, "_pieces", lambda *edges: passes.append(1) or real(*edges))
    found = P.buffers(P.Rings(np.concatenate(rings), np.array([len(r) for r in rings]), np.arange(60)), by)
    assert len(passes) == 1
    for k in range(60):
        assert [r.tolist() for r in found.within(k, k + 1).split()] == [r.tolist() for r in P.buffer(rings[k], by[k])]


def test_a_point_for_each_row(spark, tmp_path):
    """An order that comes twice is two rows, not four."""
    import duckdb

    from cartaspark.plans.queries import ORACLES, QUERIES

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.unionByName(orders.limit(200)).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT patch, sheet_id, inside FROM ({ORACLES['point_in_buffer']})").fetchall()
    assert sorted(map(tuple, QUERIES["point_in_buffer"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("rows", [1, 3, 50])
def test_sheets_stream_by_in_batches(monkeypatch, rows):
    """Sheets that go on over batches, one so large that its rings are united on the way; rings that enclose nothing."""
    import pyarrow as pa

    monkeypatch.setattr(P, "EDGES", 40)
    rng = np.random.default_rng(6)
    boxes = {"a": 5, "b": 120, "c": 1, None: 9, "z": 2}
    rings = [(s, [tuple(map(float, p)) for p in box(*rng.integers(0, 30, 2), *rng.integers(1, 9, 2))][:: int(rng.choice((1, -1)))]) for s, n in boxes.items() for _ in range(n)]
    rings += [("z", [(0.0, 0.0), (9.0, 9.0)]), ("zz", [(0.0, None), (9.0, 0.0), (9.0, 9.0)])]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    table = pa.table({"sheet_id": pa.array([s for s, _ in rings], pa.string()), "ring": pa.array([[{"x": x, "y": y} for x, y in r] for _, r in rings], kind)})
    found, seen = {}, 0
    for ids, part in P._sheets(iter(table.to_batches(max_chunksize=rows)), True):
        area, holes = P._measures(P._faces(part, True), len(ids))
        seen += len(ids)
        found |= dict(zip(ids.to_pylist(), zip(area.tolist(), holes.tolist(), strict=True), strict=True))
    want = {}
    for sheet in [*boxes, "zz"]:
        own = P.union([np.array(r) for s, r in rings if s == sheet and None not in r[0]])
        want[sheet] = (sum(map(P.doubled_area, own)) / 2, sum(P.doubled_area(r) < 0 for r in own))
    assert found == want and seen == len(want)


def test_areas_of_sheets_without_an_id(spark, tmp_path):
    """Orders without a customer have no place: their sheet's area is none."""
    import duckdb

    from cartaspark.plans.queries import ORACLES, QUERIES

    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_custkey", F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey"))).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT sheet_id, area FROM ({ORACLES['cutline_union']})").fetchall()
    assert (None, 0) in want
    assert sorted(map(tuple, QUERIES["cutline_union"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
