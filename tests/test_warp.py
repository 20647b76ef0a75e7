"""Block-wise warping against the whole-image one, resampling kernels, and what tasks hold."""

import numpy as np
import pytest

from cartaspark.operators import kernels as K, sheets as H, warp as W

GCPS = "sheet_id string, gcps array<struct<px:double,py:double,x:double,y:double>>"
#: Corners and two bends of a sheet of 700 x 600 pixels, over several tiles of zoom 6.
BENT = [(20.0, 15.0, 10.0, 20.0), (8.0, 300.0, 9.5, 14.0), (25.0, 580.0, 10.0, 8.0), (680.0, 590.0, 24.0, 8.0), (660.0, 290.0, 23.0, 14.5), (690.0, 10.0, 24.0, 20.0)]
CUT = '{"warp_resampling_method": "%s", "pixel_cutlines": [[[650, 100], [699, 100], [699, 500], [650, 500]]]}'


def pictures(spark, extras):
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", 600, 700, bytearray(rng.integers(0, 256, (600, 700, 3), dtype=np.uint8).tobytes()), e) for k, e in enumerate(extras)]
    return spark.createDataFrame(rows, H.IMAGE + ", extra string"), spark.createDataFrame([(r[0], BENT) for r in rows], GCPS)


def content(df):
    return {(r["sheet_id"], r["z"], r["x"], r["y"], r["height"], r["width"]): bytes(r["data"]) for r in df.collect()}


@pytest.mark.parametrize("block", [64, 333, 1024])
def test_blocks_give_the_same_tiles(spark, block):
    images, gcps = pictures(spark, [None, *(CUT % m for m in K.REACH)])
    whole, parts = content(W.warp_to_tiles(images, gcps, 6, 64)), content(W.warp_blocks(images, gcps, 6, 64, block))
    assert whole == parts and len({k[2:4] for k in whole}) >= 6
    assert all(sum(np.frombuffer(d, np.uint8)[3::4].any() for k, d in whole.items() if k[0] == s) >= 6 for s in ("s0", "s4"))
    assert len({whole[k] for k in whole if k[0] == "s0"}) > 6


def test_sheets_without_options_control_points_or_rows(spark):
    images, gcps = pictures(spark, [None])
    assert content(W.warp_blocks(images.drop("extra"), gcps, 6, 64)) == content(W.warp_to_tiles(images, gcps, 6, 64))
    assert W.warp_blocks(images, gcps.limit(0), 6, 64).count() == 0 and W.warp_blocks(images.limit(0), gcps, 6, 64).count() == 0


def test_tiles_need_only_their_surroundings(spark):
    images, gcps = pictures(spark, [None])
    need = W.tile_needs(images, gcps, 8, 64, 64).collect()
    assert len(need) > 50 and max((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in need) < 600 * 700 / 20
    assert max(len(r["blocks"]) for r in need) <= 9


def test_blocks_cover_the_image(spark):
    images, _ = pictures(spark, [None])
    image, seen = np.frombuffer(images.first()["data"], np.uint8).reshape(600, 700, 3), 0
    for r in W.cut_blocks(images, 256).collect():
        part = np.frombuffer(r["data"], np.uint8).reshape(r["rows"], r["columns"], 3)
        assert (part == image[r["by"] * 256 :, r["bx"] * 256 :][: r["rows"], : r["columns"]]).all()
        seen += part.size
    assert seen == image.size


@pytest.mark.parametrize("method", ["cubic", "lanczos"])
def test_kernels(method):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    yy, xx = np.mgrid[:30, :40]
    assert (K.sample(image, xx.astype(float), yy.astype(float), method) == image).all()  # a pixel's own place
    flat = np.full((30, 40), 77, np.uint8)
    assert (K.sample(flat, rng.uniform(-0.4, 39.4, 200), rng.uniform(-0.4, 29.4, 200), method) == 77).all()  # borders do not darken
    slope = np.tile(np.arange(40.0) * 5, (30, 1))
    inner = rng.uniform(4, 35, 200)
    assert np.abs(K.sample(slope, inner, np.full(200, 12.3), method) - 5 * inner).max() < (1e-9 if method == "cubic" else 0.6)
    assert (K.sample(image, np.array([-0.6, 40.0]), np.array([3.0, 3.0]), method, fill=9) == 9).all()


def test_cubic_of_a_step_is_known():
    row = np.array([[0.0, 0, 0, 16, 16, 16]])
    at = lambda x: float(K.sample(np.repeat(row, 6, 0), np.array([x]), np.array([3.0]), "cubic")[0])
    assert at(2.5) == pytest.approx(8) and at(1.5) == pytest.approx(-1) and at(3.5) == pytest.approx(17)


def test_unknown_methods():
    with pytest.raises(ValueError, match="unknown resampling method"):
        H.SheetOptions(warp_resampling_method="magic")
    with pytest.raises(ValueError, match="unknown resampling method"):
        K.sample(np.zeros((3, 3)), np.zeros(1), np.zeros(1), "magic")
