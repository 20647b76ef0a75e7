"""JPEG coding against the JVM's decoder, its sizes and errors, and its places in the procedures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartaspark.operators import jpeg, sheets, tiles as T
from cartaspark.plans import pipelines
from cartaspark.sources import images, tilestore


def scene(h, w, seed=1):
    """Smooth colours, lines and some noise."""
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    image = np.stack([120 + 80 * np.sin(x / 19), 100 + y * 90 / max(h, 1), 128 + 60 * np.cos((x + y) / 23)], -1) + rng.normal(0, 3, (h, w, 3))
    image[h // 3 : h // 3 + 2] = 20
    image[:, w // 2 : w // 2 + 1] = (30, 30, 200)
    return np.clip(image, 0, 255).astype(np.uint8)


def decoded(spark, folder):
    rows = images.read_images(spark, f"file://{folder}", ".jpg").collect()
    return {r.sheet_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3).astype(int) for r in rows}


def test_the_jvm_decodes_what_round_trip_says(spark, tmp_path):
    cases = {f"s{h}x{w}q{q}": (scene(h, w), q) for h, w in ((64, 96), (1, 1), (13, 21), (17, 16), (250, 259)) for q in (10, 50, 75, 95, 100)}
    cases["flat"] = np.full((40, 40, 3), 77, np.uint8), 75
    cases["noise"] = np.random.default_rng(5).integers(0, 256, (120, 80, 3)).astype(np.uint8), 100
    cases["sparse"] = np.where(np.random.default_rng(6).random((128, 128, 1)) < 0.002, 255, 0).astype(np.uint8).repeat(3, 2), 90
    for name, (image, q) in cases.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(image, q))
    got = decoded(spark, tmp_path)
    assert got.keys() == cases.keys()
    for name, (image, q) in cases.items():
        away = np.abs(got[name] - jpeg.round_trip(image, q).astype(int))
        assert away.max() <= 4 and away.mean() < 0.7, (name, away.max(), away.mean())


def test_quality_sets_size_and_error():
    image = scene(256, 256)
    qualities = (10, 30, 50, 75, 90, 95, 100)
    sizes = [len(jpeg.encode(image, q)) for q in qualities]
    errors = [np.abs(jpeg.round_trip(image, q).astype(int) - image).mean() for q in qualities]
    assert sizes == sorted(sizes) and errors == sorted(errors, reverse=True)
    assert sizes[3] < image.size / 8
    assert all(e < most for e, most in zip(errors, (9, 6.5, 5.5, 4.5, 3.5, 3.2, 3), strict=True)), errors
    smooth = np.repeat(scene(32, 32, 2)[..., :1] // 2 + 60, 3, 2)
    assert np.abs(jpeg.round_trip(smooth, 100).astype(int) - smooth).max() <= 2  # without colour nothing is halved


def test_codes_are_no_longer_than_allowed_and_prefix_free():
    counts = np.zeros(256, int)
    counts[:40] = [int(1.6**k) + 1 for k in range(40)]
    codes, lengths, table = jpeg._codes(counts)
    used = [format(codes[s], f"0{lengths[s]}b") for s in range(40)]
    assert max(map(len, used)) <= 16 and "1" not in {u for u in used if set(u) == {"1"}} and sum(table[:16]) == 40
    assert not any(a != b and b.startswith(a) for a in used for b in used) and not any(set(u) == {"1"} for u in used)
    alone = np.zeros(256, int)
    alone[7] = 3
    assert jpeg._codes(alone)[1][7] == 1


def test_wrong_sizes_and_qualities():
    for q in (0, 101):
        with pytest.raises(ValueError, match="quality"):
            jpeg.encode(scene(8, 8), q)
    for shape in ((0, 5, 3), (1, 65536, 3)):
        with pytest.raises(ValueError, match="no JPEG"):
            jpeg.encode(np.zeros(shape, np.uint8))


def test_tiles_keep_their_opacity_as_a_mask(spark):
    whole = np.dstack([scene(16, 16), np.full((16, 16), 255, np.uint8)])
    part = whole.copy()
    part[:, :5, 3] = 0
    rows = spark.createDataFrame([(1, 0, 0, whole.tobytes(), 90), (1, 1, 0, part.tobytes(), 20)], "z int, x long, y long, data binary, q int")
    one, two = T.encode_jpeg(rows, F.col("q"), 16).orderBy("x").collect()
    assert one.mask is None and bytes(one.data) == jpeg.encode(whole, 90) and bytes(two.data) == jpeg.encode(part, 20)
    assert (np.unpackbits(np.frombuffer(two.mask, np.uint8)).reshape(16, 16) == (part[..., 3] > 0)).all()


def test_a_sheet_sets_its_quality(spark):
    rows = spark.createDataFrame([("a", '{"jpeg_export_quality": 40}'), ("b", None), ("c", "{}"), ("d", '{"jpeg_export_quality": "no"}')], "sheet_id string, extra string")
    assert {r.sheet_id: r.q for r in rows.select("sheet_id", sheets.whole_option("jpeg_export_quality").alias("q")).collect()} == {"a": 40, "b": 75, "c": 75, "d": 75}
    for extra in ('{"jpeg_export_quality": 0}', '{"shrunk_jpeg_quality": 101}'):
        with pytest.raises(ValueError, match="quality"):
            sheets.SheetOptions.of(extra)


def test_two_writers_of_one_store_version(spark, tmp_path, monkeypatch):
    tiles = spark.createDataFrame([(1, 0, 0, b"a")], "z int, x long, y long, data binary")
    path = f"file://{tmp_path}/t"
    tilestore.write_store(tiles, path)
    monkeypatch.setattr(tilestore, "_versions", lambda *_: [])  # the other writer was not there yet when this one looked
    with pytest.raises(RuntimeError, match="another writer"):
        tilestore.write_store(tiles, path)
    monkeypatch.undo()
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v1"] and tilestore.read_store(spark, path).count() == 1


def test_a_pyramid_of_jpeg_tiles(spark, tmp_path):
    image = np.dstack([scene(16, 16), np.full((16, 16), 255, np.uint8)])
    blocks = spark.createDataFrame([("s", 1, 0, 0, image.tobytes()), ("s", 1, 1, 1, image.tobytes())], "sheet_id string, z int, x long, y long, data binary")
    about = pipelines.tile(blocks, f"file://{tmp_path}/t", "n", "d", "a", 1, extension="jpg", size=16, quality=60)
    assert '"format":"jpeg"' in about.first().value
    made = tilestore.read_store(spark, f"file://{tmp_path}/t")
    assert sorted(made.columns) == ["data", "x", "y", "z"] and made.count() == 3
    (tmp_path / "out").mkdir()
    for r in made.collect():
        (tmp_path / f"out/{r.z}-{r.x}-{r.y}.jpg").write_bytes(bytes(r.data))
    got = decoded(spark, tmp_path / "out")
    assert np.abs(got["1-1-1"] - jpeg.round_trip(image, 60).astype(int)).max() <= 4
    for extension, q in (("webp", 75), ("jpeg", 0)):
        with pytest.raises(ValueError):
            pipelines.tile(blocks, f"file://{tmp_path}/u", "n", "d", "a", 1, extension=extension, size=16, quality=q)
