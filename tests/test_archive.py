"""Tile archives: numbering, directories, round trips, pruning, precedence, faults."""

import glob
import os

import numpy as np
import pytest
from hypothesis import given, strategies as st

from cartaspark.functions.tilemath import tile_id
from cartaspark.plans import pipelines
from cartaspark.sources import archive as A
from pyspark.sql import functions as F

SCHEMA = "z int, x long, y long, data binary"


def numbered(spark, tiles):
    rows = spark.createDataFrame(tiles, "z int, x long, y long")
    return [r[0] for r in rows.select(tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()]


def test_published_numbers(spark):
    tiles = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (12, 3423, 1763)]
    assert numbered(spark, tiles) == [0, 1, 2, 3, 4, 5, 19078479]


def test_tiles_outside_their_zoom_have_no_number(spark):
    assert numbered(spark, [(1, 2, 0), (1, 0, -1), (-1, 0, 0), (32, 0, 0), (None, 0, 0), (3, None, 1)]) == [None] * 6


def test_numbers_are_a_walk_over_all_tiles(spark):
    rows = spark.range(4**5).select(F.lit(5).alias("z"), (F.col("id") % 32).alias("x"), F.expr("id div 32").alias("y"))
    found = sorted((r["n"], r["x"], r["y"]) for r in rows.withColumn("n", tile_id(F.col("z"), F.col("x"), F.col("y"))).collect())
    assert [n for n, _, _ in found] == list(range(341, 341 + 1024))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(found, found[1:]))
    z, x, y = A.tiles_of(np.array([n for n, _, _ in found]))
    assert z.tolist() == [5] * 1024 and list(zip(x.tolist(), y.tolist())) == [f[1:] for f in found]


def test_numbers_of_the_deepest_zoom(spark):
    tiles = [(31, 2**31 - 1, 0), (31, 0, 2**31 - 1), (31, 12345678, 2**30), (26, 2**26 - 1, 2**26 - 1)]
    z, x, y = A.tiles_of(np.array(numbered(spark, tiles), np.uint64))
    assert list(zip(z.tolist(), x.tolist(), y.tolist())) == tiles


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_varints(values):
    assert A.from_varints(A.to_varints(np.array(values, np.uint64))).tolist() == values


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 3), st.integers(1, 99), st.integers(0, 1000)), max_size=40))
def test_directories(entries):
    columns = [np.array([e[k] for e in entries], np.uint64) for k in range(4)]
    columns[0] = np.cumsum(columns[0])
    for before, after in zip(columns, A.unpack_directory(A.pack_directory(*columns)), strict=True):
        assert before.tolist() == after.tolist()


def rows_of(df):
    return sorted((r["z"], r["x"], r["y"], bytes(r["data"])) for r in df.collect())


def some_tiles(zooms=range(5)):
    return [(z, x, y, b"sea" if (x + y) % 3 else f"{z}/{x}/{y}".encode()) for z in zooms for x in range(1 << z) for y in range(1 << z)]


@pytest.mark.parametrize("part_bytes", [1, 100, 1 << 20])
def test_round_trip(spark, tmp_path, part_bytes):
    tiles = some_tiles(range(5 if part_bytes > 1 else 3))
    A.write_archives(spark.createDataFrame(tiles, SCHEMA).repartition(3), str(tmp_path / "set"), "png", '{"name": "n"}', part_bytes)
    assert rows_of(A.read_archive(spark, str(tmp_path / "set"))) == sorted(tiles)
    parts = A.read_archive(spark, str(tmp_path / "set"), "parts").collect()
    assert sum(p["n_tiles"] for p in parts) == len(tiles) and all(p["format"] == "png" and p["metadata"] == '{"name": "n"}' for p in parts)
    if part_bytes == 1 << 20:
        ids = sorted((n, t[3]) for n, t in zip(numbered(spark, [t[:3] for t in tiles]), tiles, strict=True))
        entries = 1 + sum(b[0] != a[0] + 1 or a[1] != b[1] for a, b in zip(ids, ids[1:]))
        assert [(p["n_entries"], p["n_contents"]) for p in parts] == [(entries, len({t[3] for t in tiles}))]
    else:
        assert len(parts) > 3


def test_leaf_directories_and_pruning(spark, tmp_path):
    """More entries than a root holds: leaves become partitions, and those of other zooms are not read."""
    whole = spark.range(4**7 + 4**8).select(F.when(F.col("id") < 4**7, 7).otherwise(8).alias("z"), F.when(F.col("id") < 4**7, F.col("id")).otherwise(F.col("id") - 4**7).alias("i"))
    side = F.when(F.col("z") == 7, 128).otherwise(256)
    tiles = whole.select("z", (F.col("i") % side).alias("x"), F.floor(F.col("i") / side).alias("y")).withColumn("data", F.unhex(F.expr("substring(sha2(concat_ws('/', z, x, y), 256), 1, 8 + 2 * pmod(xxhash64(z, x, y), 28))")))
    path = str(tmp_path / "set")
    A.write_archives(tiles, path, "png", part_bytes=1 << 30)
    assert len(glob.glob(f"{path}/*.pmtiles")) == 1
    every, seven = A.read_archive(spark, path), A.read_archive(spark, path).where("z = 7")
    assert every.rdd.getNumPartitions() >= 10 and seven.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 2
    assert seven.count() == 4**7 and every.exceptAll(tiles.select(F.col("z").cast("int").alias("z"), "x", "y", "data")).isEmpty() and every.count() == 4**7 + 4**8
    assert seven.where("x < 3").count() == 3 * 128 and every.where("z > 8").count() == 0 and every.where("z in (6, 7) and z <= 7").count() == 4**7
    with open(glob.glob(f"{path}/*.pmtiles")[0], "rb") as f:
        v = A.HEADER.unpack(f.read(A.HEADER.size))
    assert v[2] == A.HEADER.size and v[2] + v[3] <= A.HEAD_BYTES and v[10] == 4**7 + 4**8 and v[17:19] == (7, 8)
    assert v[19] == -1_800_000_000 and v[21] == 1_800_000_000 and v[22] == -v[20] and abs(v[22] - 850511288) <= 1


def test_long_runs_come_in_bounded_batches(tmp_path):
    part = A._Part()
    for i in range(1365, 1365 + 4096):
        part.add(i, b"x" * 10_000)
    path = tmp_path / "one.pmtiles"
    path.write_bytes(b"".join(part.file("png", "{}")))
    assert path.stat().st_size < 12_000
    reader = A.ArchiveReader(str(path), False)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 4096 and max(b.num_rows for b in batches) * 10_000 <= A.BATCH_BYTES


def test_runs_across_zooms_are_cut(spark, tmp_path):
    tiles = [t[:3] + (b"sea",) for t in some_tiles(range(4))]
    A.write_archives(spark.createDataFrame(tiles, SCHEMA), str(tmp_path / "set"), "png")
    assert [p["n_entries"] for p in A.read_archive(spark, str(tmp_path / "set"), "parts").collect()] == [1]
    assert rows_of(A.read_archive(spark, str(tmp_path / "set")).where("z = 2")) == sorted(t for t in tiles if t[0] == 2)


def test_empty_tables_and_empty_tiles(spark, tmp_path):
    A.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "png")
    assert rows_of(A.read_archive(spark, str(tmp_path / "none"))) == []
    A.write_archives(spark.createDataFrame([(1, 0, 0, b""), (1, 0, 1, b""), (1, 1, 1, b"a")], SCHEMA), str(tmp_path / "set"), "jpg")
    assert rows_of(A.read_archive(spark, str(tmp_path / "set"))) == [(1, 0, 0, b""), (1, 0, 1, b""), (1, 1, 1, b"a")]


@pytest.mark.parametrize("bad", [[(1, 0, 0, b"a"), (1, 0, 0, b"b")], [(1, 2, 0, b"a")], [(1, 0, 0, None)]])
def test_bad_tiles_change_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "set")
    good = [(1, 0, 0, b"a"), (1, 1, 0, b"b")]
    A.write_archives(spark.createDataFrame(good, SCHEMA), path, "png")
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="comes twice|without data"):
        A.write_archives(spark.createDataFrame(bad, SCHEMA), path, "png")
    assert rows_of(A.read_archive(spark, path)) == good and sorted(f for f in os.listdir(path) if not f.endswith(".crc")) == before


def test_append_replace_and_readers_of_the_set_before(spark, tmp_path):
    path = str(tmp_path / "set")
    make = lambda tiles, **more: A.write_archives(spark.createDataFrame(tiles, SCHEMA), path, "png", **more)
    make([(1, 0, 0, b"a")])
    make([(1, 0, 1, b"b")], append=True)
    assert rows_of(A.read_archive(spark, path)) == [(1, 0, 0, b"a"), (1, 0, 1, b"b")]
    old = glob.glob(f"{path}/*.pmtiles")
    make([(2, 0, 0, b"c")])
    assert rows_of(A.read_archive(spark, path)) == [(2, 0, 0, b"c")] and all(map(os.path.exists, old))
    make([(2, 0, 0, b"d")])
    assert rows_of(A.read_archive(spark, path)) == [(2, 0, 0, b"d")] and not any(map(os.path.exists, old))


def test_partition_takes_new_tiles_before_old_and_drops_clear_ones(spark, tmp_path):
    old, path = str(tmp_path / "old"), str(tmp_path / "merged")
    A.write_archives(spark.createDataFrame([(1, 0, 0, b"old"), (1, 1, 0, b"old"), (1, 1, 1, b"gone")], SCHEMA), old, "png")
    new = spark.createDataFrame([(1, 0, 0, b"new", False), (1, 1, 1, b"", True)], SCHEMA + ", is_transparent boolean")
    pipelines.partition([new, A.read_archive(spark, old)], path, "png")
    assert rows_of(A.read_archive(spark, path)) == [(1, 0, 0, b"new"), (1, 1, 0, b"old")]
    both = A.read_archives(spark, [path, f"{old}/*.pmtiles"])
    assert rows_of(both) == [(1, 0, 0, b"new"), (1, 1, 0, b"old"), (1, 1, 1, b"gone")]


def test_faults(spark, tmp_path):
    with pytest.raises(Exception, match="no tile archives"):
        A.read_archive(spark, str(tmp_path / "no*.pmtiles")).count()
    (tmp_path / "bad.pmtiles").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="is no tile archive"):
        A.read_archive(spark, str(tmp_path / "bad.pmtiles")).count()
    with pytest.raises(ValueError, match="unknown tile extension"):
        A.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "x"), "gif")
