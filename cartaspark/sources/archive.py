"""Tile archives: PMTiles version 3 files as a Spark data source, read and written in partitions.

A set of archives is a folder of parts and a list of those that count (`_parts.json`), which is replaced
by one rename, so a reader finds the set before or the set after.  One writer at a time; of two, the
later one's list counts.  Paths are those of pyarrow's file systems (file, hdfs, s3, gs); one without a
scheme is a path that the driver and all executors share.

Tasks read one directory leaf each and leave out what a filter on `z` excludes; they write parts of a
bounded size, which is also what they hold in memory.
"""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.tilemath import tile_id
from ..operators.retile import merged_archive
from .scratch import materialise
from .tilestore import tile_format

NAME = "tilearchive"
# fixed values of the format
MAGIC, VERSION, GZIP, PLAIN = b"PMTiles", 3, 2, 1
HEADER = struct.Struct("<7sB11Q6B4iB2i")
HEAD_BYTES = 16384  #: header and root directory lie in these
KINDS = {"png": 2, "jpeg": 3, "webp": 4}
MAX_ZOOM = 31
#: Number of the first tile of each zoom.
BASES = np.array([((1 << 2 * z) - 1) // 3 for z in range(MAX_ZOOM + 2)], np.uint64)

LEAF_ENTRIES = 4096
BATCH_BYTES = 8 << 20
PART_BYTES = 64 << 20
LIST = "_parts.json"
TILES = "z int, x long, y long, data binary"
PARTS = "part string, format string, min_zoom int, max_zoom int, n_tiles long, n_entries long, n_contents long, metadata string"


def to_varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the eighth bit says that more follow."""
    left = np.asarray(values, np.uint64)[:, None] >> (7 * np.arange(10, dtype=np.uint64))
    used = left > 0
    used[:, 0] = True
    coded = (left & np.uint64(127)) | np.where(left > 127, np.uint64(128), np.uint64(0))
    return coded[used].astype(np.uint8).tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    b = b[: ends[-1] + 1]
    within = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * within).astype(np.uint64), starts)


def pack_directory(ids: np.ndarray, runs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> bytes:
    """Entries of a directory in order of ids; a run of 0 marks a leaf directory."""
    ids, runs, lengths, offsets = (np.asarray(v, np.uint64) for v in (ids, runs, lengths, offsets))
    coded = offsets + np.uint64(1)
    coded[1:][offsets[1:] == offsets[:-1] + lengths[:-1]] = 0
    return gzip.compress(to_varints(np.concatenate([[np.uint64(len(ids))], np.diff(ids, prepend=np.uint64(0)), runs, lengths, coded])), mtime=0)


def unpack_directory(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, runs, lengths, offsets."""
    v = from_varints(gzip.decompress(data))
    n = int(v[0])
    steps, runs, lengths, coded = (v[1 + k * n : 1 + (k + 1) * n] for k in range(4))
    if not n:
        return steps, runs, lengths, coded
    before = np.cumsum(lengths) - lengths
    last = np.maximum.accumulate(np.where(coded > 0, np.arange(n), 0))  # the last entry that names its place
    return np.cumsum(steps), runs, lengths, coded[last] - np.uint64(1) + before - before[last]


def tiles_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, x, y of tile numbers; the inverse of tilemath.tile_id."""
    ids = np.asarray(ids, np.uint64)
    z = np.searchsorted(BASES, ids, "right") - 1
    t = (ids - BASES[z]).astype(np.int64)
    x, y = np.zeros_like(t), np.zeros_like(t)
    for k in range(int(z.max(initial=0))):
        on, side = z > k, np.int64(1 << k)
        rx = (t >> 1) & 1
        ry = (t ^ rx) & 1
        turned = np.where(ry == 0, np.where(rx == 1, side - 1 - y, y), x), np.where(ry == 0, np.where(rx == 1, side - 1 - x, x), y)
        x, y = np.where(on, turned[0] + side * rx, x), np.where(on, turned[1] + side * ry, y)
        t = np.where(on, t >> 2, t)
    return z.astype(np.int32), x, y


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:/", path) else (pafs.LocalFileSystem(), path)


def _bytes(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _listed(fs: pafs.FileSystem, folder: str) -> dict[str, list[str]]:
    """The set's parts, and those of the set before."""
    at = f"{folder}/{LIST}"
    return json.loads(_bytes(fs, at)) if fs.get_file_info(at).type == pafs.FileType.File else {"parts": [], "before": []}


def _parts(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The archives of a folder (those of its list, where it has one), of a file or of a pattern of files."""
    fs, at = _at(path.rstrip("/"))
    folder, _, pattern = at.rpartition("/")
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.File:
        return fs, [at]
    if kind == pafs.FileType.Directory:
        if fs.get_file_info(f"{at}/{LIST}").type == pafs.FileType.File:
            return fs, [f"{at}/{name}" for name in _listed(fs, at)["parts"]]
        folder, pattern = at, "*.pmtiles"
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True)) if fnmatch.fnmatch(f.base_name, pattern))
    if not found:
        raise ValueError(f"no tile archives at {path}")
    return fs, found


@dataclass
class Head:
    root: tuple[int, int]
    about: tuple[int, int]
    leaves: int
    data: int
    counts: tuple[int, int, int]
    kind: int
    zooms: tuple[int, int]
    codecs: tuple[int, int]

    @classmethod
    def of(cls, f: pa.NativeFile, path: str) -> Head:
        raw = f.read_at(HEADER.size, 0)
        if len(raw) < HEADER.size or raw[:7] != MAGIC or raw[7] != VERSION:
            raise ValueError(f"{path} is no tile archive of version {VERSION}")
        v = HEADER.unpack(raw)
        head = cls((v[2], v[3]), (v[4], v[5]), v[6], v[8], (v[10], v[11], v[12]), v[16], (v[17], v[18]), (v[14], v[15]))
        if head.codecs[0] != GZIP or head.codecs[1] != PLAIN:
            raise ValueError(f"{path}: directories must be gzip, tiles uncompressed; found codecs {head.codecs}")
        return head


@dataclass
class Leaf(InputPartition):
    """A directory (offset, length) of an archive."""

    path: str
    offset: int
    length: int


@dataclass
class Heads(InputPartition):
    """Archives whose headers are wanted."""

    paths: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, parts_only: bool):
        self.path, self.parts_only = path, parts_only
        self.zooms = set(range(MAX_ZOOM + 1))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kept = {
            EqualTo: lambda z, v: z == v,
            GreaterThan: lambda z, v: z > v,
            GreaterThanOrEqual: lambda z, v: z >= v,
            LessThan: lambda z, v: z < v,
            LessThanOrEqual: lambda z, v: z <= v,
            In: lambda z, v: z in v,
        }
        for f in filters:
            test = None if self.parts_only or getattr(f, "attribute", None) != ("z",) else kept.get(type(f))
            if test is None or f.value is None:
                yield f
            else:
                self.zooms = {z for z in self.zooms if test(z, f.value)}

    def _wanted(self, lo: int, hi: int) -> bool:
        """Whether any number from lo up to hi, hi not included, is of a wanted zoom."""
        return any(int(BASES[z]) < hi and int(BASES[z + 1]) > lo for z in self.zooms)

    def partitions(self) -> list[InputPartition]:
        fs, paths = _parts(self.path)
        if self.parts_only:
            return [Heads(paths[k : k + 100]) for k in range(0, len(paths), 100)] or [Heads([])]

        def leaves(path: str) -> list[Leaf]:
            with fs.open_input_file(path) as f:
                head = Head.of(f, path)
                if not any(head.zooms[0] <= z <= head.zooms[1] for z in self.zooms):
                    return []
                ids, runs, lengths, offsets = unpack_directory(f.read_at(head.root[1], head.root[0]))
            if runs.any() or not len(ids):  # tiles in the root: it is read as a whole, with the leaves that may stand beside them
                return [Leaf(path, *head.root)]
            ends = [*map(int, ids[1:]), int(BASES[-1])]
            return [Leaf(path, head.leaves + int(o), int(n)) for lo, hi, n, o in zip(ids.tolist(), ends, lengths.tolist(), offsets.tolist(), strict=True) if self._wanted(lo, hi)]

        with ThreadPoolExecutor(16) as pool:
            return [leaf for found in pool.map(leaves, paths) for leaf in found] or [Heads([])]

    def read(self, partition: Leaf | Heads) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        fs, _ = _at(self.path)
        if isinstance(partition, Heads):
            for path in partition.paths:
                with fs.open_input_file(path) as f:
                    head = Head.of(f, path)
                    about = gzip.decompress(f.read_at(head.about[1], head.about[0])).decode()
                kind = {v: k for k, v in KINDS.items()}.get(head.kind)
                yield path.rpartition("/")[2], kind, *head.zooms, *head.counts, about
            return
        with fs.open_input_file(partition.path) as f:
            head = Head.of(f, partition.path)
            batch, size = [], 0
            for first, n, length, offset in self._runs(f, head, partition.offset, partition.length):
                whole = max(1, BATCH_BYTES // max(1, length))
                for lo in range(0, n, whole):  # a long run of one tile is dealt to several batches
                    more = min(whole, n - lo)
                    if batch and size + more * length > BATCH_BYTES:
                        yield self._batch(f, head, batch)
                        batch, size = [], 0
                    batch.append((first + lo, more, length, offset))
                    size += more * length
            if batch:
                yield self._batch(f, head, batch)

    def _runs(self, f: pa.NativeFile, head: Head, offset: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Entries (first number, tiles, length, offset) of a directory and the leaves below it, cut to wanted zooms."""
        ids, runs, lengths, offsets = (v.tolist() for v in unpack_directory(f.read_at(length, offset)))
        for k, (first, n, size, place) in enumerate(zip(ids, runs, lengths, offsets, strict=True)):
            if not n:
                if self._wanted(first, ids[k + 1] if k + 1 < len(ids) else int(BASES[-1])):
                    yield from self._runs(f, head, head.leaves + place, size)
                continue
            for z in sorted(self.zooms):
                lo, hi = max(first, int(BASES[z])), min(first + n, int(BASES[z + 1]))
                if lo < hi:
                    yield lo, hi - lo, size, place

    @staticmethod
    def _batch(f: pa.NativeFile, head: Head, entries: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        """Rows of the entries; neighbours in the file are read at once."""
        contents, k = [], 0
        while k < len(entries):
            end, last = entries[k][3] + entries[k][2], k + 1
            while last < len(entries) and entries[last][3] == end:
                end += entries[last][2]
                last += 1
            start = entries[k][3]
            raw = f.read_at(end - start, head.data + start)
            for _, n, length, offset in entries[k:last]:
                contents += [raw[offset - start : offset - start + length]] * n
            k = last
        ids = np.concatenate([np.arange(first, first + n, dtype=np.uint64) for first, n, _, _ in entries])
        z, x, y = tiles_of(ids)
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(contents, pa.binary())], names=["z", "x", "y", "data"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, str]]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (tile_id, data), sorted by tile_id within a partition, to parts of at most `part_bytes` of tiles (one tile at least)."""

    def __init__(self, path: str, kind: str, about: str, part_bytes: int, overwrite: bool):
        self.path, self.kind, self.about, self.part_bytes, self.overwrite = path.rstrip("/"), kind, about, part_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _at(self.path)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[int, str]] = []
        part, last = _Part(), -1
        try:
            for batch in iterator:
                for i, data in zip(batch.column("tile_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if i is None or data is None:
                        raise ValueError("a tile without data, or one outside its zoom")
                    if i <= last:
                        raise ValueError("a tile that comes twice: z {} x {} y {}".format(*(int(v[0]) for v in tiles_of(np.array([i])))))
                    if part.ids and len(part.data) + len(data) > self.part_bytes:
                        done.append(self._save(fs, folder, part))
                        part = _Part()
                    part.add(i, data)
                    last = i
            if part.ids:
                done.append(self._save(fs, folder, part))
        except BaseException:
            for _, name in done:
                fs.delete_file(f"{folder}/{name}")
            raise
        return Written(done)

    def _save(self, fs: pafs.FileSystem, folder: str, part: _Part) -> tuple[int, str]:
        name = f"part-{uuid.uuid4().hex}.pmtiles"
        with fs.open_output_stream(f"{folder}/{name}") as f:
            for piece in part.file(self.kind, self.about):
                f.write(piece)
        return part.ids[0], name

    def commit(self, messages: list[Written | None]) -> None:
        """Make the parts of the tasks that count the set (or, when appending, add them), delete what neither this set nor the one before names."""
        fs, folder = _at(self.path)
        fs.create_dir(folder, recursive=True)
        old = _listed(fs, folder)["parts"]
        new = [name for _, name in sorted(p for m in messages if m for p in m.parts)]
        parts = new if self.overwrite else old + new
        fresh = f"{folder}/_new-{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps({"parts": parts, "before": old}).encode())
        fs.move(fresh, f"{folder}/{LIST}")
        keep = {*parts, *old}
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if re.fullmatch(r"part-[0-9a-f]{32}\.pmtiles", info.base_name) and info.base_name not in keep:
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _at(self.path)
        for m in messages:
            for _, name in m.parts if m else ():
                fs.delete_file(f"{folder}/{name}")


class _Part:
    """An archive in the making: equal tiles are stored once, and neighbours that are equal share an entry."""

    def __init__(self) -> None:
        self.data, self.known = bytearray(), {}
        self.ids, self.runs, self.lengths, self.offsets = [], [], [], []

    def add(self, i: int, data: bytes) -> None:
        digest = hashlib.sha256(data).digest()
        offset = self.known.get(digest)
        if offset is None:
            offset = self.known[digest] = len(self.data)
            self.data += data
        if self.ids and self.offsets[-1] == offset and self.lengths[-1] == len(data) and self.ids[-1] + self.runs[-1] == i:
            self.runs[-1] += 1
            return
        for column, value in ((self.ids, i), (self.runs, 1), (self.lengths, len(data)), (self.offsets, offset)):
            column.append(value)

    def file(self, kind: str, about: str) -> Iterator[bytes]:
        """Header, root directory, metadata, leaf directories, tiles."""
        columns = [np.array(v, np.uint64) for v in (self.ids, self.runs, self.lengths, self.offsets)]
        root, leaves, step = pack_directory(*columns), b"", LEAF_ENTRIES
        while len(root) > HEAD_BYTES - HEADER.size:
            packed = [pack_directory(*(v[k : k + step] for v in columns)) for k in range(0, len(self.ids), step)]
            sizes = np.array([len(p) for p in packed], np.uint64)
            root, leaves, step = pack_directory(columns[0][::step], np.zeros(len(packed)), sizes, np.cumsum(sizes) - sizes), b"".join(packed), 2 * step
        text = gzip.compress(about.encode(), mtime=0)
        ends = np.concatenate([columns[0], columns[0] + columns[1] - np.uint64(1)])
        lo, hi = (int(z) for z in tiles_of(np.array([ends.min(), ends.max()]))[0])
        at = np.cumsum([HEADER.size, len(root), len(text), len(leaves)]).tolist()
        box = self._box(hi)
        yield HEADER.pack(
            MAGIC, VERSION, at[0], len(root), at[1], len(text), at[2], len(leaves), at[3], len(self.data),
            sum(self.runs), len(self.ids), len(self.known), 1, GZIP, PLAIN, KINDS[kind], lo, hi,
            *box, lo, (box[0] + box[2]) // 2, (box[1] + box[3]) // 2,
        )
        yield root
        yield text
        yield leaves
        yield bytes(self.data)

    def _box(self, z: int) -> tuple[int, int, int, int]:
        """West, south, east, north of the tiles of the deepest zoom, in units of 1e-7 degrees."""
        x0 = y0 = 1 << z
        x1 = y1 = 0
        for first, n in zip(self.ids, self.runs, strict=True):
            first, end = max(first, int(BASES[z])), first + n
            for lo in range(first, end, 1 << 20):
                _, x, y = tiles_of(np.arange(lo, min(end, lo + (1 << 20)), dtype=np.uint64))
                x0, y0, x1, y1 = min(x0, int(x.min())), min(y0, int(y.min())), max(x1, int(x.max()) + 1), max(y1, int(y.max()) + 1)
        lon = lambda x: round((x / (1 << z) * 360 - 180) * 1e7)
        lat = lambda y: round(float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / (1 << z)))))) * 1e7)
        return lon(x0), lat(y1), lon(x1), lat(y0)


class TileArchive(DataSource):
    """Options: path; to read, `what` (tiles, or parts for a row an archive); to write, extension, metadata (JSON) and part_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        what = self.options.get("what", "tiles")
        if what not in ("tiles", "parts"):
            raise ValueError(f"unknown value of `what`: {what}; known: parts, tiles")
        return PARTS if what == "parts" else TILES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("what", "tiles") == "parts")

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], tile_format(self.options.get("extension", "png")), self.options.get("metadata", "{}"), int(self.options.get("part_bytes", PART_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format `tilearchive` known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileArchive)


def read_archive(spark: SparkSession, path: str, what: str = "tiles") -> DataFrame:
    """z, x, y, data of the archives of a folder, file or pattern of files that have no tile in common; `what="parts"`: a row an archive.

    A filter on z reads only the directories that may hold that zoom, and only its tiles.
    """
    register(spark)
    return spark.read.format(NAME).option("what", what).load(path)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """z, x, y, data of several sets of archives as one; where sets share a tile, the first one's counts."""
    if not paths:
        raise ValueError("no tile archives given")
    out = read_archive(spark, paths[-1])
    for path in reversed(paths[:-1]):
        out = merged_archive(read_archive(spark, path), out)
    return out


def write_archives(tiles: DataFrame, path: str, extension: str, about: str = "{}", part_bytes: int = PART_BYTES, append: bool = False) -> None:
    """Write encoded tiles (z, x, y, data) as archives of at most part_bytes of tiles each, in the order of the Hilbert curve.

    Tiles that come twice, have no data or lie outside their zoom are errors, and nothing is changed then;
    with `append`, tiles that the set has already are the caller's fault (see merged_archive).
    """
    spark = tiles.sparkSession
    register(spark)
    tile_format(extension)
    z, x, y = F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long")
    rows = materialise(tiles.select(tile_id(z, x, y).alias("tile_id"), "data"), "archive")
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    dealt = rows.repartitionByRange(int(total // part_bytes) + 1, "tile_id").sortWithinPartitions("tile_id")
    options = {"extension": extension, "metadata": about, "part_bytes": part_bytes}
    dealt.write.format(NAME).options(**options).mode("append" if append else "overwrite").save(path)
