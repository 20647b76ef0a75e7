"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

The state of a :class:`LineIndex` is a table of exact reference counts (line key -> number of
documents that hold it), sharded by the key's hash, and for every shard a cuckoo filter of the
*hot* keys, those that at least ``min_docs`` documents hold.  Inserting documents adds to the
counts, deleting them subtracts; a key that crosses the bound enters or leaves its shard's filter.
Because counts are exact, inserting and then deleting documents restores the earlier state.  There
are as many shards as ``shard_keys`` asks for; when the table has outgrown them, it is dealt anew.

A lookup asks filters first; only lines that pass (hot ones and a few false positives) are held
against the exact counts, which decide.  Two ways lead to a filter, both at every size:

* the keys that hold a share of ``heavy_share`` of all references or more, at most 1 / heavy_share
  keys by the pigeonhole principle, form a filter and an exact set of their own, which are broadcast:
  a line that a third of all documents hold never gathers in one task;
* all other lines are sent, as digests, to the shard of their key, where they stream past the
  shard's filter.

A line is cut at ``\\n`` alone.  Its key has ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased.  A null or empty text is one empty line; keys of fewer than ``min_chars`` code points
are never dropped.  Every row is a document of its own, with or without an id and whether or not
others carry the same id: lines are addressed by a hash of id and text, and rows that agree in both
lose the same lines.  Extra columns are carried along untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import Scratch, free_name
from .text import mix

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SLOTS = 4
KICKS = 500


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).translate(_UPPER)


def key_digest(key: bytes) -> bytes:
    """128 bits that stand for a key."""
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """A cuckoo filter over 128-bit keys: 16-bit fingerprints, buckets of four, with deletion."""

    def __init__(self, capacity: int, table: bytes | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.7)))))
        self.table = np.zeros(self.buckets * SLOTS, np.uint16) if table is None else np.frombuffer(table, np.uint16).copy()
        self.buckets = len(self.table) // SLOTS

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64.  Fingerprints (never 0) and both buckets."""
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys[:, 1] >> np.uint64(16)) & np.uint64(self.buckets - 1)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ mix(prints.astype(np.uint64))) & np.uint64(self.buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        rows = self.table.reshape(-1, SLOTS)
        return (rows[one.astype(np.int64)] == prints[:, None]).any(1) | (rows[two.astype(np.int64)] == prints[:, None]).any(1)

    def _fill(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; returns which found room."""
        rows = self.table.reshape(-1, SLOTS)
        order = np.argsort(buckets, kind="stable")
        own = buckets[order].astype(np.int64)
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        taken = rows[own] != 0
        fits = rank < SLOTS - taken.sum(1)
        free = np.argsort(taken[fits], axis=1, kind="stable")
        rows[own[fits], free[np.arange(len(free)), rank[fits]]] = prints[order[fits]]
        done = np.zeros(len(own), bool)
        done[order[fits]] = True
        return done

    def _kick(self, mark: int, bucket: int) -> bool:
        """Move fingerprints on until a slot is free."""
        for kick in range(KICKS):
            at = bucket * SLOTS + kick % SLOTS
            mark, self.table[at] = int(self.table[at]), mark
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket * SLOTS : bucket * SLOTS + SLOTS] == 0)
            if len(free):
                self.table[bucket * SLOTS + free[0]] = mark
                return True
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; False if the filter is too full: the caller then builds a larger one from the exact table."""
        prints, one, two = self._places(keys)
        left = np.arange(len(keys))
        for buckets in (one, two):
            left = left[~self._fill(buckets[left], prints[left])]
        return all(self._kick(int(prints[i]), int(one[i])) for i in left)

    def delete(self, keys: np.ndarray) -> bool:
        """Take keys out again; False if one is not there."""
        prints, one, two = self._places(keys)
        rows, left = self.table.reshape(-1, SLOTS), np.arange(len(keys))
        while len(left):
            first, second = (rows[b[left].astype(np.int64)] == prints[left][:, None] for b in (one, two))
            if not (first.any(1) | second.any(1)).all():
                return False
            at = np.where(first.any(1), one[left].astype(np.int64) * SLOTS + first.argmax(1), two[left].astype(np.int64) * SLOTS + second.argmax(1))
            slots, which = np.unique(at, return_index=True)  # equal fingerprints of one bucket go one by one
            self.table[slots] = 0
            left = np.delete(left, which)
        return True

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = max(4, len(keys))
        while True:
            made = cls(room)
            if made.insert(keys):
                return made
            room *= 2


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def row_address(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text."""
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(F.lit(1), key.isNull(), key, text), F.xxhash64(F.lit(2), text, key.isNull(), key)


class LineIndex:
    """Reference counts and filters of the lines of a set of documents; see the module's text."""

    COUNTS = "key binary, docs long"
    FILTERS = "shard int, filter binary"

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, shard_keys: int = 1 << 20, heavy_share: float = 1e-4):
        self.spark, self.min_docs, self.min_chars, self.shard_keys, self.heavy_share = spark, min_docs, min_chars, shard_keys, heavy_share
        self.scratch = Scratch(spark, "lines")
        self.version, self.shards = 0, 0
        self.counts = spark.createDataFrame([], self.COUNTS)
        self.filters = spark.createDataFrame([], self.FILTERS)

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Take documents out again; they must have been inserted with the same text."""
        self._change(docs, -1)

    def _keys(self, docs: DataFrame) -> DataFrame:
        """One row for each document and distinct key of it."""
        long_enough = self._long_enough()

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[bytes] = []
                for text in batch.column(0):
                    keys = {line_key(x) for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")}
                    out += [key_digest(k) for k in keys if long_enough(k)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])

        return docs.select(F.col("text").cast("string")).mapInArrow(explode, "key binary")

    def _long_enough(self):
        least = self.min_chars
        return lambda k: len(k.decode("utf-8", "surrogatepass") if len(k) < 4 * least else k) >= least

    def _change(self, docs: DataFrame, sign: int) -> None:
        delta = self._keys(docs).groupBy("key").agg((F.count("*") * sign).cast("long").alias("delta"))
        if self.version:
            both = self.counts.select("key", F.col("docs").alias("old")).join(delta, "key", "full_outer")
        else:
            both = delta.withColumn("old", F.lit(0).cast("long"))
        both = both.select("key", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("docs"))
        self.version += 1
        changed = self.scratch.save(both, f"changed-{self.version}")
        needed = max(16, -(-changed.count() // self.shard_keys))
        if needed > 2 * self.shards:  # too few shards, or none yet: all filters are built anew
            self.shards, self.filters = needed, self.spark.createDataFrame([], self.FILTERS)
            crossing = changed.where(F.col("docs") >= self.min_docs).select("key", F.lit(True).alias("hot"), F.lit(False).alias("was"))
        else:
            hot, was = F.col("docs") >= self.min_docs, F.col("old") >= self.min_docs
            crossing = changed.where(hot | was).select("key", hot.alias("hot"), was.alias("was"))
        self.counts = changed.where("docs > 0").select("key", "docs")
        self.filters = self.scratch.save(self._new_filters(crossing), f"filters-{self.version}")
        self.scratch.drop(f"changed-{self.version - 1}", f"filters-{self.version - 1}")

    def _new_filters(self, crossing: DataFrame) -> DataFrame:
        """Bring each shard's filter up to date with its hot keys and those that ceased to be hot."""

        def rebuild(key: tuple, rows: pa.Table, old: pa.Table) -> pa.Table:
            shard = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
            hot, was = (rows[c].to_numpy().astype(bool) for c in ("hot", "was"))
            keys = _as_words(rows["key"].to_pylist()) if rows.num_rows else np.zeros((0, 2), np.uint64)
            made = None
            if old.num_rows:
                made = CuckooFilter(1, old["filter"][0].as_py())
                if not (made.delete(keys[was & ~hot]) and made.insert(keys[hot & ~was])):
                    made = None
            if made is None:
                made = CuckooFilter.of(keys[hot])
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.table.tobytes()], pa.binary())})

        return crossing.withColumn("shard", _shard(self.shards)).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(rebuild, self.FILTERS)

    def _heavy(self) -> list[bytes]:
        """Hot keys that hold at least `heavy_share` of all references: at most 1 / heavy_share of them."""
        total = self.counts.agg(F.sum("docs")).first()[0] or 0
        return [bytes(r[0]) for r in self.counts.where(F.col("docs") >= max(self.min_docs, total * self.heavy_share)).select("key").collect()]

    def hot_lines(self, docs: DataFrame) -> DataFrame:
        """For each address (a1, a2) of a row the sorted 0-based numbers of its lines that must go; rows without any are left out."""
        heavy = self.spark.sparkContext.broadcast(self._heavy())
        long_enough = self._long_enough()

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact = frozenset(heavy.value)
            heavies = CuckooFilter.of(_as_words(heavy.value)) if exact else None
            for batch in batches:
                rows, places, digests = [], [], []
                for i, text in enumerate(batch.column(2)):
                    for j, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                        k = line_key(line)
                        if long_enough(k):
                            rows.append(i)
                            places.append(j)
                            digests.append(key_digest(k))
                sure = np.zeros(len(rows), bool)
                if heavies is not None and rows:
                    for i in np.flatnonzero(heavies.contains(_as_words(digests))).tolist():
                        sure[i] = digests[i] in exact
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(sure)], names=["a1", "a2", "line", "key", "sure"])

        one, two = row_address(docs)
        lines = docs.select(one.alias("a1"), two.alias("a2"), F.col("text").cast("string").alias("text")).mapInArrow(explode, "a1 long, a2 long, line int, key binary, sure boolean")
        lines = self.scratch.save(lines, f"lines-{uuid.uuid4().hex}")

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own = None, None
            for batch in batches:
                at = batch.column(0).to_numpy()
                may = np.zeros(len(at), bool)
                edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if at[lo] != shard:
                        shard, own = at[lo], None
                    if batch.column(1)[lo].as_py():  # the shard's filter comes first
                        own, lo = CuckooFilter(1, batch.column(1)[lo].as_py()), lo + 1
                    if own is not None and lo < hi:
                        may[lo:hi] = own.contains(_as_words(batch.column(5).slice(lo, hi - lo).to_pylist()))
                yield batch.filter(pa.array(may)).select(["a1", "a2", "line", "key"])

        none = F.lit(None)
        filters = self.filters.select("shard", "filter", none.cast("long").alias("a1"), none.cast("long").alias("a2"), none.cast("int").alias("line"), none.cast("binary").alias("key"))
        asked = lines.where("not sure").select(_shard(self.shards).alias("shard"), none.cast("binary").alias("filter"), "a1", "a2", "line", "key")
        met = filters.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        passed = met.mapInArrow(stream, "a1 long, a2 long, line int, key binary")
        hot = self.counts.where(F.col("docs") >= self.min_docs).select("key")
        found = passed.join(hot.hint("merge"), "key", "left_semi").select("a1", "a2", "line").unionByName(lines.where("sure").select("a1", "a2", "line"))
        return found.groupBy("a1", "a2").agg(F.array_sort(F.collect_set("line")).alias("lines"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """All documents and columns, text replaced by the kept lines; n_lines and n_dropped are appended (and replace columns of these names).

        The text of a document whose lines all go is empty.  A null text stays null if its (empty) line stays.
        """
        one, two, gone = free_name(docs, "_a1"), free_name(docs, "_a2"), free_name(docs, "_gone")
        drops = self.hot_lines(docs).select(F.col("a1").alias(one), F.col("a2").alias(two), F.col("lines").alias(gone))
        drops = self.scratch.save(drops, f"drops-{uuid.uuid4().hex}")
        lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
        # by sort-merge at every size: what is dropped grows with the corpus and has no bound for a broadcast
        addressed = docs.select("*", *(a.alias(n) for a, n in zip(row_address(docs), (one, two), strict=True)))
        joined = addressed.join(drops.hint("merge"), [one, two], "left")
        # the lines between two dropped ones are cut out whole: time in proportion to lines and drops
        cuts = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))

        def between(both):
            ends = both["cuts"]
            return F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda i: F.slice(both["lines"], F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1))

        kept = F.get(F.transform(F.array(F.struct(lines.alias("lines"), cuts.alias("cuts"))), lambda both: F.array_join(F.flatten(between(both)), "\n")), F.lit(0))
        text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
        own = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
        return joined.select(*own, text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Insert all documents into a new index and drop their hot lines."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    index.insert(docs)
    return index.apply(docs)
