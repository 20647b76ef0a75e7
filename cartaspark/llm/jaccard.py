"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersections.

Two documents link when 100 * |A & B| >= threshold * |A | B| over their sets of distinct k-word
shingles (as 64-bit hashes).  No link between different sets is lost, and hot groups are never
expanded into all pairs:

1. *Signatures.*  One pass gives each document its set size and a 128-bit digest of its sorted hash
   array.  Documents with equal digests form one class; only the smallest id represents it.  The same
   pass counts shingles in a table of buckets (16 for each document, 2^16 to 2^24), which orders
   shingles from rare to frequent; counts never saturate.
2. *Groups.*  By the prefix-filter bound, two linked sets share one of the first
   n - ceil(threshold * n) + 1 shingles of any common order.  Rare shingles come first, so passages
   that many documents share are met in few prefixes.  Classes that share such a shingle form a
   group; shingles of buckets far above the average are dealt to many tasks.  The hash arrays and
   bitmaps (about eight bits for each shingle) of all grouped classes are written once.
3. *Stars.*  In each group every class is held against one class of its size band: first the
   smallest, then, for up to ROUNDS rounds, the first by a new random order (one pair a row).  Pairs
   whose bitmaps allow a link are verified by exact sorted-array intersection.  Each round's links are
   contracted: they join components of the rounds before, so the graph holds new links only, and pairs
   inside a component are not looked at again.  When a round finds few links, the tiles come next.
4. *Tiles.*  What is left, rows of *different* components in one group, is dealt into tiles of two
   adjacent size bands (sets further apart in size cannot link); a large tile is split into blocks.
   Within a tile bit counts bound the overlap of each pair from above; the pairs that remain are
   verified exactly.  Groups whose first member is the same are dealt as one, as near copies share
   many shingles.
5. Components of all links, with every class expanded to its documents, are the result.

Bit counts: a bit that A has and B lacks stands for an element of A that B lacks, so
|A & B| <= |A| - popcount(bits A & ~bits B), and likewise for B.

Null and empty texts have no shingles and link with nothing.  Ids are the nodes of the graph: rows
with equal ids are one node, and a link of one holds for all.  A row without an id is a node of its
own (one with all rows without an id that carry the same text) and is returned as well; it never
gives its component a name, so a component of such rows alone has a null component_id.  Rows without an id
take node numbers from LEAST_SURROGATE (3 * 2^61) on; a table with ids up there has its ids replaced by
their places in ascending order meanwhile, which changes no result.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .merkle import positions
from .shared import Scratch, free_name
from .text import mix, pieces, release, shingle_sets, utf8, words

#: Fewest and most buckets of the count table, as powers of two.  At the most it takes 32 MB; a crowded table orders less sharply, it loses nothing.
COUNT_BITS = (16, 24)
#: The same for the bits of the filter of ids whose sets are needed (16 MB at the most): a full one only means that more sets are written.
NEED_BITS = (20, 27)
#: Shingles whose bucket counts more than HOT_ROWS above HOT_TIMES the average are dealt to several tasks.
HOT_ROWS, HOT_TIMES = 4096, 8
#: Nodes from here on stand for rows without an id.
LEAST_SURROGATE = 3 << 61
#: Rounds of stars in random orders, at the most: one that finds less than a link for FEW open rows is the last.
ROUNDS, FEW = 2, 64
#: Rows of one side of a tile block, and the widest bitmap.  A bitmap that is too narrow bounds less, it loses nothing.
BLOCK_ROWS, MOST_BITS = 2048, 1 << 16
SIGNATURE = "doc_id long, n long, d1 long, d2 long, counts binary"


def bitmap(hashes: np.ndarray) -> bytes:
    """A bitmap with a power of two of bits, at least eight times the number of hashes (64 at least) up to MOST_BITS."""
    width = min(MOST_BITS, max(64, 1 << int(8 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, width: int, to: int) -> int:
    """Halve a bitmap until it has `to` bits."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def may_link(n1: int, bits1: int, n2: int, bits2: int, threshold: int) -> bool:
    """Whether bit counts allow 100 * overlap >= threshold * union; bitmaps of equal width."""
    over = min(n1 - (bits1 & ~bits2).bit_count(), n2 - (bits2 & ~bits1).bit_count())
    return 100 * over >= threshold * (n1 + n2 - over)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    hashes, _, _, first = words(*utf8(column))
    return shingle_sets(hashes, first, k)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _bits(n: int, least: int, most: int) -> int:
    """The power of two that holds n, within bounds."""
    return min(most, max(least, int(max(1, n) - 1).bit_length()))


def _node() -> Column:
    """The id of a row; a surrogate that follows from its text if it has none."""
    surrogate = F.lit(LEAST_SURROGATE) + F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), surrogate)


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.select(_node().alias("doc_id"), F.col("text").cast("string").alias("text"))


def _signatures(nodes: DataFrame, k: int, bits: int) -> DataFrame:
    """A row per document; each task adds one row without id that holds its shingle counts (compressed)."""
    shift = np.uint64(64 - bits)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            np.add.at(counts, (np.concatenate(waiting) >> shift).astype(np.intp), np.uint32(1))

        for batch in batches:
            for part in pieces(batch, batch.schema.names[1]):
                rows = []
                for key, own in zip(part.column(0).to_pylist(), _sets(part.column(1), k), strict=True):
                    rows.append((key, len(own), *_digest(own), None))
                    waiting.append(own)
                    held += len(own)
                yield _batch(rows, SIGNATURE)
                if held > 1 << 20:
                    add()
                    waiting, held = [], 0
        if waiting:
            add()
        small = counts.max() < 256
        yield _batch([(None, 0, 0, 0, zlib.compress((counts.astype(np.uint8) if small else counts).tobytes(), 1))], SIGNATURE)

    return nodes.mapInArrow(sign, SIGNATURE)


def _frequencies(signed: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Counts of all buckets on a scale of 1024 steps a doubling, summed in a tree of tasks, and their average."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            for blob in batch.column(0):
                raw = zlib.decompress(blob.as_py())
                total += np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(raw) >> bits])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["total"])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            total = np.frombuffer(zlib.decompress(batch.column(0)[0].as_py()), np.uint64)
            steps = np.round(np.log2(total + 1.0) * 1024).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary()), pa.array([float(total.mean())])], names=["steps", "mean"])

    tables = signed.where("counts is not null").select("counts")
    adders = max(1, math.isqrt(tables.count()))  # one table of each task of the first pass
    found = tables.repartition(adders).mapInArrow(add, "total binary").coalesce(1).mapInArrow(scale, "steps binary, mean double").first()
    return np.frombuffer(zlib.decompress(found["steps"]), np.uint16), found["mean"]


PREFIX = "token long, part int, n long, d1 long, doc_id long, early boolean"


def _prefixes(nodes: DataFrame, k: int, threshold: int, frequencies, bits: int, mean: float) -> DataFrame:
    """The prefix of every document.  `part` is -1, or one of several for shingles that very many documents may hold.

    `early` marks the first n - ceil(2 * threshold * n / (100 + threshold)) + 1 shingles: the smaller of
    two linked sets has a shared shingle of its prefix there, so groups without an early row hold no link.
    """
    shift, hot = np.uint64(64 - bits), HOT_ROWS + HOT_TIMES * mean

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequencies.value
        for batch in batches:
            for part in pieces(batch, batch.schema.names[1]):
                tokens, ranks, early, sizes, digests, ids, lengths = [], [], [], [], [], [], []
                for key, own in zip(part.column(0).to_pylist(), _sets(part.column(1), k), strict=True):
                    n = len(own)
                    if not n:
                        continue
                    take = n - (-(-threshold * n // 100)) + 1
                    rank = often[(own >> shift).astype(np.int64)]
                    first = np.argsort(rank, kind="stable")[:take]
                    tokens.append(own[first])
                    ranks.append(rank[first])
                    early.append(np.arange(take) <= n - (-(-2 * threshold * n // (100 + threshold))))
                    sizes.append(n)
                    digests.append(_digest(own)[0])
                    ids.append(key)
                    lengths.append(take)
                if tokens:
                    n, d1, doc = (np.repeat(np.array(x, np.int64), lengths) for x in (sizes, digests, ids))
                    parts = np.ceil(np.exp2(np.concatenate(ranks) / 1024.0) / hot)
                    salt = np.where(parts > 1, mix(d1.view(np.uint64)).astype(np.float64) / 2.0**64 * parts, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens).view(np.int64), salt, n, d1, doc, np.concatenate(early))], names=["token", "part", "n", "d1", "doc_id", "early"])

    return nodes.mapInArrow(cut, PREFIX)


GROUPED = "token long, n long, doc_id long, center long, early boolean"


def _groups(prefixes: DataFrame, threshold: int) -> DataFrame:
    """Tokens that at least two classes share, or may share: a row per class with the center it is held against.

    Rows come sorted, so a group of any size streams through; only its last row is held back.  In each
    part of a token that is dealt to several tasks, every class is kept.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (token, part, n, d1, doc_id, early, open): the newest class; open: nothing of its group is out yet
        center = (0, 0)
        for batch in batches:
            token, part, n, d1, doc, early = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (n[1:] != n[:-1]) | (d1[1:] != d1[:-1])
            if last is not None:
                fresh[0] = (token[0], part[0], n[0], d1[0]) != last[:4]
            token, part, n, d1, doc, early = (x[fresh] for x in (token, part, n, d1, doc, early))
            if not len(token):
                continue
            same = np.empty(len(token), bool)  # as the class before
            same[1:] = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
            same[0] = last is not None and (token[0], part[0]) == last[:2]
            rows = []
            more = same | (part >= 0)
            more[:-1] |= same[1:]
            at = np.flatnonzero(more)
            for t, p, size, key, soon, joined in zip(*(x[at].tolist() for x in (token, part, n, doc, early, same)), strict=True):
                if not joined:
                    center = (size, key)
                elif last is not None and last[6] and last[:2] == (t, p):  # the group began in an earlier batch
                    center = (last[2], last[4])
                    rows.append((t, last[2], last[4], last[4], last[5]))
                    last = (*last[:6], False)
                if 100 * center[0] < threshold * size:
                    center = (size, key)
                rows.append((t, size, key, center[1], soon))
            last = (int(token[-1]), int(part[-1]), int(n[-1]), int(d1[-1]), int(doc[-1]), bool(early[-1]), not bool(more[-1]))
            yield _batch(rows, GROUPED)

    return prefixes.repartition("token", "part").sortWithinPartitions("token", "part", "n", "d1", "doc_id").mapInArrow(stream, GROUPED)


SETS = "doc_id long, n long, bits binary, hashes binary"


def _needed(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter (two hashes, about eight bits an id within NEED_BITS) of n ids (doc_id), packed, joined in a tree of tasks."""
    size = 1 << (_bits(8 * n, *NEED_BITS) - 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            for blob in batch.column(0):
                bits |= np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    tables = ids.select("doc_id").mapInArrow(mark, "bits binary").repartition(6).mapInArrow(join, "bits binary")
    blob = tables.coalesce(1).mapInArrow(join, "bits binary").collect()
    return np.frombuffer(zlib.decompress(blob[0][0]), np.uint8) if blob else np.zeros(size, np.uint8)


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    one, two = (((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) for at in _places(ids, len(bits)))
    return one & two


def _places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h, last = mix(ids.astype(np.int64).view(np.uint64)), np.uint64(8 * size - 1)
    return ((h >> np.uint64(32)) & last).astype(np.int64), (h & last).astype(np.int64)


def _sets_of(nodes: DataFrame, k: int, needed) -> DataFrame:
    """Size, bitmap and sorted hash array of the documents whose ids pass the filter."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()  # surrogates: rows without an id and with one text are one node
        for batch in batches:
            keys = batch.column(0).to_numpy()
            pick = _passes(needed.value, keys)
            for i in np.flatnonzero(pick & (keys >= LEAST_SURROGATE)).tolist():
                pick[i] = keys[i] not in written
                if len(written) < 1 << 20:  # only saves repeats, which are dropped later
                    written.add(int(keys[i]))
            own = batch.filter(pa.array(pick))
            for part in pieces(own, own.schema.names[1]):
                sets = _sets(part.column(1), k)
                yield _batch([(key, len(x), bitmap(x), x.tobytes()) for key, x in zip(part.column(0).to_pylist(), sets, strict=True)], SETS)

    return nodes.mapInArrow(arrays, SETS)


def _once(sets: DataFrame) -> DataFrame:
    """Rows of one surrogate once; ids, which are almost all rows, do not move."""
    alone = sets.where(F.col("doc_id") >= LEAST_SURROGATE).groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("n", "bits", "hashes")])
    return sets.where(F.col("doc_id") < LEAST_SURROGATE).unionByName(alone)


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hash arrays of the ids in pairs (and of few others that the filter lets pass), so that only these are shuffled."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    needed = sets.sparkSession.sparkContext.broadcast(_needed(ids, 2 * pairs.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(needed.value, batch.column(0).to_numpy())))

    return sets.select("doc_id", "hashes").mapInArrow(pick, "doc_id long, hashes binary")


PAIRS = "a long, b long, p long, q long"


def _pairs(rows: DataFrame, other: str, p: str, q: str) -> DataFrame:
    """PAIRS of doc_id and another id, whose components are p and q: a < b, each pair once."""
    low = F.col("doc_id") < F.col(other)
    ends = F.least("doc_id", other).alias("a"), F.greatest("doc_id", other).alias("b")
    return rows.select(*ends, F.when(low, F.col(p)).otherwise(F.col(q)).alias("p"), F.when(low, F.col(q)).otherwise(F.col(p)).alias("q")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The components (p, q) of the pairs that link, by exact intersection of their sorted hash arrays (sets: doc_id, hashes)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = overlap(one, two)
                ok.append(100 * common >= threshold * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["p", "q"]).filter(pa.array(ok, pa.bool_()))

    one, two = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("p", "q", "x", "y").mapInArrow(check, "p long, q long")


def _allowed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The PAIRS whose sizes and bit counts allow a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n1, n2, x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7), strict=True):
                x, y = x.as_py(), y.as_py()
                width = 8 * min(len(x), len(y))
                one, two = (fold(int.from_bytes(v, "little"), 8 * len(v), width) for v in (x, y))
                ok.append(may_link(n1, one, n2, two, threshold))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "p", "q"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y"))
    near = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where((100 * F.col("n1") >= threshold * F.col("n2")) & (100 * F.col("n2") >= threshold * F.col("n1")))
    return near.select("a", "b", "p", "q", "n1", "n2", "x", "y").mapInArrow(bound, PAIRS)


def _band(threshold: int, shift: float = 0.0):
    """The size band: a factor a little over 100 / threshold wide, so linked sizes are never two bands apart."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold + 1e-6)) + shift).cast("int")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with `component` as what it was merged into (merged: node, component)."""
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return rows.join(new, "component", "left").withColumn("component", F.coalesce("_new", "component")).drop("_new")


def _unsettled(grouped: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of groups that hold several components and an early row: token, n, doc_id, early, component."""
    rows = _relabelled(grouped.select("token", "n", "doc_id", "early", "component"), merged)
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("early").alias("any")).where("lo < hi and any").select("token")
    return rows.join(mixed.hint("merge"), "token", "left_semi").select("token", "n", "doc_id", "early", "component")


def _stars(open_: DataFrame, threshold: int, round_: int) -> DataFrame:
    """PAIRS of each class with the first class, by a random order of this round, of its group's size band; none inside a component."""
    rows = open_.withColumn("band", _band(threshold, (round_ % 2) / 2))
    first = F.min(F.struct(F.xxhash64(F.lit(round_), "doc_id").alias("h"), F.col("doc_id").alias("center"), F.col("component").alias("own"))).alias("c")
    bands = rows.groupBy("token", "band").agg(first, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "band", "c.center", "c.own")
    return _pairs(rows.join(bands.hint("merge"), ["token", "band"]).where("component <> own"), "center", "component", "own")


TILE = "first long, tile int, block1 int, block2 int, n long, doc_id long, component long, low boolean, block int, bits binary"


def _tiles(open_: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Rows of groups with several components, dealt into tiles of adjacent size bands and their blocks."""
    first = open_.groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("first"))).alias("f"))
    rows = open_.join(first.select("token", "f.first").hint("merge"), "token").select("first", "n", "doc_id", "component").distinct()
    rows = rows.withColumn("band", _band(threshold)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(-1))))
    rows = rows.select("first", (F.col("band") + F.col("side")).alias("tile"), "n", "doc_id", "component", (F.col("side") == 0).alias("low"))
    size = rows.groupBy("first", "tile").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("low").alias("any_low"))
    size = size.where("lo < hi and any_low").select("first", "tile", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(size, ["first", "tile"])
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("first", "tile", F.least("block", "other").alias("block1"), F.greatest("block", "other").alias("block2"), "n", "doc_id", "component", "low", "block")
    return rows.join(sets.select("doc_id", "bits"), "doc_id").select(*[x.split()[0] for x in TILE.split(", ")])


def compare(rows: list[tuple], across: bool, threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """PAIRS in one tile block, of different components, that sizes and bit counts allow.

    rows: (n, doc_id, component, low, block, bits).  Rows of the lower band meet each other and those of
    the upper band; across two blocks only rows of different blocks meet.
    """
    rows = sorted(rows, key=lambda r: r[:2])
    width = 8 * min(len(r[5]) for r in rows)
    words = np.stack([np.frombuffer(fold(int.from_bytes(r[5], "little"), 8 * len(r[5]), width).to_bytes(width // 8, "little"), np.uint64) for r in rows])
    n, doc, component, low, block = (np.array(x) for x in zip(*(r[:5] for r in rows), strict=True))
    stop = np.searchsorted(n, n * 100 // threshold, "right")
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, stop[i])
        j = j[(component[j] != component[i]) & (low[j] | low[i])]
        if across:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        mine, missing = (np.bitwise_count(v).sum(1, dtype=np.int64) for v in (words[i] & ~words[j], words[j] & ~words[i]))
        over = np.minimum(n[i] - mine, n[j] - missing)
        for k in j[100 * over >= threshold * (n[i] + n[j] - over)].tolist():
            a, b, p, q = (int(x) for x in (doc[i], doc[k], component[i], component[k]))
            yield (a, b, p, q) if a < b else (b, a, q, p)


def _tile_pairs(tiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs of all tile blocks; a block has at most two sides of about BLOCK_ROWS rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, seen, out = None, [], set(), []

        def close() -> Iterator[pa.RecordBatch]:
            for pair in compare(group, key[2] != key[3], threshold) if len(group) > 1 else ():
                if pair not in seen:
                    seen.add(pair)
                    out.append(pair)
                if len(out) >= 100_000:
                    yield _batch(out, PAIRS)
                    out.clear()
                if len(seen) > 1_000_000:  # only saves repeats
                    seen.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(10)]
            for first, tile, one, two, *row in zip(*columns, strict=True):
                if (first, tile, one, two) != key:
                    yield from close()
                    key, group = (first, tile, one, two), []
                group.append(tuple(row))
            yield _batch(out, PAIRS)
            out.clear()
        yield from close()
        yield _batch(out, PAIRS)
        release()

    dealt = tiles.repartition("first", "tile", "block1", "block2").sortWithinPartitions("first", "tile", "block1", "block2")
    return dealt.mapInArrow(stream, PAIRS).distinct()


def _components(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """node, n_shingles, component and class (nodes) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    nodes = _nodes(docs)
    bits = _bits(16 * docs.count(), *COUNT_BITS)
    signed = scratch.save(_signatures(nodes, k, bits), "signed")
    steps, mean = _frequencies(signed, bits)
    signatures = signed.where("doc_id is not null").select("doc_id", "n", "d1", "d2")
    grouped = scratch.save(_groups(_prefixes(nodes, k, threshold, spark.sparkContext.broadcast(steps), bits, mean), threshold), "grouped", 5000)
    sets = _once(scratch.save(_sets_of(nodes, k, spark.sparkContext.broadcast(_needed(grouped, grouped.count()))), "sets"))
    classes = signatures.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    rows = signatures.join(classes.hint("merge"), ["n", "d1", "d2"], "left")
    rows = scratch.save(rows.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "rows")
    # ids that repeat with different texts tie their classes together
    ties = rows.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b")
    ties = ties.select("a", F.col("doc_id").alias("b")).unionByName(rows.join(ties.hint("merge"), "doc_id").select("a", F.col("class_id").alias("b"))).where("a <> b").distinct()

    grouped = grouped.withColumn("component", F.col("doc_id"))
    pairs = _pairs(grouped.where("center <> doc_id"), "center", "doc_id", "center")
    labelled = rows.withColumn("component", F.col("class_id"))
    merged, links, tiled = None, 0, False
    for round_ in range(ROUNDS + 2):  # the first centers, random ones, then all that is left
        if round_:
            grouped = scratch.save(_unsettled(grouped, merged), f"open-{round_}")
            scratch.drop("grouped" if round_ == 1 else f"open-{round_ - 1}")
            rows_left = grouped.count()
            if not rows_left:
                break
            tiled = round_ > ROUNDS or links * FEW < rows_left
            pairs = _tile_pairs(_tiles(grouped, sets, threshold), threshold) if tiled else _stars(grouped, threshold, round_)
        pairs = scratch.save(pairs if tiled else _allowed(pairs, sets, threshold), f"pairs-{round_}")
        own = scratch.save(_only(sets, pairs), f"sets-{round_}", 500)
        found = scratch.save(_verified(pairs, own, threshold), f"links-{round_}", 500)  # two sets a row
        scratch.drop(f"pairs-{round_}", f"sets-{round_}")
        links = found.count()
        # the nodes of this round's graph are the components of the rounds before
        edges = found.toDF("a", "b")
        merged = connected_components(edges if round_ else edges.unionByName(ties), scratch, f"components-{round_}")
        labelled = _relabelled(labelled, merged)
        if tiled:
            break
    scratch.drop(f"open-{round_}", "sets", "signed")

    final = labelled.select(F.col("doc_id").alias("node"), F.col("n").alias("n_shingles"), "component", F.col("class_id").alias("class"))
    final = scratch.save(final, "final")
    scratch.drop("rows", *[f"links-{i}" for i in range(ROUNDS + 2)])
    return final


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text with ids below LEAST_SURROGATE, and the table of place and id where ids had to be replaced by places."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    largest = own.agg(F.max("doc_id")).first()[0]
    if largest is None or largest < LEAST_SURROGATE:
        return own, None
    scratch = Scratch(docs.sparkSession, "ids")
    ids = own.where("doc_id is not null").select(F.lit("").alias("tree"), F.col("doc_id").alias("key"), F.lit(b"").alias("digest"), "doc_id").distinct()
    places = scratch.save(positions(ids, scratch, "ids").select("doc_id", F.col("idx").alias("place")), "places")
    return own.join(places.hint("merge"), "doc_id", "left").select(F.col("place").alias("doc_id"), "text"), places


def _with_ids(rows: DataFrame, places: DataFrame | None, names: tuple[str, ...]) -> DataFrame:
    """Places in the named columns turned back into ids."""
    for name in names if places is not None else ():
        ids = places.select(F.col("place").alias(name), F.col("doc_id").alias("_id"))
        rows = rows.join(ids.hint("merge"), name, "left").withColumn(name, F.col("_id")).drop("_id")
    return rows


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Components of the n-gram Jaccard self-join: doc_id, n_shingles, component_id, class_id (smallest id with an equal set)."""
    docs, places = _numbered(docs)
    named = lambda c: F.when(F.col(c) < LEAST_SURROGATE, F.col(c))
    found = _components(docs, k, threshold).select(named("node").alias("doc_id"), "n_shingles", named("component").alias("component_id"), named("class").alias("class_id"))
    return _with_ids(found, places, ("doc_id", "component_id", "class_id")).select("doc_id", "n_shingles", "component_id", "class_id")


def keep_one_each(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents that carry the smallest id of their component; all columns stay.

    Rows without an id stay only in components without any id; of those the ones with one of the texts stay.
    """
    own, places = _numbered(docs)
    gone = _components(own, k, threshold).where("node <> component").select("node").distinct()
    if places is not None:  # back to the ids; rows without an id have the same numbers either way
        gone = gone.join(places.select(F.col("place").alias("node"), "doc_id").hint("merge"), "node", "left")
    name, known = free_name(docs, "_node"), free_name(docs, "_has_id")
    has_id = F.col("node") < LEAST_SURROGATE
    gone = gone.select((F.col("node") if places is None else F.when(has_id, F.col("doc_id")).otherwise(F.col("node"))).alias(name), has_id.alias(known)).hint("merge")
    return docs.withColumn(name, _node()).withColumn(known, F.col("doc_id").isNotNull()).join(gone, [name, known], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
