"""A Merkle manifest of a dataset: one tree for each source, and a tree over the sources' roots.

H is the lowercase hex SHA-256 of its inputs put together; digests enter as hex text.  A leaf is H
of the record's fields, each ``-`` if null, else its byte count in UTF-8, ``:`` and the value.
Leaves of a source ascend by id; while a level has several nodes, every ``ARITY`` consecutive ones
(the last run may be shorter, down to one) become their H.  A lone node, or a lone leaf itself, is
the source's subroot.  Subroots, ordered by source, likewise give the root.

Checkpoint and recompute: only every ``PERIOD``-th level is stored, together with the roots.  One
block of ARITY ** PERIOD aligned nodes of a stored level makes one node of the next stored level;
the levels between are made in memory and discarded.  To extract proofs, blocks are visited from the
top down: a task gets a block's stored nodes and the path above the block, makes the missing
nodes again, and emits for every stored node its siblings up to the root.  Paths of nodes above the
leaves are no more than one ARITY ** PERIOD-th of the leaves; paths of leaves are emitted, not stored.

Positions in a source are numbered by ranges of (source, id, leaf): rows of a range are counted for
each source and the counts before it are added, so a source that holds most rows, an id that many
rows carry, and rows that agree in everything are spread over as many tasks as any others.

A null source is a source of its own and comes first; sources are ordered by their UTF-8 bytes.  Rows
without an id come first in their source; rows of one id are ordered by their leaves, and repeated
rows are leaves of their own.  Empty texts have the byte count 0, which differs from null.  An empty
table has no root and gives an empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import Scratch

ARITY = 16
#: Of so many levels one is stored.
PERIOD = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, idx long, size long, digest binary"
PATH = "path array<struct<left: string, right: string>>"


def leaf_digest(*fields: Column) -> Column:
    """H of a record's fields, as lowercase hex."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def tree_name(source: Column) -> Column:
    """A name that orders null first, then sources by their bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _h(hexes: list[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def levels_of(nodes: list[str], size: int) -> list[list[str]]:
    """The levels that a block of stored nodes adds: PERIOD of them, or as many as lead to a root.  `size`: nodes of the whole tree at the block's level."""
    levels = [nodes]
    while len(levels) <= PERIOD and size > 1:
        below = levels[-1]
        levels.append([_h(below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return levels


def positions(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows: tree, key (sort key within the tree), digest, ...  Adds idx, the place in the tree, and size, the tree's number of rows.

    Rows that agree in tree, key and digest may be told apart by anything: their places are interchangeable.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    order = ["tree", F.col("key").asc_nulls_first(), "digest", "salt"]
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    ranged = scratch.save(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    # a row for each range and each tree in it
    spans = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree").orderBy("part")
    spans = spans.withColumn("shift", F.coalesce(F.sum("n").over(tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first"))
    spans = scratch.save(spans.withColumn("size", F.sum("n").over(Window.partitionBy("tree"))).select("tree", "part", "shift", "size"), f"{name}-spans")
    return ranged.join(spans.hint("merge"), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift", "key")


class Forest:
    """Trees over positioned leaves (tree, idx, size, digest and whatever else they carry); only every PERIOD-th level is stored."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.stored = [leaves]
        block = ARITY**PERIOD
        roots = leaves.where("size = 1").select("tree", "digest")
        current = leaves.select(*(c.split()[0] for c in NODES.split(", "))).where("size > 1")
        while True:
            level = len(self.stored)
            made = current.select("tree", "size", F.expr(f"idx div {block}").alias("block"), "idx", "digest").groupBy("tree", "block").applyInArrow(_climb, NODES)
            made = scratch.save(made, f"{name}-{level}")
            roots = roots.unionByName(made.where("size = 1").select("tree", "digest"))
            current = made.where("size > 1")
            if current.isEmpty():
                break
            self.stored.append(current)
        self.roots = scratch.save(roots, f"{name}-roots")

    def proofs(self, above: DataFrame) -> DataFrame:
        """All columns of the leaves, the path of each (siblings at its left and right, level by level from the leaf up) and `top`, its tree's root.

        `above`: tree, path, top; the path is what follows above the tree's root.
        """
        block = ARITY**PERIOD
        found = None
        for level in range(len(self.stored) - 1, -1, -1):
            nodes = self.stored[level].withColumn("block", F.expr(f"idx div {block}"))
            # trees whose root is made by their one block of this level
            tops = nodes.where(f"size <= {block} and idx = 0").select("tree", "block").join(above.hint("merge"), "tree").select("tree", "block", "path", "top")
            known = tops if found is None else tops.unionByName(found.select("tree", F.col("idx").alias("block"), "path", "top"))
            known = known.select(F.col("tree").alias("of"), F.col("block").alias("at"), "path", "top")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.stored[level].schema) + f", {PATH}, top binary"
            found = nodes.groupBy("tree", "block").cogroup(known.groupBy("of", "at")).applyInArrow(_descend, schema)
            if level:
                found = self.scratch.save(found.select("tree", "idx", "path", "top"), f"{self.name}-paths-{level}")
        return found


def _climb(block: pa.Table) -> pa.Table:
    """One aligned block of stored nodes becomes one node of the next stored level, or its tree's root."""
    block = block.sort_by("idx")
    size = block["size"][0].as_py()
    levels = levels_of([x.hex() for x in block["digest"].to_pylist()], size)
    for _ in levels[1:]:
        size = -(-size // ARITY)
    (top,) = levels[-1]
    return pa.table([block["tree"].slice(0, 1).combine_chunks().cast(pa.string()), pa.array([block["block"][0].as_py()], pa.int64()), pa.array([size], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary())], names=["tree", "idx", "size", "digest"])


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Make the block's missing nodes again and emit each stored node's siblings, followed by the path above the block."""
    nodes = nodes.sort_by("idx")
    digests = [x.hex() for x in nodes["digest"].to_pylist()]
    levels = levels_of(digests, nodes["size"][0].as_py() if digests else 0)
    rest = above["path"][0].as_py() if above.num_rows else []
    rest_left, rest_right = [s["left"] for s in rest], [s["right"] for s in rest]
    left, right, ends = [], [], [0]
    for i in range(len(digests)):
        for level in levels[:-1]:
            run = i // ARITY * ARITY
            left.append("".join(level[run:i]))
            right.append("".join(level[i + 1 : run + ARITY]))
            i //= ARITY
        left += rest_left
        right += rest_right
        ends.append(len(left))
    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"]))
    top = above["top"].combine_chunks().take(pa.array(np.zeros(len(digests), np.int64)))
    return nodes.drop_columns(["block"]).append_column("path", path).append_column("top", top)


class Manifest:
    """The manifest of a table of records with the columns FIELDS."""

    def __init__(self, docs: DataFrame, changed: Column | None = None):
        """`changed`: another digest (hex) to be carried beside each leaf, such as that of the record as it is now; null where there is none."""
        self.scratch = Scratch(docs.sparkSession, "merkle")
        rows = docs.select(tree_name(F.col("source")).alias("tree"), F.col("doc_id").alias("key"), F.unhex(leaf_digest(*map(F.col, FIELDS))).alias("digest"), F.col("doc_id"), (F.lit(None).cast("binary") if changed is None else F.unhex(changed)).alias("now"))
        leaves = self.scratch.save(positions(rows, self.scratch, "leaves"), "leaves")
        self.scratch.drop("leaves-sorted", "leaves-spans")
        self.sources = Forest(leaves, self.scratch, "sources")
        tops = positions(self.sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("source")), self.scratch, "tops")
        self.top = Forest(self.scratch.save(tops, "tops"), self.scratch, "top")

    def root(self) -> str | None:
        """The root of the dataset as hex; None for an empty one."""
        found = self.top.roots.first()
        return bytes(found[1]).hex() if found else None

    def proofs(self) -> DataFrame:
        """doc_id, leaf, now, subroot, root (hex) and path of every record; folding a leaf along its path gives the root."""
        none = F.array().cast(PATH.split(" ", 1)[1])
        tops = self.top.proofs(self.top.roots.select("tree", none.alias("path"), F.col("digest").alias("top")))
        trees = self.scratch.save(tops.select(F.col("source").alias("tree"), "path", F.col("digest").alias("top")), "trees")
        found = self.sources.proofs(trees)
        hexes = (F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("now", "now"), ("top", "subroot")))
        return found.select("doc_id", *hexes, F.lit(self.root()).alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf (hex) and its path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
