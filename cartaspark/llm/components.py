"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch

#: Edges that one task joins at once (16 bytes each).
CHUNK = 1 << 16


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges (u, v) as stars: every node but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (two columns) as stars (u, v), v the smaller one, of every CHUNK edges or so of a task; components stay the same."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            found = forest(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

        waiting, held = [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held >= CHUNK:
                yield stars()
                waiting, held = [], 0
        if held:
            yield stars()

    return edges.mapInArrow(join, "u long, v long")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: a, b (long).  Returns node, component for every node of an edge; component is the smallest node.

    Every task first joins the edges that it reads, CHUNK at a time, to stars.  If these are no more than
    one CHUNK, one more task joins them, and that is all: no exchange.  Larger graphs alternate large-star
    and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  Minima
    are pre-aggregated before the shuffle.  The joins that bring a minimum back to the rows of a node are
    left to adaptive execution, which splits the partition of a hub with very many neighbours; their rows
    are two numbers.  Each round is written to the shared folder.
    """
    current = scratch.save(_forests(edges.select("a", "b")), f"{name}-0", 20_000)
    if current.count() <= CHUNK:
        current = scratch.save(_forests(current.coalesce(1)), f"{name}-1", 20_000)
        scratch.drop(f"{name}-0")
    else:
        current = _stars(current, scratch, name)
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(current: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The stars (u, v) of whole components, of edges u > v in the table `name`-0."""
    last, round_ = None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        round_ += 1
        current = scratch.save(small, f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return current
        last = mark
