"""Exact deduplication with a log-structured merge index of text digests.

Rows fill memtables of a bounded number of rows (Spark's hash aggregation: one entry per digest),
each of which is flushed as an immutable *run*: digests in sorted order with their surviving id and
count, and a Bloom filter of the run.  Whenever ``fanout`` runs lie on one level, compaction merges them
into one run of the next level and keeps the smallest (or largest) id of each digest.  Several runs stay
at rest, and a lookup asks a run's filter before the run: an entry that stands once in its own run and
passes no other run's filter is settled where it lies.  Only the others meet by their digests.

Equal digests are only *hits*.  Every hit is verified byte by byte against the text of the
surviving row; rows that differ (a digest collision) are grouped anew among themselves until all
rows are settled, so results are right for any digest function.  A filter of the repeated digests is
asked in the scan, so neither texts nor digests of other rows move again.  All filters have about eight
bits a digest, 16 MB at the most: a crowded one only lets more rows pass.  Rows of a digest with very
many copies are dealt to several tasks, each of which gets the surviving text.

A null text counts as empty.  Rows with equal ids are separate rows: all rows that carry the
surviving id are kept.  A row without an id never survives a row that has one; if no row of a group
has an id, keep_id is null and its rows are kept.  Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .jaccard import _needed, _passes
from .shared import Scratch


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


#: Digests of one file of a run.
FILE_ROWS = 2_000_000
#: A whole table fills at least so many memtables, and so many as MEMTABLE_ROWS asks for.
MEMTABLES, MEMTABLE_ROWS = 6, 50_000_000
#: Rows of one digest for a task: SALT_ROWS, or 1/HOT of all rows where that is more; at most HOT digests have more.
SALT_ROWS, HOT = 10_000, 10_000


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    filter: Broadcast


class DigestIndex:
    """Sorted digest runs: (digest, keep_id, n)."""

    SCHEMA = "digest binary, keep_id long, n long"

    def __init__(self, spark: SparkSession, scratch: Scratch, keep: str = "smallest", fanout: int = 4):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep}")
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self._best: Callable = F.min if keep == "smallest" else F.max
        self.levels: list[list[Run]] = []
        self._made = 0

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _flush(self, entries: DataFrame, level: int, rows: int) -> None:
        """Write one sorted run of at most `rows` digests, and its filter."""
        name = f"run-{level}-{self._made}"
        self._made += 1
        files = max(math.ceil(rows / FILE_ROWS), min(self.spark.sparkContext.defaultParallelism, math.ceil(rows / 20_000)), 1)
        entries.repartition(files, "digest").sortWithinPartitions("digest").write.option("compression", "zstd").parquet(f"{self.scratch.root}/{name}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(name, rows, _filter(self._read(name), rows)))
        if len(self.levels[level]) >= self.fanout:
            self._merge(level)

    def _merge(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        self._flush(self._together([self._read(run.name) for run in runs]), level + 1, sum(run.rows for run in runs))
        self.scratch.drop(*[run.name for run in runs])
        for run in runs:
            run.filter.unpersist()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.scratch.root}/{name}")

    def _together(self, parts: list[DataFrame]) -> DataFrame:
        """The entries of several runs, one for each digest."""
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def insert(self, rows: DataFrame, n: int | None = None) -> None:
        """One memtable of n rows (digest, doc_id); a table on disk, if it is still to be counted."""
        self._flush(rows.groupBy("digest").agg(self._best("doc_id").cast("long").alias("keep_id"), F.count("*").alias("n")), 0, rows.count() if n is None else n)

    def entries(self) -> DataFrame:
        """All digests with surviving id and count, over all runs."""
        return self._together([self._read(run.name) for run in self.runs])

    def candidates(self) -> list[DataFrame]:
        """Of every run the entries that stand more than once in it or pass another run's filter."""
        return [self._read(run.name).where((F.col("n") > 1) | _may_hold([r.filter for r in self.runs if r is not run])) for run in self.runs]

    def repeated(self) -> DataFrame:
        """The entries of the digests that stand more than once, over all runs."""
        return self._together(self.candidates()).where("n > 1")


def _filter(entries: DataFrame, n: int) -> Broadcast:
    return entries.sparkSession.sparkContext.broadcast(_needed(entries.select(F.xxhash64("digest").alias("doc_id")), n))


def _may_hold(filters: list[Broadcast]) -> Column:
    """Whether any of the filters lets the row's digest pass."""

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        keys, out = h.to_numpy(), np.zeros(len(h), bool)
        for one in filters:
            out |= _passes(one.value, keys)
        return pd.Series(out)

    return passes(F.xxhash64("digest")) if filters else F.lit(False)


def exact_dedup(docs: DataFrame, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    index = DigestIndex(spark, scratch, keep)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    total = rows.count()
    memtables = max(MEMTABLES, math.ceil(total / memtable_rows))
    # rows of one input partition share a memtable, as they would arrive together
    arrived = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("memtable"))
    log = scratch.save(arrived, "log", by="memtable")
    for i, n in sorted(log.groupBy("memtable").count().collect()):
        index.insert(log.where(F.col("memtable") == i), n)

    span = max(SALT_ROWS, math.ceil(total / HOT))
    repeated = scratch.save(index.repeated().withColumn("parts", F.ceil(F.col("n") / span).cast("int")), "repeated")
    hot = F.broadcast(repeated.where("parts > 1").select("digest", "parts"))  # HOT digests at most
    each = lambda entries: entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def dealt(own: DataFrame) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        return own.join(hot, "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), parts).cast("int")).drop("parts")

    may_repeat = _may_hold([_filter(repeated, repeated.count())])
    looked_up = dealt(log.where(may_repeat).select("doc_id", "digest")).join(each(repeated).hint("merge"), ["digest", "part"], "left")
    alone = log.where(~may_repeat).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    assigned = alone.unionByName(looked_up.select("doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n")))

    # byte verification of hits, against the surviving row of each digest
    own = dealt(rows.select("doc_id", digest(F.col("text")).alias("digest"), "text").where(may_repeat))
    columns = ["doc_id", "digest", "part", "parts", "keep_id", "text"]
    hits = scratch.save(own.join(each(repeated).hint("merge"), ["digest", "part"]).select(*columns), "hits-0", 500)
    settled, round_ = [], 0
    while True:
        survivors = each(hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "parts").agg(F.min("text").alias("keep_text"))).drop("parts")
        same = F.col("text") == F.col("keep_text")
        checked = hits.join(survivors.hint("merge"), ["digest", "part"]).withColumn("same", same).withColumn("text", F.when(~F.col("same"), F.col("text"))).drop("keep_text")
        checked = scratch.save(checked, f"checked-{round_}", 500)
        scratch.drop(f"hits-{round_}")
        settled.append(checked.where("same").select("doc_id", "digest", "keep_id", F.lit(round_).alias("round")))
        wrong = checked.where("not same").drop("keep_id", "same")
        if wrong.isEmpty():
            break
        best = wrong.groupBy("digest").agg((F.min if keep == "smallest" else F.max)("doc_id").alias("keep_id"))
        round_ += 1
        hits = scratch.save(wrong.join(best.hint("merge"), "digest").select(*columns), f"hits-{round_}", 500)
    if round_:
        final = reduce(DataFrame.unionByName, settled)
        sizes = final.groupBy("digest", "round").agg(F.count("*").alias("n"))  # one text a digest and round
        final = final.join(sizes, ["digest", "round"]).select("digest", "doc_id", "keep_id", "n")
        assigned = assigned.where("n = 1").unionByName(final)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return assigned.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")
