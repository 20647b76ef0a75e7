"""Bounds kept up to date from a stream of sheet events (an extension of the batch procedures)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bounds import diff_bounds, upsert_bounds


def apply_events(base: DataFrame, events: DataFrame) -> DataFrame:
    """Bounds (sheet_id, geom_json, digest) after events (event_id, op, sheet_id, geom_json, digest): of each sheet the last event counts; op is "upsert" or "delete"."""
    last = events.groupBy("sheet_id").agg(F.max_by(F.struct("op", "geom_json", "digest"), "event_id").alias("e")).select("sheet_id", "e.*")
    new = last.where("op = 'upsert'").select("sheet_id", "geom_json", "digest")
    return upsert_bounds(new, base, last.where("op = 'delete'").select("sheet_id"))


def maintain(spark: SparkSession, events: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], changed: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that applies each batch of a stream of events to stored bounds and hands on what changed.

    read() gives the present bounds; write(bounds, batch) must store them idempotently by batch;
    changed(differences, batch) gets the rows of diff_bounds.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = read()
        after = apply_events(before, batch)
        changed(diff_bounds(before, after), number)
        write(after, number)
        batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by window and kind (ts, op), with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
