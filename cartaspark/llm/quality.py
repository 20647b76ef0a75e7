"""A compression classifier for text quality.

Two zstandard dictionaries are built, one of good and one of bad labelled texts.  A text that
resembles good ones compresses better with the good dictionary.  The difference of the compressed
sizes, divided by the text's own size, is turned into a probability by a logistic curve fitted on
other labelled texts.  Texts are compressed in blocks of ``BLOCK`` bytes, so that a dictionary counts
alike at every length; all blocks count.

The model is fitted on at most ``sample_docs`` labelled documents of each class, chosen by a hash of
their ids; half of them build the dictionaries, the others the curve.  A dictionary is made from
blocks spread evenly over each whole text, about forty times its size in all; only these blocks and
one number for each text of the curve reach the driver, however long the texts are.  The curve weighs
classes by their shares among *all* labelled rows.  An empty or null text has the share of good ones
as its score.  Rows with equal ids are scored each by its own text and learn from the same label;
rows without an id are scored and not learnt from.  Extra columns are ignored; an empty table gives
an empty result; without labels of both classes every score is the prior (1/2 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

BLOCK = 1024
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weight: float
    bias: float
    prior: float

    def prepare(self) -> None:
        self._ways = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            self._ways.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | bytes) -> float:
        """Over 0: the good dictionary suits better."""
        text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        sizes = [0, 0]
        for at in range(0, len(text), BLOCK):
            for k, way in enumerate(self._ways):
                sizes[k] += len(way.compress(text[at : at + BLOCK]))
        return (sizes[1] - sizes[0]) / len(text) if text else 0.0

    def score(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data or not self.good or not self.bad:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.weight * self.difference(data) + self.bias, -40, 40))))


def spread_blocks(text: bytes, most: int) -> list[bytes]:
    """At most `most` blocks of a text, spread evenly from its first to its last."""
    n = -(-len(text) // BLOCK)
    if n <= most:
        return [text[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
    return [text[i * BLOCK : (i + 1) * BLOCK] for i in sorted({round(k * (n - 1) / max(1, most - 1)) for k in range(most)})]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Train a dictionary on blocks; from too few of them it is their plain content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 50) -> tuple[float, float]:
    """Newton's method with a slight ridge; the classes weigh prior and 1 - prior."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (weight * (y - p)) - 1e-6 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 1000, dictionary_bytes: int = 112 << 10) -> CompressionModel:
    """docs: doc_id, text; labels: doc_id, label (1 good, 0 bad), one row per document."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = labels.where("label = 1").orderBy(*order).limit(sample_docs).unionByName(labels.where("label = 0").orderBy(*order).limit(sample_docs))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''").join(F.broadcast(chosen), "doc_id")  # at most 2 x sample_docs small rows
    most = max(1, 40 * dictionary_bytes // max(1, sample_docs // 2) // BLOCK)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                found = spread_blocks(text.as_py().encode("utf-8", "surrogatepass"), most)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([found], pa.list_(pa.binary()))], names=["doc_id", "label", "blocks"])

    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    drawn = sample.where("half = 0").select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"), "text").mapInArrow(draw, "doc_id long, label int, blocks array<binary>")
    for r in sorted(drawn.collect()):
        blocks[r["label"]] += [bytes(x) for x in r["blocks"]]
    if min(len(blocks[0]), len(blocks[1])) < 1:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    model = CompressionModel(_dictionary(blocks[1], dictionary_bytes), _dictionary(blocks[0], dictionary_bytes), 1.0, 0.0, prior)
    measured = sample.where("half = 1").select(F.col("label").cast("long").alias("doc_id"), "text")
    found = _each(measured, model, CompressionModel.difference, "difference").collect()
    x, y = (np.array([r[k] for r in found], float) for k in ("difference", "doc_id"))
    if len(set(y.tolist())) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    at = np.lexsort((x, y))
    model.weight, model.bias = _logistic(x[at], y[at], prior)
    return model


def _each(rows: DataFrame, model: CompressionModel, what, name: str) -> DataFrame:
    """doc_id and what(model, text) of rows of both."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.prepare()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([what(own, x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", name])

    return rows.mapInArrow(run, f"doc_id long, {name} double")


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    return _each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), model, CompressionModel.score, "score")
