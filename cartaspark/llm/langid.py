"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams that are typical of it.  The filters are stored
bit-sliced: slot i of one table holds bit i of *all* filters as a mask, so a lookup fetches one mask
per hash function and their conjunction names every language that contains the n-gram.  Over a
text, the popcount of each language is corrected for the filter's false positives, and the largest
decides; the score is the share of the text's n-grams that the language knows.

The model is fitted on at most about ``sample_docs`` documents of each language, chosen by a hash of
their ids, and holds every n-gram that a sample has ``min_count`` times or more: its size grows with
the number of languages, not with the corpus.  A slot has one 64-bit word for every 64 languages.  A
text that is null or has no letter is ``und`` with score 0.  Ties go to the language first in
alphabetical order.  Every row is judged by its own text, whatever its id; all rows of one id are in
the sample or none.  Extra columns are ignored; an empty table gives an empty result.  Without any
training document every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import PLACES, mix

SIZES = (2, 3, 5)
HASHES = 3
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text that hold a letter; what is no letter counts as a space; empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, points, 32).astype(np.uint64)
    joined = letter[1:] | letter[:-1]  # runs of marks and spaces count as one place
    keep = np.concatenate(([True], joined))
    codes = codes[keep]
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(codes) >= n:
                value = np.full(len(codes) - n + 1, n, np.uint64)
                for j in range(n):
                    value += codes[j : j + len(value)] * PLACES[j]
                out.append(value)
    return mix(np.concatenate(out))


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    part = np.uint64((1 << bits) - 1)
    return [((hashes >> np.uint64(i * 21)) & part).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """The bit-sliced table; `fpr` is each language's rate of false positives."""

    languages: list[str]
    bits: int
    table: np.ndarray
    fpr: np.ndarray

    @classmethod
    def build(cls, sets: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(sets)
        most = max((len(v) for v in sets.values()), default=0)
        bits = min(24, max(10, int(np.ceil(np.log2(max(1, most) * 8)))))
        kind = next((t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= n), np.uint64)
        table = np.zeros((-(-max(1, len(languages)) // 64), 1 << bits), kind)
        fpr = np.zeros(len(languages))
        for k, name in enumerate(languages):
            word, bit = table[k // 64], kind(k % 64)
            for at in _slots(sets[name], bits):
                word[at] |= kind(1) << bit
            fpr[k] = float(((word >> bit) & kind(1)).mean()) ** HASHES
        return cls(languages, bits, table, fpr)

    def identify(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text else np.zeros(0, np.uint64)
        if not len(found) or not self.languages:
            return "und", 0.0
        slots, one = _slots(found, self.bits), self.table.dtype.type(1)
        counts = np.zeros(len(self.languages))
        for w, word in enumerate(self.table):
            masks = word[slots[0]]
            for at in slots[1:]:
                masks = masks & word[at]
            for k in range(64 * w, min(64 * w + 64, len(counts))):
                counts[k] = np.count_nonzero(masks & (one << self.table.dtype.type(k % 64)))
        known = np.clip((counts - len(found) * self.fpr) / (1 - self.fpr), 0, len(found))
        best = int(known.argmax())
        return self.languages[best], float(known[best] / len(found))


def fit(labelled: DataFrame, sample_docs: int = 1500, share: float = 0.25, min_count: int = 3) -> LanguageFilters:
    """labelled: doc_id, text, lang.  An n-gram belongs to a language if its rate there is at least `share` of its highest rate in any language."""
    labelled = labelled.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    bound = (F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")) * (1 << 31)).cast("long")
    # one row a language: the labels are the classes of the model
    bounds = {r["lang"]: r["bound"] for r in sizes.select("lang", bound.alias("bound")).collect()}
    picked: Column = F.lit(False)
    if bounds:
        held = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair])
        picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < held[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(lang, []).append(grams(text.as_py()))
            for lang, parts in texts.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = labelled.where(picked).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= min_count).toArrow()  # of the samples alone
    names, grams_ = found["lang"].to_numpy(), found["gram"].to_numpy()
    rates = found["n"].to_numpy().astype(float)
    kinds, lang = np.unique(names.astype(str), return_inverse=True)
    rates /= np.bincount(lang, rates, len(kinds))[lang] if len(lang) else 1
    _, gram = np.unique(grams_, return_inverse=True)
    highest = np.zeros(gram.max() + 1 if len(gram) else 0)
    np.maximum.at(highest, gram, rates)
    typical = rates >= share * highest[gram]
    return LanguageFilters.build({str(name): np.sort(grams_[typical & (lang == k)]).view(np.uint64) for k, name in enumerate(kinds)})


def identify(docs: DataFrame, model: LanguageFilters, carry: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred and score of every document; with `carry` all columns of docs and these two, under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            pairs = [shared.value.identify(x.as_py()) for x in batch.column(at)]
            lang, score = pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())
            columns = batch.columns if carry else [batch.column(0)]
            own = batch.schema.names if carry else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, lang, score], names=[*own, *names])

    source = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if carry or f.name == "doc_id")
    return source.mapInArrow(predict, f"{kept}, `{names[0]}` string, `{names[1]}` double")
