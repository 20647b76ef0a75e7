"""Benchmark decontamination by spaced-seed hashing.

A seed mask such as ``11011011`` takes some token positions of a window and ignores the others, so
two passages still share seed hashes where tokens have been substituted.  Seeds of all benchmark
items are held against the seeds of every window of every document; around each hit the item is
laid over the document without gaps.  A pair is kept if some stretch of it, three quarters of whose
tokens at least are equal, has ``min_overlap`` equal tokens, or four fifths of the tokens of an item
too short for that.  With the default bounds every such stretch holds a hit of one of the two masks,
wherever the substitutions are: without ``1111`` and ``11011`` all runs of equal tokens are of three
at most and no single substitution has two on both sides.

Tokens are runs of characters other than ASCII marks and white space, case-folded by Unicode's rules:
``CIÓN`` equals ``ción`` and ``STRASSE`` equals ``straße``.
Benchmark items are brought to the executors in blocks of at most about ``block_chars`` characters,
one block at a time: a larger benchmark takes more passes over the documents, not more memory.

An item of fewer than ``min_tokens`` tokens matches where all its tokens stand in a row, as one
substitution would leave too little.  Null and empty items, and those of marks alone, have no token
and match nothing.  A null text is empty and never matches.  Items without an id are looked for like
others and give a null item_id.  ``find_overlaps`` has one row for each pair of ids that occur with an
overlap, where rows without an id (and items without one) count as one id; ``decontaminate`` judges
every row by itself: rows are addressed by a hash of id and text, so neither a missing id nor one that
several rows carry makes a leaked row stay or a clean one go.  Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linededup import row_address
from .shared import Scratch, free_name
from .text import ASCII_MARK, LENGTH, PLACES, mix, pieces, utf8, words

MASKS = ("1111", "11011")
SCHEMA = "a1 long, a2 long, doc_id long, item_id long, doc_token int, item_token int, n_tokens int, n_equal int"


def _folded(column: pa.Array) -> pa.Array:
    """Texts without case; null counts as empty."""
    return pa.array([(t or "").casefold() for t in column.to_pylist()], pa.large_string())


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every place where the mask fits."""
    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for j, on in enumerate(mask):
                if on == "1":
                    out += hashes[j : j + n] * PLACES[j]
            out += np.uint64(len(mask)) * LENGTH
    return mix(out)


class SeedTable:
    """Seeds of some benchmark items, for one mask each: sorted hashes with item number and place."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], min_tokens: int):
        data, offsets = utf8(_folded(pa.array([t for _, t in items], pa.string())))
        hashes, _, _, first = words(data, offsets, ASCII_MARK)
        self.ids, self.min_tokens = [i for i, _ in items], min_tokens
        self.hashes, self.first = hashes, first
        rows: dict[str, list[tuple[np.ndarray, int]]] = {}
        for k, own in enumerate(hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)):
            if len(own):
                fitting = [m for m in masks if len(m) <= len(own)] or ["1" * len(own)]
                for mask in fitting:
                    rows.setdefault(mask, []).append((_seeds(own, mask), k))
        self.by_mask = {}
        for mask, parts in rows.items():
            seeds = np.concatenate([s for s, _ in parts])
            item = np.concatenate([np.full(len(s), k) for s, k in parts])
            place = np.concatenate([np.arange(len(s)) for s, _ in parts])
            order = np.argsort(seeds, kind="stable")
            may = np.zeros(1 << 20, bool)
            may[seeds >> np.uint64(44)] = True
            self.by_mask[mask] = (seeds[order], item[order], place[order], may)

    def hits(self, hashes: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, item numbers and diagonals of all seed hits, each once; `most` bounds the hits worked on at once."""
        longest = int(np.diff(self.first).max(initial=0))
        span = longest + int(np.diff(first).max(initial=0)) + 1
        found = [np.zeros(0, np.int64)]
        for mask, (seeds, item, place, may) in self.by_mask.items():
            own = _seeds(hashes, mask)
            at = np.flatnonzero(may[own >> np.uint64(44)])
            lo = np.searchsorted(seeds, own[at], "left")
            times = np.searchsorted(seeds, own[at], "right") - lo
            text = np.searchsorted(first, at, "right") - 1
            some = (times > 0) & (at + len(mask) <= first[text + 1])
            at, lo, times, text = at[some], lo[some], times[some], text[some]
            for part in _runs(times, most):
                which = np.repeat(np.arange(part.start, part.stop), times[part])
                seed = lo[which] + _counted(times[part])
                shift = at[which] - first[text[which]] - place[seed]
                found.append(np.unique((text[which] * len(self.ids) + item[seed]) * span + shift + longest))
        pair, shift = np.divmod(np.unique(np.concatenate(found)), span)
        return *np.divmod(pair, max(1, len(self.ids))), shift - longest

    def overlaps(self, hashes: np.ndarray, first: np.ndarray, min_overlap: int, most: int = 1 << 20) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, item number, first tokens in text and item, tokens, equal tokens) of each diagonal that reaches the bound."""
        text, item, shift = self.hits(hashes, first, most)
        size = np.diff(self.first)[item]
        bound = np.where(size < self.min_tokens, size, np.minimum(min_overlap, -(-4 * size // 5)))
        lo = np.maximum(0, -shift)
        length = np.minimum(size, np.diff(first)[text] - shift) - lo
        for part in _runs(length, most):
            at = _counted(length[part])
            mine = np.repeat(self.first[item[part]] + lo[part], length[part]) + at
            theirs = np.repeat(first[text[part]] + lo[part] + shift[part], length[part]) + at
            equal = self.hashes[mine] == hashes[theirs]
            ends = np.cumsum(length[part])
            starts = ends - length[part]
            for k in np.flatnonzero(np.add.reduceat(equal, starts, dtype=np.int64) >= bound[part]).tolist():
                start, end, same = widest_stretch(equal[starts[k] : ends[k]])
                i = part.start + k
                if same >= bound[i]:
                    yield int(text[i]), int(item[i]), int(lo[i] + shift[i]) + start, int(lo[i]) + start, end - start, same


def _counted(times: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of `times`."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Cut into runs whose sizes sum up to `most` or that have one member."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def widest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the stretch with the most equal tokens, three quarters of its tokens at least; the first of equals, without substitutions at its ends."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -3))))
    count = np.concatenate(([0], np.cumsum(equal)))
    # for each end the first start from which the score does not fall
    starts = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(count - count[starts]))
    start = int(starts[end])
    inside = start + np.flatnonzero(equal[start:end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def _overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, min_tokens: int = 8, masks: tuple[str, ...] = MASKS, block_chars: int = 4_000_000) -> DataFrame:
    """A row (SCHEMA) for every diagonal of a row and an item that reaches the bound; a1, a2: the row's address."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "overlaps")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    one, two = row_address(docs)
    texts = docs.select(one.alias("a1"), two.alias("a2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        table = spark.sparkContext.broadcast(SeedTable([(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()], masks, min_tokens))

        def search(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            seeds = table.value
            for batch in batches:
                rows = []
                for part in pieces(batch, "text"):
                    hashes, _, _, first = words(*utf8(_folded(part.column(3))), ASCII_MARK)
                    for text, item, *place in seeds.overlaps(hashes, first, min_overlap):
                        rows.append((*(part.column(c)[text].as_py() for c in range(3)), seeds.ids[item], *place))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                types = (*[pa.int64()] * 4, *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        found.append(scratch.save(texts.mapInArrow(search, SCHEMA), f"found-{block}"))
        table.destroy()
    return reduce(DataFrame.unionByName, found)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that overlap; the stretch of each pair with the most equal tokens.

    Returns doc_id, item_id, doc_token and item_token (first tokens of the stretch), n_tokens, n_equal.
    Options: those of _overlaps.
    """
    stretch = F.struct(F.col("n_equal"), -F.col("n_tokens"), -F.col("doc_token"), -F.col("item_token"))
    return _overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(*[F.max_by(c, stretch).alias(c) for c in ("doc_token", "item_token", "n_tokens", "n_equal")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_equal: int = 6, **options) -> DataFrame:
    """The documents without any that overlap a benchmark item by `least_equal` tokens; all columns stay.

    Shorter items are everyday phrases: ``find_overlaps`` names their matches, but no document goes for them.
    """
    one, two = free_name(docs, "_a1"), free_name(docs, "_a2")
    leaked = _overlaps(docs, benchmark, **options).where(F.col("n_equal") >= least_equal).select(F.col("a1").alias(one), F.col("a2").alias(two)).distinct()
    addressed = docs.select("*", *(a.alias(n) for a, n in zip(row_address(docs), (one, two), strict=True)))
    return addressed.join(leaked.hint("merge"), [one, two], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
