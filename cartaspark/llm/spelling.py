"""Groups of spelling variants: each word's most frequent near word, by dense prefix-suffix tiling.

Two different words are near if one inserted, deleted or replaced code point tells them apart, which
is so exactly if their common prefix and common suffix together reach the longer length minus one.

Candidates.  Let M be the longer length of a pair and h = M // 2.  A near pair shares its first h code
points, or else its last M - h.  So every word meets others under four keys: prefix and suffix, once
with M its own length and once with M one more.  A pair whose longer length is M is judged under M
alone, and under the suffix only if its common prefix is shorter than h: once in all.

Tiles.  Words of a key are dealt to blocks by hash, as many as the key's words fill (AREA code points
a block at most); a tile is a pair of blocks.  In a tile the words stand in padded matrices of code
points, one aligned at the start and one at the end, and columns are compared one after the other
for all pairs at once.  A tile returns for each word the number of its near words there and the best
of them, never pairs; sums and bests meet by word.  A key shared by very many words makes many
tiles of bounded size for many tasks; the work of a key grows with the square of its words.

Forms.  A word's form is its near word of largest n (ties: smallest in code-point order) if that n
is at least ``ratio`` times its own.  With a ratio over one forms cannot run in circles and chains
are short; roots are found by doubling the steps.

A null word or count takes no part; counts of a repeated word add up.  Words of any length take
part.  An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch

#: Code points and words of a block at most.
AREA, BLOCK_WORDS = 1 << 14, 1024
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 500_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def count_words(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, and how often they occur.

    With `damage`, a run whose CRC-32 h of "<doc_id>:<run>" is divided by it loses its code point at
    h modulo its length; runs of rows without an id stay.  Null and empty texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for run in RUN.findall((text.as_py() or "").translate(_UPPER)):
                    own[run] = own.get(run, 0) + 1
                head = zlib.crc32(f"{key}:".encode()) if damage and key is not None else None
                for run, n in own.items():
                    if head is not None and (h := zlib.crc32(run.encode(), head)) % damage == 0:
                        run = run[: (at := h % len(run))] + run[at + 1 :]
                    counts[run] = counts.get(run, 0) + n
                if len(counts) > TASK_WORDS:
                    yield out()
        if counts:
            yield out()

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix aligned at the start, matrix aligned at the end, lengths); padding is -1 and never equals a code point."""
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max()) if len(words) else 0
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    row, column = np.repeat(np.arange(len(words)), length), np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    start, end = np.full((len(words), width), -1, np.int32), np.full((len(words), width), -1, np.int32)
    start[row, column] = points
    end[row, length[row] - 1 - column] = points
    return start, end, length


def near_pairs(a: tuple, b: tuple, longest: int, half: int, suffix: bool) -> np.ndarray:
    """Which pairs of two blocks (of code_points) are near, have `longest` as the longer length, and are judged under this kind of key."""
    (a_start, a_end, a_length), (b_start, b_end, b_length) = a, b
    common = []
    for one, other in ((a_start, b_start), (a_end, b_end)):
        alive = np.ones((len(a_length), len(b_length)), bool)
        total = np.zeros(alive.shape, np.int32)
        for k in range(min(one.shape[1], other.shape[1])):
            # padding equals nothing, so a shorter word's prefix ends where it does
            alive &= (one[:, k, None] == other[None, :, k]) & (one[:, k, None] >= 0)
            if not alive.any():
                break
            total += alive
        common.append(total)
    prefix, both = common[0], common[0] + common[1]
    own = np.maximum(a_length[:, None], b_length[None, :]) == longest
    same = (a_length[:, None] == b_length[None, :]) & (prefix == a_length[:, None])
    return (both >= longest - 1) & own & ~same & ((prefix < half) if suffix else (prefix >= half))


def _keys(words: DataFrame) -> DataFrame:
    """word, n, longest, suffix, part: a row for each key of a word."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longest")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    half = F.col("longest").cast("int") / 2
    half = F.floor(half).cast("int")
    part = F.when(F.col("suffix"), F.col("word").substr(size - (F.col("longest") - half) + 1, F.col("longest") - half)).otherwise(F.col("word").substr(F.lit(1), half))
    # a one-letter word as the longer of a pair, or a suffix longer than the word, shares nothing
    return rows.select("*", part.alias("part")).where(F.when(F.col("suffix"), F.col("longest") - half <= size).otherwise(half <= size))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, best_n, best for every word (word, n; distinct) that has near words."""
    keys = ["longest", "suffix", "part"]
    rows = _keys(words)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")
    each = F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.lit(AREA) / F.col("longest"))))
    sizes = scratch.save(sizes.withColumn("blocks", F.ceil(F.col("members") / each).cast("int")).drop("members"), "sizes")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    met = rows.join(sizes.hint("merge"), keys).withColumn("own", own)
    # block i of a key takes part in the tiles (i, j) and (j, i) with i <= j
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "word", "n")
    tile = [*keys, "i", "j"]
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile, "second")
    found = dealt.mapInArrow(_judge, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the blocks of each tile; rows of a tile stand together and may reach over several batches."""
    for rows in _tiles(batches):
        out: list[tuple] = []
        for (longest, suffix, _, i, j), words, counts, second in rows:
            cut = int(np.searchsorted(second, True))
            blocks = [(words, counts)] * 2 if i == j else [(words[:cut], counts[:cut]), (words[cut:], counts[cut:])]
            if not (blocks[0][0] and blocks[1][0]) or i == j and len(words) < 2:
                continue
            ordered = []
            for own, n in blocks[: 1 if i == j else 2]:
                order = sorted(range(len(own)), key=lambda k, own=own, n=n: (-n[k], own[k]))  # the best near word is the first
                ordered.append(([own[k] for k in order], [n[k] for k in order]))
            points = [code_points(own) for own, _ in ordered]
            near = near_pairs(points[0], points[-1], longest, longest // 2, suffix)
            for matrix, one, other in ((near, ordered[0], ordered[-1]), *(((near.T, ordered[1], ordered[0]),) if i != j else ())):
                total = matrix.sum(1)
                some = np.flatnonzero(total)
                first = matrix[some].argmax(1)
                out += [(one[0][k], t, other[1][f], other[0][f]) for k, t, f in zip(some.tolist(), total[some].tolist(), first.tolist(), strict=True)]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (tile, words, counts, second) whose rows are complete."""
    held: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
        keys = [table[c].to_pylist() for c in ("longest", "suffix", "part", "i", "j")]
        rows = list(zip(*keys, strict=True))
        edges = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        stop = len(edges) - 1 if last else len(edges) - 2
        words, counts, second = table["word"].to_pylist(), table["n"].to_pylist(), table["second"].to_pylist()
        tiles = [(rows[lo], words[lo:hi], counts[lo:hi], second[lo:hi]) for lo, hi in zip(edges[:stop], edges[1 : stop + 1], strict=True)]
        return tiles, table.slice(edges[stop])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        tiles, held = cut(table if held is None or not held.num_rows else pa.concat_tables([held, table]), False)
        if tiles:
            yield tiles
    if held is not None and held.num_rows:
        yield cut(held, True)[0]


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of word and n; see the module's text.  `ratio` is over one."""
    if ratio <= 1:
        raise ValueError("ratio must be over one: forms could run in circles")
    scratch = Scratch(words.sparkSession, "spelling")
    clean = words.select(F.col("word").cast("string"), F.col("n").cast("long")).where("word is not null and n is not null")
    clean = scratch.save(clean.groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = scratch.save(near_words(clean, scratch), "near")
    known = F.col("best_n") >= ratio * F.col("n")
    joined = clean.join(near.hint("merge"), "word", "left")
    full = scratch.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")), "forms")
    # a step leads from a word to what is known of its way so far; steps double until none leads on
    steps, round_ = full.where("form is not null").select("word", F.col("form").alias("root")), 0
    steps = scratch.save(steps, "steps-0")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        round_ += 1
        moved = scratch.save(moved, f"steps-{round_}")
        scratch.drop(f"steps-{round_ - 1}")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return full.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
