"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

1. Every document becomes token ids plus an end id; only documents longer than a sequence are cut.
   This pass writes one small row per piece (length and checksum, no ids).
2. Only the histogram of piece lengths, which has at most ``capacity`` bars whatever the corpus, is
   brought to the driver.  There each bin is filled greedily with the largest lengths that fit;
   then its smallest piece is replaced by two unpacked pieces that fill the widened gap more
   tightly.  A pattern is repeated as often as the histogram allows, so planning takes a few
   thousand steps for any number of documents.
3. Pieces of one length are numbered by counts per (hash bucket, length), never by one sort of a
   whole group, and number r of a length has its place in the plan.

Nulls: a null text is empty; an empty text is the end id alone.  Rows with a null id are packed as
well.  Repeated rows are packed once per row.  An empty table gives an empty result.  Columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import Scratch
from .text import pieces

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a bucket on average; a common length spreads over as many buckets as the corpus needs.
BUCKET_PIECES, LEAST_BUCKETS = 1 << 18, 64
#: Words kept in each of the two generations of a cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Text encoded at once, in bytes and documents; the more, the fewer words come up again.
PIECE_BYTES, BATCH_ROWS = 16 << 20, 5000
#: Letters up to U+024F (but for U+0130, whose lower case is two characters), then ASCII marks other than the apostrophe.
_LETTERS_AND_MARKS = re.compile(r"((?:(?![\u0130])[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])+)([!-&(-/:-@\[-`{-~]*)\Z")
_encoders: dict[str, WordEncoder] = {}


class Cache(dict):
    """Ids by word in two generations, so that memory stays bounded while frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def put(self, words: list[str], ids: list[bytes]) -> None:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self.update((w, i) for w, i in zip(words, ids, strict=True) if len(w) <= CACHE_CHARS)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            return self.make(word)
        self[word] = ids
        return ids

    def unknown(self, words: set[str]) -> set[str]:
        return (words - self.keys()) - self.old.keys()


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the UTF-8 bytes of code points from U+0080 to U+024F: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(shown)))
    return {c: "".join(table[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}


class WordEncoder:
    """Token ids of whole texts by way of their distinct words.

    For a tokenizer that drops white space and never joins across it, ids of a text are the ids of its
    words in order.  Arrow cuts a column of texts at ASCII white space and numbers its distinct words;
    only those are looked at one by one, and their ids are put together by array operations.  If the
    tokenizer also ignores case and keeps letters apart from marks, most words are a run of letters
    and a run of marks; new runs of letters go to its model in one text, where a token that ends a
    word tells runs apart.  These properties are probed; a tokenizer without them encodes whole texts
    or words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = Tokenizer(self.tokenizer.model), _byte_letters()
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.by_word = self._ids("a b\n\tc") == b"".join(map(self._ids, "abc")) and not self._ids(" \n\t")
        probes = ["word", "the", "\u00e9t\u00e9", "stra\u00dfe", "\u0142\u00f3d\u017a", "qzxj"]
        self.by_part = self.by_word and self._letters(probes) == [self._ids(p) for p in probes] and all(self._ids(a.upper() + b) == self._ids(a.upper().lower()) + self._ids(b) for a in probes for b in (".", ",", "!!", '")', "***", "|"))
        self.marks: dict[str, bytes] = {}
        self.words = Cache(self._ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of lower-case runs of letters; an empty list if ends of words do not tell them apart."""
        written = " ".join(r if r.isascii() else r.translate(self.letters) for r in runs)
        ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(runs):
            return []
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= CACHE_WORDS:
                self.marks.clear()
            self.marks[marks] = self._ids(marks)
        return self.marks[marks]

    def _prepare(self, words: list[str]) -> None:
        """Encode the words that no cache has."""
        fresh = [(w, m[1].lower(), m[2]) for w in self.words.unknown(set(words)) if (m := _LETTERS_AND_MARKS.match(w))]
        runs = list({run for _, run, _ in fresh})
        made = dict(zip(runs, self._letters(runs), strict=True)) if runs else {}
        self.words.put([w for w, _, _ in fresh], [made[run] + self._marks(marks) if marks else made[run] for _, run, marks in fresh])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            numbered = lists.flatten().dictionary_encode()
            words = numbered.dictionary.to_pylist()
            if self.by_part:
                self._prepare(words)
            made = [self.words[w] for w in words]
            which = numbered.indices.to_numpy()
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        else:
            made, which, first = [self._ids(t) for t in texts.to_pylist()], np.arange(len(texts)), np.arange(len(texts) + 1)
        sizes = np.array([len(m) // 4 for m in made], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        pool = np.frombuffer(b"".join(made), "<u4")
        length = sizes[which] if len(which) else np.zeros(0, np.int64)
        place = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat((starts[which] if len(which) else starts[:0]) - place[:-1], length) + np.arange(place[-1])
        return pool[at], place[first]


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Pause the search for reference cycles: encoding makes millions of short-lived objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it outlives single tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_into_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  `text_bytes` are encoded at once."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in (part for whole in batches for part in pieces(whole, whole.schema.names[1], text_bytes)):
            rows: list[tuple] = []
            with no_cycle_search():
                ids, offsets = encode(batch.column(1))
            for key, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[lo:hi].tobytes() + end
                for k, at in enumerate(range(0, len(own), step)):
                    part = own[at : at + step]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on a histogram of lengths: [(lengths in a bin, number of such bins)].

    Lengths are over 0 and at most `capacity`.  Every length occurs in the bins as often as in the
    histogram.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan = []
    while (sizes := np.flatnonzero(left)).size:
        taken = {}

        def take(size: int, by: int = 1, taken=taken) -> None:
            taken[size] = taken.get(size, 0) + by
            left[size] -= by

        bin_, gap = [], capacity
        while gap > 0:
            sizes = np.flatnonzero(left[: gap + 1])
            if not sizes.size:
                break
            size = int(sizes[-1])
            take(size)
            bin_.append(size)
            gap -= size
        if gap and bin_:
            least = bin_[-1]
            room = gap + least
            sizes = np.flatnonzero(left[: room + 1])
            best, pair = least, None
            if sizes.size:
                partner = np.searchsorted(sizes, room - sizes, "right") - 1  # the largest that fits beside each
                fits = partner >= 0
                own = fits & (sizes == sizes[np.maximum(partner, 0)]) & (left[sizes] < 2)
                partner = np.where(own, partner - 1, partner)
                fits &= partner >= 0
                total = np.where(fits, sizes + sizes[np.maximum(partner, 0)], 0)
                k = int(total.argmax())
                if total[k] > best:
                    pair = (int(sizes[k]), int(sizes[partner[k]]))
            if pair:
                take(least, -1)
                for size in pair:
                    take(size)
                bin_ = [*bin_[:-1], *sorted(pair, reverse=True)]
        used = {size: n for size, n in taken.items() if n}
        again = min(int(left[size]) // n for size, n in used.items())
        for size, n in used.items():
            left[size] -= n * again
        plan.append((bin_, 1 + again))
    return plan


def _segments(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first number, first sequence, offset) of the runs in which that length is placed."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, copies in plan:
        offset = 0
        for size in lengths:
            out.setdefault(size, []).append((given.get(size, 0), sequence, offset))
            given[size] = given.get(size, 0) + copies
            offset += size
        sequence += copies
    return {size: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for size, runs in out.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, text_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` tokens; a task encodes `text_bytes` of text at once.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.save(cut_into_pieces(docs, vocabulary, capacity, end_id, text_bytes), "pieces", BATCH_ROWS)
    buckets = max(LEAST_BUCKETS, -(-cut.count() // BUCKET_PIECES))
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    # at most buckets x capacity rows, far fewer than pieces
    counts = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.save(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(_segments(plan_bins(histogram, capacity)))

    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    numbered = bucketed.withColumn("_inside", F.row_number().over(inside) - 1).join(counts.drop("_n").hint("merge"), ["length", "_bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                first, start, at = placed.value[int(size)]
                run = np.searchsorted(first, number[own], "right") - 1
                sequence[own], offset[own] = start[run] + number[own] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    number = (F.col("_before") + F.col("_inside")).cast("long").alias("_number")
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", number).mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
