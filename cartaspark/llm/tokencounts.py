"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle.

1. ``frequent_lengths`` streams all texts once.  Every task keeps a summary of bounded size of the
   pre-tokens it meets (Misra and Gries: when the summary is full, the least counts are subtracted
   from all).  Summaries are one small row a task; they are merged file by file, a few dozen at a
   time, until few are left, and never regrouped by pre-token.  Any pre-token that makes up more
   than 1 / ``SUMMARY`` of the corpus is certain to be in the end.
2. The most frequent ones, with the number of their tokens, form a compact hash table
   (``LengthTable``: open addressing over Arrow strings) of at most ``TABLE`` entries and
   ``TABLE * LONGEST`` bytes, whatever the corpus; it is broadcast.
3. ``count_tokens`` cuts each text into pre-tokens, numbers the distinct ones of a slice of text,
   and adds up their lengths: from the table, else from the worker's cache, else by the tokenizer.

Only the speed depends on tables and caches: every hit is compared byte by byte, every miss is encoded.

Texts are cut by array operations on bytes where the rules of byte-level vocabularies are certain:
before white space that follows a letter, digit or mark, and between runs of letters (ASCII and
U+00C0 to U+024F), digits and marks, but never after an apostrophe, which may open a contraction.
Between two cuts lies one pre-token, or a few that the tokenizer itself tells apart.  Texts that
hold an added token's string go to the tokenizer whole.  With other kinds of vocabulary, whose
tokens may reach across such cuts, each whole text is one entry.

Nulls count as empty; an empty text has no bytes and no tokens.  Rows without an id and repeated
rows are counted row by row.  A text of any length is counted whole.  An empty table gives an empty
result.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .packing import Cache, no_cycle_search
from .shared import Scratch
from .text import constants, mix, pieces

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Entries of a task's summary, entries of the broadcast table, bytes of its longest entry.
SUMMARY, TABLE, LONGEST = 1 << 16, 1 << 15, 48
#: Summaries merged by one task.
FAN_IN = 32
#: Bytes of text cut at once.
SLICE_BYTES = 4 << 20

_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE = 1, 2, 3, 4, 5
#: Kind of each ASCII byte; 0 where nothing is known.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
for _b in range(0x21, 0x7F):
    _KIND[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _APOSTROPHE if chr(_b) == "'" else _MARK
#: May a text be cut between a byte of one kind and one of another?
_CUT = np.zeros((6, 6), bool)
for _before, _after in ((_LETTER, (_SPACE, _DIGIT, _MARK, _APOSTROPHE)), (_DIGIT, (_SPACE, _LETTER, _MARK, _APOSTROPHE)), (_MARK, (_SPACE, _LETTER, _DIGIT)), (_APOSTROPHE, (_SPACE,))):
    _CUT[_before, list(_after)] = True
_CUT = _CUT.ravel()


def pre_token_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte places where a pre-token begins, with the end of data as the last; `offsets` are those of whole texts."""
    kind = _KIND[data]
    if len(data) and data.max() >= 0xC3:
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
        second = data[lead + 1]
        # U+00C0 to U+024F, all letters but for the signs of multiplication and division
        lead = lead[((data[lead] < 0xC9) | (second < 0x90)) & ~((data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)))]
        kind[lead] = kind[lead + 1] = _LETTER
    cuts = np.flatnonzero(_CUT[kind[:-1] * np.uint8(6) + kind[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
    own = np.zeros(len(data) + 1, bool)
    own[cuts] = True
    own[offsets] = True
    own[[0, -1]] = True
    return np.flatnonzero(own)


def _strings(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The strings between cuts, without copying."""
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of short strings, column by column of the bytes."""
    _, places, data = strings.buffers()
    offsets = np.frombuffer(places, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(1, np.uint8)
    length = np.diff(offsets)
    out = mix(length.astype(np.uint64))
    with np.errstate(over="ignore"):
        for k, c in enumerate(constants(int(length.max()) if len(length) else 0, 29)):
            own = np.flatnonzero(length > k)
            out[own] += (data[offsets[own] + k].astype(np.uint64) + np.uint64(1)) * c
    return mix(out)


class LengthTable:
    """Token counts of a fixed set of strings: slots by hash with linear probing, strings and counts in arrays."""

    def __init__(self, strings: list[str], counts: list[int]):
        self.strings = pa.array(strings, pa.large_string())
        self.counts = np.array(counts, np.int32)
        size = 1 << max(4, int(2 * len(strings)).bit_length())
        self.slots = np.full(size, -1, np.int32)
        for i, h in enumerate(_hashes(self.strings).tolist() if strings else []):
            at = h & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = i

    def lengths(self, asked: pa.Array) -> np.ndarray:
        """The count of each asked string, -1 where the table does not have it."""
        out = np.full(len(asked), -1, np.int64)
        left = np.flatnonzero(pc.less_equal(pc.binary_length(asked), LONGEST).to_numpy(zero_copy_only=False))
        if not len(left) or not len(self.counts):
            return out
        strings = asked.take(pa.array(left))
        at = (_hashes(strings) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(left):
            found = self.slots[at]
            some = found >= 0
            left, at, found, strings = left[some], at[some], found[some], strings.filter(pa.array(some))
            same = pc.equal(self.strings.take(pa.array(found)), strings).to_numpy(zero_copy_only=False)
            out[left[same]] = self.counts[found[same]]
            other = ~same
            left, at, strings = left[other], (at[other] + 1) & (len(self.slots) - 1), strings.filter(pa.array(other))
        return out


class TokenCounter:
    """Counts a vocabulary's tokens; one for each worker and vocabulary, with a cache that outlives tasks."""

    def __init__(self, path: str):
        self.by_piece, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
        else:
            import os

            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            before = tokenizer.pre_tokenizer
            plain = tokenizer.normalizer is None and type(before).__name__ == "ByteLevel"
            self.by_piece = plain and getattr(before, "use_regex", True) and not getattr(before, "add_prefix_space", True)
        self.cache = Cache(lambda text: self.encode([text])[0])

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct entries, entry numbers in order, first): text i has the numbers first[i] to first[i + 1]."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.by_piece and len(texts):
            whole = np.zeros(len(texts), bool)
            for special in self.special:
                whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
            _, places, data = texts.buffers()
            places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
            offsets = places - places[0]
            cuts = pre_token_cuts(data, offsets)
            if whole.any():
                own = np.searchsorted(offsets, cuts, "right") - 1
                inside = (cuts > offsets[np.minimum(own, len(texts))]) & whole[np.minimum(own, len(texts) - 1)]
                cuts = cuts[~inside]
            entries = _strings(data, cuts)
            first = np.searchsorted(cuts, offsets)
        else:
            entries, first = texts, np.arange(len(texts) + 1)
        numbered = entries.dictionary_encode()
        return numbered.dictionary, numbered.indices.to_numpy(), first

    def lengths(self, entries: pa.Array, table: LengthTable | None) -> np.ndarray:
        """Token counts of distinct entries: table first, then cache, then tokenizer."""
        out = table.lengths(entries) if table else np.full(len(entries), -1, np.int64)
        missed = np.flatnonzero(out < 0)
        words = entries.take(pa.array(missed)).to_pylist()
        fresh = list(self.cache.unknown(set(words)))
        made = self.encode(fresh)
        self.cache.put(fresh, made)
        own = dict(zip(fresh, made, strict=True))
        out[missed] = [own[w] if w in own else self.cache[w] for w in words]
        return out

    def count(self, texts: pa.Array, table: LengthTable | None) -> np.ndarray:
        """Tokens of each text."""
        with no_cycle_search():
            entries, which, first = self.cut(texts)
            total = np.concatenate(([0], np.cumsum(self.lengths(entries, table)[which]))) if len(which) else np.zeros(1, np.int64)
        return total[first[1:]] - total[first[:-1]]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def shrink(counts: dict[str, int], size: int) -> dict[str, int]:
    """A summary of at most `size` entries: the count of the first that must go is subtracted from all (Misra and Gries)."""
    if len(counts) <= size:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(values, len(values) - size - 1)[len(values) - size - 1])
    return {w: n - least for w, n in counts.items() if n > least}


def frequent_entries(docs: DataFrame, vocabulary: str, scratch: Scratch, size: int = SUMMARY) -> dict[str, int]:
    """A summary of the pre-tokens of all texts, with counts that fall short by 1 / size of the corpus at most.

    The driver gets FAN_IN summaries at most; all others are merged on executors.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = counter(vocabulary).cut, {}
        for batch in (part for whole in batches for part in pieces(whole, whole.schema.names[0], SLICE_BYTES)):
            entries, which, _ = cut(batch.column(0))
            times = np.bincount(which, minlength=len(entries))
            short = pc.less_equal(pc.binary_length(entries), LONGEST).to_numpy(zero_copy_only=False)
            for w, n in zip(entries.filter(pa.array(short)).to_pylist(), times[short].tolist(), strict=True):
                counts[w] = counts.get(w, 0) + n
            if len(counts) > 4 * size:
                counts = shrink(counts, size)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shrink(counts, size))], pa.binary())], names=["summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for row in (row for batch in batches for row in batch.column(0)):
            for w, n in pickle.loads(row.as_py()).items():
                counts[w] = counts.get(w, 0) + n
            counts = shrink(counts, size)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(counts)], pa.binary())], names=["summary"])

    level = 0
    found = scratch.save(docs.select(F.col("text").cast("string")).mapInArrow(summarise, "summary binary"), "summaries-0")
    while (n := found.count()) > FAN_IN:
        level += 1
        found = scratch.save(found.coalesce(max(1, n // FAN_IN)).mapInArrow(merge, "summary binary"), f"summaries-{level}", FAN_IN)
        scratch.drop(f"summaries-{level - 1}")
    counts: dict[str, int] = {}
    for row in found.toLocalIterator():
        for w, n in pickle.loads(row[0]).items():
            counts[w] = counts.get(w, 0) + n
        counts = shrink(counts, size)
    scratch.drop(f"summaries-{level}")
    return counts


def frequent_lengths(docs: DataFrame, vocabulary: str, size: int = TABLE) -> LengthTable:
    """The table of the most frequent pre-tokens (ties by the string), for this corpus and any that resembles it."""
    counts = frequent_entries(docs, vocabulary, Scratch(docs.sparkSession, "tokens"), max(SUMMARY, size))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:size]
    return LengthTable(words, counter(vocabulary).encode(words))


def count_tokens(docs: DataFrame, vocabulary: str, table: LengthTable | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; one pass without an exchange.  `table`: of frequent_lengths, else made here."""
    table = frequent_lengths(docs, vocabulary) if table is None else table
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in (part for whole in batches for part in pieces(whole, whole.schema.names[1], SLICE_BYTES)):
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(own.count(batch.column(1), sent.value), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, COUNT_SCHEMA)
