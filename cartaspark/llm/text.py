"""Vectorised work on the bytes of Arrow text columns: words, their hashes and shingles.

Hashes have 64 bits.  All constants follow from one seed by the SplitMix64 rule.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is neither a letter nor a digit; bytes of longer code points are kept.
ASCII_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes hashed at once; work arrays take about forty times as much.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd random uint64 values."""
    with np.errstate(over="ignore"):
        at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix(at) | np.uint64(1)


CODES = constants(256, 11)[LOWER]
BASE = int(constants(1, 12)[0])
PLACES = constants(64, 13)
LENGTH = constants(1, 14)[0]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1024)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray, space: np.ndarray):
    """Byte ranges of about SLICE bytes that end where a text ends or, inside a long one, before white space."""
    lo, end = 0, len(data)
    while lo < end:
        hi = offsets[np.searchsorted(offsets, lo + SLICE, "right") - 1]
        if hi <= lo:  # a text longer than a slice
            stop = offsets[np.searchsorted(offsets, lo, "right")]
            at = lo + SLICE
            hi = stop
            while at < stop:
                found = np.flatnonzero(space[data[at : min(stop, at + SLICE)]])
                if len(found):
                    hi = at + found[0]
                    break
                at += SLICE
        yield int(lo), int(hi)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z lower-cased: (hashes, starts, ends, first).

    Text i has the words first[i] to first[i + 1]; starts and ends are byte places in data.
    """
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for lo, hi in _slices(data, offsets, space):
            part = data[lo:hi]
            gap = space[part]
            cut = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
            before, after = np.ones(len(part), bool), np.ones(len(part), bool)
            before[1:], after[:-1] = gap[:-1], gap[1:]
            before[cut[cut < len(part)]] = True
            after[cut[cut > 0] - 1] = True
            start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
            up, down = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(CODES[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * LENGTH))
            starts.append(start + lo)
            ends.append(end + lo)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    with np.errstate(over="ignore"):
        n = len(hashes) - k + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            whole += hashes[j : j + n] * PLACES[j]
        whole = mix(whole)
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                own = np.sort(whole[lo : hi - k + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif hi > lo:
                short = (hashes[lo:hi] * PLACES[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo) * LENGTH
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """Cut a record batch into runs of rows with about `size` bytes of text, so that work arrays stay small."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()
