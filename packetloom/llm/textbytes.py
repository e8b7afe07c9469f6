"""Words and hashes of whole Arrow text columns, as numpy over their UTF-8 bytes.

Texts are handled in slices of a bounded number of bytes (one text at least), so memory does not grow with a batch. The word
classes used here never split a character: bytes from 0x80 up are always word bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes lower-cased in A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: anything but space and 0x09-0x0D.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False
#: Words of digits, letters a-z and bytes from 0x80 up (after lower-casing).
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


#: Bytes that a task sends to its Python worker at a time, but for a single longer row.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session send small batches to Python: the default is 64 MB, held several times by each task of an executor."""
    if spark.conf.get(_SETTING) != f"{BATCH_BYTES}b":
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")


def _give_back() -> None:
    """Returns freed memory to the machine, as several workers share an executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts with at most ``limit`` bytes, or of one longer text. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop
    del column, at, data
    _give_back()


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more entry than texts). A word ends with its text."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order of their starts). Needs room for one run of spans, not for all bytes."""
    out = np.empty(len(starts), np.uint64)
    tint = _BYTE if not seed else mix(_BYTE + np.uint64(seed)) | np.uint64(1)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        low, high = int(starts[i]), int(ends[i:j].max())
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(tint[data[low:high]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in each text, or of the whole text if it has fewer words but not none; bounds by text.

    The hash of a short text differs from that of any longer run, as the number of words goes in.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    at = first[text] + np.arange(bounds[-1]) - bounds[text]
    total = np.zeros(len(at), np.uint64)
    used = np.minimum(count, n)[text]
    for k in range(n):
        step = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        if len(words):
            total += np.where(k < used, words[np.minimum(at + k, len(words) - 1)] * step, np.uint64(0))
    return mix(total + used.astype(np.uint64)), bounds
