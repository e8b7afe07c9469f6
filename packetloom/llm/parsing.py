"""Prefix-free parsing of texts as numpy over bytes: rolling-hash triggers cut a text into phrases that depend on its content only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from packetloom.llm import textbytes

#: Bytes under the rolling hash, and starts among which the smallest hash is a trigger.
ROLL = 16
REACH = 120
_STEPS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the ROLL bytes from each position on."""
    x = textbytes._BYTE[data]
    for k, step in enumerate(_STEPS):
        width = 1 << k
        x = x[:-width] * step + x[width:]
    return textbytes.mix(x)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, from minima of blocks' beginnings and ends."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger) of the runs of ``starts`` whose spans have the same trigger.

    The trigger of a span is the first of the smallest rolling hashes that begin in its first REACH bytes, so equal spans have their
    trigger at the same place. ``starts`` are ordered positions with ``span`` bytes after them.
    """
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    hashes = (rolling(data) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(data) - ROLL + 1, dtype=np.uint64)
    trigger = (_sliding_least(hashes, REACH)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], trigger[first]


def pieces(data: np.ndarray, offsets: np.ndarray, span: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position in ``data``, bytes, starts of whole spans within one text) in pieces of about ``limit`` starts.

    Short texts share a piece; a long one is cut into several, each with the bytes that its last span needs.
    """
    whole = offsets[-1] <= limit
    if whole:
        here = np.arange(max(0, offsets[-1] - span + 1))
        end = np.repeat(offsets[1:], np.diff(offsets))[: len(here)]
        yield 0, data, here[here + span <= end]
        return
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at in range(low, high - span + 1, limit):
            stop = min(at + limit + span - 1, high)
            yield at, data[at:stop], np.arange(stop - at - span + 1)
