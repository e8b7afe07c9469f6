"""Groups of rows in bounded pieces: a large group is cut into chunks, and each pair of chunks is a group of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.session import settled

#: Rows of a chunk, about. A task holds two chunks at a time.
CHUNK = 1024


def paired_chunks(df: DataFrame, keys: list[str], row: str, chunk: int = CHUNK, apart: str | None = None) -> DataFrame:
    """``df`` with ``left``, ``right`` and ``side``, so that any two rows of a group meet in exactly one (keys, left, right).

    A group of at most ``chunk`` rows is left whole: (0, 0). A larger one is cut by the hash of ``row``, and each row goes to every pair
    of its chunk with another, and to its chunk alone. Rows of a pair of two chunks are to be compared only where ``side`` differs.
    With ``apart``, rows of a large group that agree in that column need not meet: those of its most frequent value get chunks of their own
    that meet only the chunks of the others, so a group where few rows differ from the rest is copied in proportion to its size.
    """
    if apart is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.lit(0).cast("bigint").alias("_m"), F.lit(None).cast("bigint").alias("_major"))
    else:
        sizes = df.groupBy(*keys, apart).agg(F.count("*").alias("_n")).groupBy(*keys).agg(
            F.sum("_n").alias("_n"), F.max("_n").alias("_m"), F.max_by(apart, F.struct("_n", apart)).alias("_major")
        )
    cut = lambda n: F.ceil(n / chunk).cast("int")
    large = settled(sizes.where(F.col("_n") > chunk).select(*keys, "_major", cut(F.col("_m")).alias("_first"), cut(F.col("_n") - F.col("_m")).alias("_others")))
    marked = df.join(large, keys, "left").na.fill({"_first": 0, "_others": 1})
    # Chunks of the most frequent value come first: 0 to _first - 1; those of the others follow.
    major = F.lit(False) if apart is None else F.coalesce(F.col(apart) == F.col("_major"), F.lit(False))
    number = F.when(major, F.pmod(F.xxhash64(row), F.col("_first"))).otherwise(F.col("_first") + F.pmod(F.xxhash64(row), F.greatest("_others", F.lit(1))))
    chunks = F.col("_first") + F.col("_others")
    start = F.when(major, F.col("_first")).otherwise(0)
    marked = marked.withColumn("side", number.cast("int"))
    met = F.explode(F.when(start < chunks, F.sequence(start, chunks - 1)).otherwise(F.array().cast("array<int>"))).alias("_other")
    return marked.select("*", met).select(
        *[F.col(f"`{c}`") for c in df.columns], "side", F.least("side", "_other").alias("left"), F.greatest("side", "_other").alias("right")
    )


def together(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of equal keys one after another within one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, bounds of its groups) of rows that come ordered by non-null integer ``keys``; a group is never cut. Tables have about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            table = table.slice(bounds[-2])
        held, count = table.to_batches(), table.num_rows
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def fixed_width(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A matrix from a binary column whose values all have ``width`` items of ``dtype``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(dtype).reshape(len(column), width)


def pairs_within(bounds: np.ndarray, ends: np.ndarray | None = None, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs within each group, or with j below ``ends[i]``; in portions of about ``limit`` pairs."""
    n = int(bounds[-1])
    stop = np.repeat(bounds[1:], np.diff(bounds)) if ends is None else ends
    here = np.arange(n)
    count = np.maximum(stop - here - 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        some = count[i:j]
        left = np.repeat(here[i:j], some)
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], some)
        i = j
