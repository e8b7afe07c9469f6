"""Shannon entropy (bits) of text, of hex payloads and of value counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Bytes that count as printable: 0x20-0x7e and 0x09-0x0d (fixed values).
_PRINTABLE = np.array([0x20 <= b <= 0x7E or 0x09 <= b <= 0x0D for b in range(256)])

_NIBBLE = np.full(256, 255, dtype=np.uint8)
for _chars in ("0123456789abcdef", "0123456789ABCDEF"):
    for _value, _char in enumerate(_chars):
        _NIBBLE[ord(_char)] = _value


def char_entropy(text: Column) -> Column:
    """Entropy over the characters of ``text``; NULL and '' give 0.

    Counts a character by how much shorter the text gets without it, so the work stays in the JVM's
    native string code: one scan per distinct character. Meant for names, URIs and queries.
    """
    s = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(s).cast("double")

    def weight(acc: Column, ch: Column) -> Column:
        c = n - F.length(F.replace(s, ch, F.lit("")))
        return acc + c * F.log2(c)

    total = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), weight)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - total / n)).otherwise(0.0)


def count_entropy(count: Column) -> Column:
    """Aggregate: entropy of a value distribution, given one row per value with its count."""
    total = F.sum(count)
    return F.coalesce(
        F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - F.sum(count * F.log2(count)) / total)), F.lit(0.0)
    )


def hex_byte_counts(batch: pa.Array) -> np.ndarray:
    """Byte histogram (rows x 256) of a batch of hex strings; rows that are not clean hex stay all zero."""
    batch = pc.fill_null(batch.cast(pa.large_string()), "")
    rows = len(batch)
    offsets = np.frombuffer(batch.buffers()[1], dtype=np.int64)[batch.offset : batch.offset + rows + 1]
    data = batch.buffers()[2]
    if rows == 0 or data is None or offsets[0] == offsets[-1]:
        return np.zeros((rows, 256), dtype=np.int64)
    nibbles = _NIBBLE[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]]
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), lengths)
    clean = (lengths % 2 == 0) & (np.bincount(row_of, weights=nibbles == 255, minlength=rows) == 0)
    keep = clean[row_of]
    nibbles, row_of = nibbles[keep], row_of[keep]
    values = nibbles[0::2].astype(np.int64) * 16 + nibbles[1::2]
    return np.bincount(row_of[0::2] * 256 + values, minlength=rows * 256).reshape(rows, 256)


_STATS = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("printable", T.DoubleType())])


@F.arrow_udf(_STATS)
def hex_payload_stats(batch: pa.Array) -> pa.Array:
    """Entropy over bytes and share of printable bytes; a whole Arrow batch at once."""
    counts = hex_byte_counts(batch)
    total = np.maximum(counts.sum(axis=1), 1)
    logs = np.log2(np.maximum(counts, 1))
    entropy = np.maximum(np.log2(total) - (counts * logs).sum(axis=1) / total, 0.0)
    printable = counts[:, _PRINTABLE].sum(axis=1) / total
    return pa.StructArray.from_arrays([pa.array(entropy), pa.array(printable)], ["entropy", "printable"])
