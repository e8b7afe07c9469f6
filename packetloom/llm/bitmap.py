"""A bitmap of hashes of fixed size, for sparing rows that cannot join. It never decides anything by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: 2**24 bits are 2 MB, whatever the data. A fuller bitmap spares fewer rows.
BITS = 24


def bitmap(hashes: DataFrame, column: str = "hash") -> np.ndarray:
    """Packed bits of all values of a column of 64-bit hashes; at most 2**BITS bits reach the driver, as words of 64 in one job."""
    spot = F.shiftrightunsigned(F.col(column), 64 - BITS)
    words = hashes.select(F.shiftright(spot, 6).cast("int").alias("word"), spot.bitwiseAND(63).cast("int").alias("bit")).where("word IS NOT NULL")
    rows = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, 63 - bit))").alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 64, ">u8")
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    spot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
