"""Distinct counts that add up: one sketch per key and small window, merged into windows of any width, key or time later.

The rows are read once. A sketch has a bounded size (some ``2 ** precision`` bytes), so a busy key is as small as a quiet one from there on,
and a year of one-minute sketches can be asked for hours, days or the whole year without going back to the packets. Both
steps work on a stream too: sketches of closed windows are appended, and merged by the same function afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from packetloom.functions.timing import floor_us, width_us

#: Registers of a sketch, as a power of two. The relative deviation of an estimate is about 1.04 / sqrt(2 ** precision).
PRECISION = 12


def deviation(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], window: str, ts: str = "timestamp", precision: int = PRECISION) -> DataFrame:
    """(keys, time_window, <column>_sketch…) per key and tumbling window; NULL values are not counted, nor rows without a key or time."""
    present = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, ts]))
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(f"{c}_sketch") for c in columns]
    return present.groupBy(*keys, F.window(ts, window).alias("__w")).agg(*sketches).select(*keys, F.col("__w.start").alias("time_window"), *[f"{c}_sketch" for c in columns])


def merged_sketches(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], widths: Mapping[str, str | int]) -> DataFrame:
    """(keys, width, time_window, <column>_distinct…) for every named width, in one pass over the sketches.

    Widths are multiples of the window of the sketches. Keys may be fewer than those of the sketches: what is left out is merged too.
    """
    start = F.unix_micros("time_window")
    slots = [F.struct(F.lit(name).alias("width"), F.timestamp_micros(floor_us(start, width_us(w))).alias("time_window")) for name, w in widths.items()]
    spread = sketches.select(*keys, *[f"{c}_sketch" for c in columns], F.explode(F.array(*slots)).alias("__slot"))
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_distinct") for c in columns]
    return spread.groupBy(*keys, F.col("__slot.width").alias("width"), F.col("__slot.time_window").alias("time_window")).agg(*merged)
