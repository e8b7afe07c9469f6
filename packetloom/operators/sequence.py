"""Behaviour sequences: the last L feature vectors of a client, and training windows over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.operators.slices import running_total

LENGTH = 50
MAX_WINDOWS = 30

# Rows of a client that share one group, beyond the L-1 rows of overlap.
_CHUNK = 100_000


def vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def behaviour_sequences(
    df: DataFrame, key: str, columns: Sequence[str], length: int = LENGTH,
    order: Sequence[str] = ("timestamp", "frame_no"), chunk: int = _CHUNK,
) -> DataFrame:
    """``sequence`` (up to ``length`` vectors, oldest first) and ``is_ready`` for every row; rows without a key or time have none.

    Rows are numbered per key, cut into chunks, and the last L-1 rows of a chunk are copied into the
    next one; a busy key is many small groups.
    """
    size = max(chunk, length)
    numbered = running_total(df.withColumn("__vec", vector(columns)), [key], F.lit(1), "__rn", order)
    lost = F.col("__rn").isNull()
    spot = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    home = F.when(lost, spot).otherwise(F.floor((F.col("__rn") - 1) / F.lit(size)))
    last = F.when(lost, spot).otherwise(F.floor((F.col("__rn") + F.lit(length - 2)) / F.lit(size)))
    spread = numbered.withColumns({"__home": home, "__chunk": F.explode(F.sequence(home, last))})
    frame = Window.partitionBy(key, "__chunk").orderBy("__rn").rowsBetween(1 - length, 0)
    return (
        spread.withColumn("sequence", F.when(~lost, F.collect_list("__vec").over(frame)))
        .where(F.col("__chunk") == F.col("__home"))
        .withColumn("is_ready", F.when(F.size("sequence") == length, 1).otherwise(0))
        .select(*df.columns, "sequence", "is_ready")
    )


def training_windows(
    df: DataFrame, columns: Sequence[str], length: int = LENGTH,
    order: Sequence[str] = ("timestamp", "frame_no"),
) -> DataFrame:
    """``window_id, sequence``: evenly spaced slices of the time-ordered table, at most 30.

    With fewer than ``length`` rows the table is repeated end to end to fill each window. Rows without a time come first.
    """
    n = df.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "window_id long, sequence array<array<double>>")
    timed = df.withColumns({"__vec": vector(columns), "__time": F.coalesce(order[0], F.timestamp_micros(F.lit(-(1 << 60))))})
    indexed = running_total(timed, [], F.lit(1), "__rn", ["__time", *order[1:]])
    indexed = indexed.select((F.col("__rn") - 1).alias("i"), F.col("__vec").alias("vec"))
    if n >= length:
        stride = max(1, n // 10)
        windows = min(MAX_WINDOWS, (n - length) // stride + 1)
        starts = F.sequence(F.lit(0), F.lit(windows - 1))
        place = F.col("i") - F.col("window_id") * stride
        placed = (
            indexed.where(F.col("i") < (windows - 1) * stride + length)
            .withColumn("window_id", F.explode(starts)).withColumn("j", place)
            .where(F.col("j").between(0, length - 1))
        )
    else:
        windows = max(1, length // n + 1)
        placed = (
            indexed.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(length - 1).cast("long"), F.lit(n).cast("long"))))
            .withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
        )
    ordered = F.array_sort(F.collect_list(F.struct("j", "vec")))
    return placed.groupBy("window_id").agg(F.transform(ordered, lambda e: e["vec"]).alias("sequence"))
