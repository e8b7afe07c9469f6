"""Exact order statistics of whole columns without gathering a column in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from packetloom.session import settled

# Cells per range and pass.
CELLS = 4_096

# number of the column, lowest and highest value, values in the range
_Range = tuple[int, float, float, int]


def _ranks(n: int, q: float, method: str) -> tuple[int, int, float]:
    """Lower rank, upper rank (0-based) and the weight of the upper one."""
    at = (n - 1) * q
    low = min(int(math.floor(at + 1e-12)), n - 1)
    if method == "lower":
        return low, low, 0.0
    high = min(low + 1, n - 1)
    return low, high, max(at - low, 0.0)


def _between(low: float, high: float, weight: float) -> float:
    if low == high or weight <= 0.0 or math.isinf(low):
        return low
    return low + (high - low) * weight


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str | Sequence[str] = "linear", small: int = CELLS,
) -> dict[str, list[float | None]]:
    """Quantiles per column, NULL and NaN left out; None for an empty column. ``method`` may name one way per quantile.

    There is one way for tables of any size. The columns are written once, as rows of (column, value). Each wanted rank lies in a range of values; a pass cuts
    every range into at most ``small`` cells (or, when it holds no more values than that, into its distinct values), and the cell of a
    rank is the next range. Cells are counted by partial aggregation and ranked on the executors; a pass returns one row per wanted
    rank. Infinite values are counted apart and take part like any others.
    """
    if not columns:
        return {}
    methods = [method] * len(probs) if isinstance(method, str) else list(method)
    entries = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.explode(entries).alias("e")).select("e.c", "e.v")
    values = settled(long.where(F.col("v").isNotNull() & ~F.isnan("v")))
    inf = F.lit(float("inf"))
    finite = F.when(F.abs("v") < inf, F.col("v"))
    about = {r["c"]: r for r in values.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == -inf).alias("below"), F.count_if(F.col("v") == inf).alias("above"),
        F.min(finite).alias("low"), F.max(finite).alias("high"),
    ).collect()}
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    found: dict[tuple[int, int], float] = {}
    ranges: dict[_Range, list[tuple[int, int]]] = {}
    for i in range(len(columns)):
        wanted[i] = [_ranks(about[i]["n"], q, m) for q, m in zip(probs, methods, strict=True)] if i in about else []
        for rank in sorted({r for low, high, _ in wanted[i] for r in (low, high)}):
            n, below, above = about[i]["n"], about[i]["below"], about[i]["above"]
            if rank < below:
                found[i, rank] = -math.inf
            elif rank >= n - above:
                found[i, rank] = math.inf
            else:
                ranges.setdefault((i, about[i]["low"], about[i]["high"], n - below - above), []).append((rank, rank - below))
    _narrow(values, ranges, found, small)
    return {c: [_between(found[i, low], found[i, high], w) for low, high, w in wanted[i]] or [None] * len(probs) for i, c in enumerate(columns)}


_RANGES = "t int, c int, low double, high double, n bigint, ranks array<bigint>"


def _narrow(values: DataFrame, ranges: dict[_Range, list[tuple[int, int]]], found: dict[tuple[int, int], float], small: int) -> None:
    """Adds the value at each rank to ``found``; ``ranges`` maps a range to (rank in the column, rank in the range)."""
    spark = values.sparkSession
    while True:
        for (c, low, high, n) in [r for r in ranges if not r[1] < r[2]]:
            found.update({(c, rank): low for rank, _ in ranges.pop((c, low, high, n))})
        if not ranges:
            return
        order = list(ranges)
        # One row per range: no more than there are wanted ranks.
        table = F.broadcast(spark.createDataFrame([(t, *r, [k for _, k in ranges[r]]) for t, r in enumerate(order)], _RANGES))
        # Halves, as the width of a range may be too large for a number.
        step = (F.col("high") / 2 - F.col("low") / 2) / small
        cell = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / step), F.lit(small - 1)).cast("double")
        cell = F.when(F.col("n") <= small, F.col("v")).when(step == 0, F.when(F.col("v") > F.col("low"), 1.0).otherwise(0.0)).otherwise(cell)
        met = values.join(table.drop("ranks"), "c").where(F.col("v").between(F.col("low"), F.col("high")))
        counted = met.groupBy("t", cell.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # At most ``small`` rows per range from here on.
        upto = F.sum("n").over(Window.partitionBy("t").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hits = counted.withColumn("upto", upto).join(table.select("t", "ranks"), "t").withColumn("before", F.col("upto") - F.col("n"))
        inside = F.filter("ranks", lambda k: (k >= F.col("before")) & (k < F.col("upto")))
        after: dict[_Range, list[tuple[int, int]]] = {}
        for row in hits.withColumn("ranks", inside).where(F.size("ranks") > 0).select("t", "low", "high", "n", "before", "ranks").collect():
            place = order[row["t"]]
            names = {k: rank for rank, k in ranges[place]}
            after[place[0], row["low"], row["high"], row["n"]] = [(names[k], k - row["before"]) for k in row["ranks"]]
        ranges = after
