"""Cleaning of feature tables: types, missing values, outliers, constants, reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from packetloom.operators.quantiles import exact_quantiles

log = logging.getLogger("packetloom")

CLIP_SUFFIXES = ("_per_sec", "_rate")
CLIP_QUANTILE = 0.99


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def prepare_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Parse text and epoch seconds to a timestamp, bad text to NULL. Order is left to the operators that need it."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    if isinstance(kind, T.NumericType):
        return df.withColumn(column, F.timestamp_micros((F.col(column) * 1_000_000).cast("long")))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


def finite(df: DataFrame, column: str) -> Column:
    """The column with NaN and infinities as NULL."""
    c = F.col(column)
    if not _is_float(df, column):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_only(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: finite(df, c) for c in columns or numeric_columns(df) if _is_float(df, c)})


def fill_zero(df: DataFrame) -> DataFrame:
    """Infinities and missing numbers become 0."""
    numbers = numeric_columns(df)
    return finite_only(df, numbers).na.fill(0, subset=numbers)


def clip_outliers(df: DataFrame, quantile: float = CLIP_QUANTILE, suffixes: Sequence[str] = CLIP_SUFFIXES) -> DataFrame:
    """Cap rate columns at their quantile."""
    rates = [c for c in numeric_columns(df) if c.endswith(tuple(suffixes))]
    if not rates:
        return df
    caps = exact_quantiles(df, rates, [quantile])
    return df.withColumns({c: F.least(F.col(c), F.lit(caps[c][0])) for c in rates if caps[c][0] is not None})


def clean_features(df: DataFrame, quantile: float = CLIP_QUANTILE) -> DataFrame:
    return clip_outliers(fill_zero(df), quantile)


def _impute(df: DataFrame, zero_names) -> DataFrame:
    """NULL to 0 where the name says so, else to the column's median (0 when it has none)."""
    numbers = numeric_columns(df)
    medians = exact_quantiles(df, [c for c in numbers if not zero_names(c)], [0.5])
    fills = {c: F.lit(0.0 if zero_names(c) or medians[c][0] is None else medians[c][0]) for c in numbers}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fill) for c, fill in fills.items()})


def impute_counts_or_median(df: DataFrame) -> DataFrame:
    """Training rule of the trainer with metrics: infinities are missing; counts and flags to 0, others to the median."""
    return _impute(finite_only(df), lambda c: "count" in c.lower() or "flag" in c.lower())


def impute_tcp_or_median(df: DataFrame) -> DataFrame:
    """Training rule of the model manager: ``tcp_*`` to 0, others to the median."""
    return _impute(df, lambda c: c.startswith("tcp_"))


def constant_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose sample deviation is 0."""
    numbers = numeric_columns(df)
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if row[c] == 0]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def align_features(df: DataFrame, features: Sequence[str], on_missing: str = "zero") -> DataFrame:
    """The model's columns ready for scoring, beside all others: NULL and infinite to 0, absent ones to 0 or an error."""
    missing = [c for c in features if c not in df.columns]
    if missing and on_missing == "error":
        raise ValueError(f"missing features: {missing}")
    if missing:
        log.warning("missing features set to 0: %s", missing)
    columns = {c: F.lit(0.0) if c in missing else F.coalesce(finite(df, c).cast("double"), F.lit(0.0)) for c in features}
    return df.withColumns(columns)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, missing, missing_pct`` for every column, from one pass."""
    names = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in names])
    return counts.select("__n", F.explode(cells).alias("e")).select(
        "e.column_name", "e.missing", (F.try_divide("e.missing", "__n") * 100.0).alias("missing_pct")
    )


def infinite_count(df: DataFrame) -> int:
    floats = [c for c in numeric_columns(df) if _is_float(df, c)]
    if not floats:
        return 0
    total = sum((F.count_if(F.abs(c) == float("inf")) for c in floats[1:]), F.count_if(F.abs(floats[0]) == float("inf")))
    return df.agg(total.alias("n")).first()["n"]


def cleaning_report(df: DataFrame) -> DataFrame:
    """``metric, value``: what the training clean-up changes, as one small table."""
    numbers = numeric_only(df)
    inf = infinite_count(numbers)
    before = missing_profile(finite_only(numbers)).agg(F.sum("missing").alias("n")).first()["n"] or 0
    filled = impute_counts_or_median(numbers)
    removed = constant_columns(filled)
    kept = filled.drop(*removed)
    after = missing_profile(kept).agg(F.sum("missing").alias("n")).first()["n"] or 0
    rows = df.count()
    metrics = [
        ("rows_before", str(rows)), ("columns_before", str(len(numbers.columns))), ("rows_after", str(rows)),
        ("columns_after", str(len(kept.columns))), ("removed_columns", ",".join(removed)),
        ("kept_columns", ",".join(kept.columns)), ("infinite_values", str(inf)),
        ("missing_before", str(before - inf)), ("missing_after", str(after)),
    ]
    return df.sparkSession.createDataFrame(metrics, "metric string, value string")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum; one row per column."""
    names = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), *[F.lit(quartiles[c][i]).cast("double").alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
            F.max(c).cast("double").alias("max"),
        ).alias(c) for c in names
    ])
    return stats.select(F.explode(F.array(*[F.col(f"`{c}`") for c in names])).alias("e")).select("e.*")


def feature_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])
    return row.select(F.explode(cells).alias("e")).select("e.*")


def feature_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, correlation`` for every pair of feature columns, all in one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("e")).select("e.*")


def select_features(
    df: DataFrame, columns: Sequence[str], variance: float = 0.01, correlation: float = 0.95,
) -> list[str]:
    """Columns that vary enough and repeat no earlier kept column."""
    spread = {r["feature"]: r["variance"] for r in feature_variances(df, columns).collect()}
    kept = [c for c in columns if (spread[c] or 0.0) > variance]
    if len(kept) < 2:
        return kept
    close = {(r["a"], r["b"]) for r in feature_correlations(df, kept).collect() if abs(r["correlation"] or 0.0) > correlation}
    out: list[str] = []
    for c in kept:
        if not any((k, c) in close for k in out):
            out.append(c)
    return out
