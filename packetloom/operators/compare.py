"""Comparing scores, runs and feature lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.operators.quantiles import exact_quantiles


def score_threshold(scores: DataFrame, contamination: float, column: str = "score") -> float | None:
    """The score at the contamination share, counted from the lowest; an observed value, not interpolated."""
    return exact_quantiles(scores, [column], [contamination], method="lower")[column][0]


def label_by_threshold(column: str, threshold: float) -> Column:
    """-1 at or below the threshold, else 1."""
    return F.when(F.col(column) <= threshold, -1).otherwise(1)


def score_metrics(scores: DataFrame, contamination: float = 0.1, column: str = "score") -> DataFrame:
    """One row: threshold, anomalies and the distribution of training scores."""
    probs, methods = [contamination, 0.25, 0.5, 0.75], ["lower", *["linear"] * 3]
    threshold, *quartiles = exact_quantiles(scores, [column], probs, methods)[column]
    hits = F.count_if(F.col(column) <= F.lit(threshold))
    return scores.agg(
        F.count(F.lit(1)).alias("n_samples"), F.lit(contamination).alias("contamination"), F.lit(threshold).alias("threshold"),
        hits.alias("num_anomalies"), F.try_divide(hits, F.count(F.lit(1))).alias("estimated_contamination"),
        F.avg(column).alias("anomaly_score_mean"), F.stddev_pop(column).alias("anomaly_score_std"),
        F.min(column).alias("anomaly_score_min"), F.max(column).alias("anomaly_score_max"),
        F.lit(quartiles[0]).alias("anomaly_score_p25"), F.lit(quartiles[1]).alias("anomaly_score_median"),
        F.lit(quartiles[2]).alias("anomaly_score_p75"), (F.max(column) - F.min(column)).alias("anomaly_score_range"),
    )


def normalized_score(decision: Column) -> Column:
    """0.5 minus the decision value: higher is more anomalous."""
    return F.lit(0.5) - decision


def name_difference(have: DataFrame, expected: DataFrame) -> DataFrame:
    """``feature, side``: names only the model has, and names only expected."""
    only = lambda a, b, side: a.exceptAll(b).select(F.col("feature"), F.lit(side).alias("side"))
    return only(have, expected, "unexpected").union(only(expected, have, "missing"))


def drift(old: DataFrame, new: DataFrame, low: float, high: float, bins: int = 10, column: str = "score") -> DataFrame:
    """Shares per score bin of two runs and the bin's part of the population stability index."""
    cell = F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    both = old.select(cell.alias("bin"), F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(cell.alias("bin"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    counts = both.groupBy("bin").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    # At most ``bins`` rows are left here.
    totals = counts.agg(F.sum("o").alias("to"), F.sum("n").alias("tn")).first()
    share_old = F.greatest(F.col("o") / float(totals["to"] or 1), F.lit(1e-6))
    share_new = F.greatest(F.col("n") / float(totals["tn"] or 1), F.lit(1e-6))
    return counts.select("bin", share_old.alias("old_share"), share_new.alias("new_share")).withColumn(
        "psi", (F.col("new_share") - F.col("old_share")) * F.log(F.col("new_share") / F.col("old_share"))
    )


def needs_retraining(drifted: DataFrame, limit: float = 0.1) -> bool:
    return (drifted.agg(F.sum("psi").alias("psi")).first()["psi"] or 0.0) > limit
