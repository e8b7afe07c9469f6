"""One-class model: random Fourier features of an RBF kernel and a linear one-class objective.

An approximation by design: the kernel is sampled with ``components`` random waves, and the weights come from
full-batch gradient steps. The threshold is exact: the ``nu`` quantile of the training scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from packetloom.operators.quantiles import exact_quantiles


@dataclass
class OneClassModel:
    features: list[str]
    mean: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phases)) * np.cos((x - self.mean) @ self.waves + self.phases)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``svm_score`` (distance to the threshold) and ``label``: -1 outside, 1 inside."""
        model = self

        @F.arrow_udf("double")
        def value(*cols: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype(float)
            return pa.array(model.map(np.nan_to_num(x)) @ model.weights)

        scored = df.withColumn("svm_score", value(*[F.col(c).cast("double") for c in self.features]) - self.threshold)
        return scored.withColumn("label", F.when(F.col("svm_score") < 0, -1).otherwise(1))


def fit(
    df: DataFrame, features: Sequence[str], nu: float = 0.5, gamma: float | None = None, components: int = 128,
    epochs: int = 20, seed: int = 42,
) -> OneClassModel:
    """``gamma=None`` takes 1 / (features * variance of all values)."""
    features = list(features)
    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    stats = x.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.avg(F.col(c) * F.col(c)).alias(f"q_{c}") for c in features],
                  F.count(F.lit(1)).alias("n")).first()
    mean = np.array([stats[f"m_{c}"] for c in features])
    spread = np.mean([stats[f"q_{c}"] for c in features]) - mean.mean() ** 2
    gamma = gamma if gamma is not None else 1.0 / (len(features) * max(spread, 1e-12))
    rng = np.random.default_rng(seed)
    waves = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(features), components))
    phases = rng.uniform(0.0, 2.0 * np.pi, components)
    model = OneClassModel(features, mean, waves, phases, np.zeros(components))
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model.weights = _gradient(x, model, float("inf"))[0] / stats["n"]
        for epoch in range(1, epochs + 1):
            rho = _threshold(x, model, nu)
            pull, _ = _gradient(x, model, rho)
            step = 1.0 / (epoch + 1)
            model.weights = (1.0 - step) * model.weights + step * pull / (nu * stats["n"])
        model.threshold = _threshold(x, model, nu, exact=True)
    finally:
        x.unpersist()
    return model


def _gradient(x: DataFrame, model: OneClassModel, rho: float) -> tuple[np.ndarray, int]:
    """Sum of mapped rows below ``rho``: summed per task, then per component; only the sums reach the driver."""
    size = len(model.phases)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(size), 0
        for batch in batches:
            z = model.map(batch.to_numpy(dtype=float))
            below = z @ model.weights < rho
            total += z[below].sum(axis=0)
            rows += int(below.sum())
        yield pd.DataFrame({"i": np.arange(size + 1), "g": np.append(total, rows)})

    sums = x.mapInPandas(partial, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(size + 1)
    for row in sums:
        out[row["i"]] = row["g"]
    return out[:size], int(out[size])


def _threshold(x: DataFrame, model: OneClassModel, nu: float, exact: bool = False) -> float:
    scores = model.score(x).select((F.col("svm_score") + model.threshold).alias("s"))
    if exact:
        return exact_quantiles(scores, ["s"], [nu])["s"][0]
    return scores.agg(F.percentile_approx("s", F.lit(nu), 10_000).alias("s")).first()["s"]
