"""Sequence model: how badly a linear autoencoder rebuilds the last L vectors of a client.

Features are standardized, sequences are flattened, and the leading principal components are the code. This stands
in for a recurrent autoencoder; the score has the same meaning, the mean absolute reconstruction error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class SequenceModel:
    length: int
    mean: np.ndarray
    std: np.ndarray
    center: np.ndarray
    components: np.ndarray

    def score_column(self, sequence: str = "sequence") -> Column:
        """``seq_recon_mae``; NULL for sequences that are not ``length`` long."""
        full = F.size(sequence) == self.length
        return F.when(full, _scorer(self)(F.when(full, F.flatten(sequence))))

    def score(self, df: DataFrame, sequence: str = "sequence") -> DataFrame:
        return df.withColumn("seq_recon_mae", self.score_column(sequence))


def _scorer(model: SequenceModel):
    mean, std = np.tile(model.mean, model.length), np.tile(model.std, model.length)
    center, components = model.center, model.components

    @F.arrow_udf("double")
    def score(flat: pa.Array) -> pa.Array:
        rows = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(flat), np.nan)
        if len(rows):
            x = flat.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            z = (x - mean) / std - center
            out[rows] = np.abs(z - (z @ components) @ components.T).mean(axis=1)
        return pa.array(out, from_pandas=True)

    return score


def fit(sequences: DataFrame, length: int, encoding_dim: int = 32, sequence: str = "sequence") -> SequenceModel:
    """Fit on the full sequences of a table; scaling is per feature over all steps."""
    full = sequences.where(F.size(sequence) == length).select(F.col(sequence).alias("s"))
    first = full.first()
    if first is None:
        raise ValueError("no full sequence to train on")
    width = len(first["s"][0])
    steps = full.select(F.explode("s").alias("v"))
    stats = steps.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] for i in range(width)])
    std = np.array([stats[f"s{i}"] or 1.0 for i in range(width)])
    means, stds = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v)) for v in std])
    scaled = F.transform("s", lambda v: F.zip_with(F.zip_with(v, means, lambda a, m: a - m), stds, lambda a, s: a / s))
    vectors = full.select(array_to_vector(F.flatten(scaled)).alias("x"))
    k = min(encoding_dim, length * width)
    components = PCA(k=k, inputCol="x", outputCol="code").fit(vectors).pc.toArray()
    center = vectors.agg(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray()
    return SequenceModel(length, mean, std, center, components)
