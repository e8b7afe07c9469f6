"""Isolation forest: samples drawn by hash, one tree per group, scored with the node table in hand."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.operators.clean import align_features
from packetloom.operators.compare import score_metrics
from packetloom.operators.quantiles import exact_quantiles
from packetloom.session import settled

TREES, SAMPLES, SEED = 100, 256, 42
# One task grows one tree from its sample, so the sample size is bounded.
MAX_SAMPLES = 1_000_000

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
_EULER = 0.5772156649015329


def average_path(n: np.ndarray | int) -> np.ndarray:
    """c(n): expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + _EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def draw_samples(
    df: DataFrame, features: Sequence[str], row_key: Sequence[str], n: int, trees: int, size: int, seed: int,
    tree_rate: float | None = None,
) -> DataFrame:
    """``tree, r, x``: for every tree the ``size`` rows with the smallest hash of (row, tree), whatever the size of the table.

    A threshold on that hash keeps about four times what a tree needs, so neither the explode nor the ranking grows with the
    table. It does not change which rows are the smallest; ``fit`` lifts it should a tree get too few.
    """
    rate = min(1.0, 4.0 * size / n) if tree_rate is None else tree_rate

    def share(hash_value: Column, p: float) -> Column:
        return F.lit(True) if p >= 1.0 else hash_value < F.lit(int(-(2**63) + p * 2**64))

    def draw(tree: Column) -> Column:
        return F.xxhash64(*row_key, tree, F.lit(seed))

    rows = df.select(*row_key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # One plain hash per tree stays in generated code.
    chosen = F.array_compact(F.array(*[F.when(share(draw(F.lit(t)), rate), F.lit(t)) for t in range(trees)]))
    candidates = rows.withColumn("tree", F.explode(chosen)).withColumn("draw", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *row_key))
    return candidates.withColumn("r", rank).where(F.col("r") <= size).select("tree", "r", "x")


def _grower(seed: int, size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        tree = int(rows["tree"].iloc[0])
        x = np.stack(rows["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, None, "")]
        while todo:
            members, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent][4 if side == "left" else 5] = at
            sub = x[members]
            low, high = sub.min(axis=0), sub.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or not len(splittable):
                nodes.append([tree, at, -1, 0.0, -1, -1, len(members), depth])
                continue
            feature = int(rng.choice(splittable))
            threshold = float(rng.uniform(low[feature], high[feature]))
            if threshold >= high[feature]:
                threshold = float(low[feature])
            nodes.append([tree, at, feature, threshold, -1, -1, len(members), depth])
            goes_left = sub[:, feature] <= threshold
            todo.append((members[~goes_left], depth + 1, at, "right"))
            todo.append((members[goes_left], depth + 1, at, "left"))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])

    return grow


@dataclass
class IsolationForest:
    """A fitted forest. ``nodes`` has at most ``trees * (2 * samples - 1)`` rows."""

    features: list[str]
    nodes: pd.DataFrame
    samples: int
    offset: float = -0.5
    params: dict = field(default_factory=dict)

    def score_column(self) -> Column:
        """``score_samples``: -2^(-E[h]/c); lower is more anomalous."""
        return _scorer(self)(*[F.col(c).cast("double") for c in self.features])

    def score(self, df: DataFrame, on_missing: str = "zero") -> DataFrame:
        """Add ``anomaly_score``, ``decision`` (score minus offset) and ``score`` (0.5 minus decision)."""
        originals = {c: F.col(c) for c in self.features if c in df.columns}
        aligned = align_features(df.withColumns({f"__{c}": v for c, v in originals.items()}), self.features, on_missing)
        scored = aligned.withColumn("anomaly_score", self.score_column())
        kept = [F.col(f"__{c}").alias(c) if c in originals else F.col(c) for c in df.columns]
        return scored.select(*kept, "anomaly_score").withColumn("decision", F.col("anomaly_score") - self.offset).withColumn(
            "score", 0.5 - F.col("decision")
        )

    def importances(self, spark: SparkSession) -> DataFrame:
        """Share of the splits per feature; equal shares when nothing was split."""
        return feature_importances(spark.createDataFrame(self.nodes, NODES), self.features)

    def save(self, spark: SparkSession, path: str, metrics: DataFrame | None = None) -> None:
        """Nodes and importances as parquet, description and metrics as JSON, all below ``path``."""
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"features": self.features, "samples": self.samples, "offset": self.offset, "params": self.params})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        self.importances(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/importances")
        if metrics is not None:
            metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        return cls(about["features"], nodes, about["samples"], about["offset"], about["params"])


def _scorer(model: IsolationForest):
    nodes = model.nodes.sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.groupby("tree", sort=True).size().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.repeat(starts, sizes)
    feature = nodes["feature"].to_numpy()
    leaf = feature < 0
    # Leaves point to themselves, so a fixed number of steps brings every row to its leaf.
    here = np.arange(len(nodes))
    left = np.where(leaf, here, base + nodes["left"].to_numpy()).astype(np.int32)
    right = np.where(leaf, here, base + nodes["right"].to_numpy()).astype(np.int32)
    column = np.where(leaf, 0, feature).astype(np.int32)
    threshold = nodes["threshold"].to_numpy()
    path = nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy())
    depth = int(nodes["depth"].max()) if len(nodes) else 0
    roots = starts.astype(np.int32)
    scale = max(float(average_path(model.samples)), 1e-12)

    @F.arrow_udf("double")
    def score(*cols: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype(float)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        for _ in range(depth):
            at = np.where(x[rows, column[at]] <= threshold[at], left[at], right[at])
        return pa.array(-np.exp2(-path[at].mean(axis=1) / scale))

    return score


def fit(
    df: DataFrame, features: Sequence[str], row_key: Sequence[str], trees: int = TREES, max_samples: int | float = SAMPLES,
    contamination: float | str = "auto", seed: int = SEED,
) -> IsolationForest:
    """Grow a forest on clean numeric features.

    ``row_key`` names a row for good, so the same seed gives the same forest under any partitioning.
    ``contamination='auto'`` keeps the offset at -0.5; a share sets it to that quantile of the training scores.
    """
    features = list(features)
    n = df.count()
    if n == 0:
        raise ValueError("no rows to train on")
    size = min(n, max_samples if isinstance(max_samples, int) else max(1, int(max_samples * n)))
    if size > MAX_SAMPLES:
        raise ValueError(f"{size} rows per tree; at most {MAX_SAMPLES} fit one task")
    nodes = _grow(df, features, row_key, n, trees, size, seed, None)
    if (nodes.loc[nodes["node"] == 0, "size"] < size).any() or nodes["tree"].nunique() < trees:
        nodes = _grow(df, features, row_key, n, trees, size, seed, 1.0)
    params = {"n_estimators": trees, "max_samples": max_samples, "contamination": contamination, "random_state": seed}
    model = IsolationForest(features, nodes, size, -0.5, params)
    if contamination != "auto":
        # Written once: the quantile may take several passes.
        scores = settled(df.select(model.score_column().alias("s")))
        model.offset = exact_quantiles(scores, ["s"], [float(contamination)])["s"][0]
    return model


def _grow(df, features, row_key, n, trees, size, seed, rate) -> pd.DataFrame:
    samples = draw_samples(df, features, row_key, n, trees, size, seed, rate)
    nodes = samples.groupBy("tree").applyInPandas(_grower(seed, size), NODES)
    return nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)


def training_metrics(model: IsolationForest, df: DataFrame, contamination: float = 0.1) -> DataFrame:
    scores = settled(df.select(model.score_column().alias("score")))
    return score_metrics(scores, contamination).withColumns({
        "n_features": F.lit(len(model.features)), "model_parameters": F.lit(json.dumps(model.params)),
    })


def feature_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, importance`` from a node table."""
    names = F.array(*[F.lit(f) for f in features])
    counts = nodes.where(F.col("feature") >= 0).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    every = nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
    # One row per feature from here on.
    filled = every.join(counts, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.when(total > 0, F.col("n") / total).otherwise(1.0 / len(features))
    return filled.select(F.get(names, F.col("feature")).alias("feature"), share.alias("importance"))


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
