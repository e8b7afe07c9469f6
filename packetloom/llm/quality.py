"""Quality scores from a factorisation machine.

Features of a document: its words, hashed; statistics of its structure; numeric metadata. The machine adds to the linear part the
low-rank interactions of all pairs of features, ``sum over i<j of <v_i, v_j> x_i x_j``, and scores them in time linear in the number
of features: ``1/2 sum over f of ((sum over i of v_if x_i)^2 - sum over i of (v_if x_i)^2)``.

It is fitted on a bounded sample of labelled rows (``SAMPLE``, those with the smallest hash of their key), in one task that gets only
features of the sample. Every document is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from packetloom.llm import textbytes
from packetloom.session import settled

#: Labelled rows the machine is fitted on, at most.
SAMPLE = 6_000
BUCKETS = 1 << 14
RANK = 8
BATCH = 128
#: Passes over the sample, and steps at least: a small sample is passed more often.
EPOCHS = 12
STEPS = 560
RATE = 0.05
PENALTY = 1e-5
#: Scores from here on predict label 1.
THRESHOLD = 0.3

_STATS = (
    "bytes", "words", "lines", "upper", "lower", "digits", "blank", "high", "stops", "exclaims", "bars", "symbols", "other", "word_length",
    "capitals", "shouted", "symbol_ends", "distinct_words", "repeats", "distinct_shingles", "distinct_lines", "line_length",
)
_CLASSES = ("upper", "lower", "digits", "blank", "high", "stops", "exclaims", "bars", "symbols", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.int64)
    table[65:91], table[97:123], table[48:58] = 0, 1, 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[128:] = 4
    for name, chars in (("stops", b".,;:"), ("exclaims", b"!?"), ("bars", b"|"), ("symbols", b"#$%&*+=<>@^~_{}[]\\/")):
        table[list(chars)] = _CLASSES.index(name)
    return table


_CLASS = _class_table()
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _distinct(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of distinct values of each run."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=len(bounds) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds by text, hashed word ids, their weights, statistics): a word's weight is its share, scaled to length 1 in each text."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, first = textbytes.word_bounds(data, offsets, textbytes.BLANK_SEPARATED)
    hashes = textbytes.span_hashes(textbytes.LOWER[data], starts, ends)
    words = np.diff(first)
    owner = np.repeat(np.arange(texts), words)

    key = owner.astype(np.uint64) * np.uint64(BUCKETS) + (hashes >> np.uint64(40)) % np.uint64(BUCKETS)
    key, seen = np.unique(key, return_counts=True)
    text = (key // np.uint64(BUCKETS)).astype(np.int64)
    ids = (key % np.uint64(BUCKETS)).astype(np.int64)
    weight = np.sqrt(seen)
    norm = np.sqrt(np.bincount(text, weight**2, texts))
    weight = weight / norm[text]
    bounds = np.searchsorted(text, np.arange(texts + 1))

    stats = np.zeros((texts, len(_STATS)))
    at = {name: i for i, name in enumerate(_STATS)}
    n = np.maximum(size, 1)
    w = np.maximum(words, 1)
    counts = np.zeros((texts, len(_CLASSES)))
    for i in range(0, texts, 4096):
        part = offsets[i : i + 4097]
        low, high = part[0], part[-1]
        rows = len(part) - 1
        where = np.repeat(np.arange(rows), np.diff(part)) * len(_CLASSES)
        counts[i : i + rows] = np.bincount(where + _CLASS[data[low:high]], minlength=rows * len(_CLASSES)).reshape(rows, -1)
    for i, name in enumerate(_CLASSES):
        stats[:, at[name]] = np.sqrt(counts[:, i] / n)
    stats[:, at["bytes"]] = np.log1p(size)
    stats[:, at["words"]] = np.log1p(words)
    lengths = ends - starts
    stats[:, at["word_length"]] = np.log1p(np.bincount(owner, lengths, texts) / w)
    if len(starts):
        head, tail = _CLASS[data[starts]], _CLASS[data[ends - 1]]
        second = _CLASS[data[np.minimum(starts + 1, ends - 1)]]
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        stats[:, at["capitals"]] = np.bincount(owner, head == 0, texts) / w
        stats[:, at["shouted"]] = np.bincount(owner, (head == 0) & (second == 0) & (lengths > 1), texts) / w
        stats[:, at["symbol_ends"]] = np.bincount(owner, (tail >= 6) & (tail <= 8), texts) / w
        stats[:, at["repeats"]] = np.bincount(owner, same, texts) / w
        stats[:, at["distinct_words"]] = _distinct(hashes, first) / w
        runs, run_bounds = textbytes.shingles(hashes, first, 3)
        stats[:, at["distinct_shingles"]] = _distinct(runs, run_bounds) / np.maximum(np.diff(run_bounds), 1)
    begins, stops, line = textbytes.word_bounds(data, offsets, _NOT_NEWLINE)
    lines = np.diff(line)
    stats[:, at["lines"]] = np.log1p(lines)
    stats[:, at["line_length"]] = np.log1p(size / np.maximum(lines, 1))
    stats[:, at["distinct_lines"]] = _distinct(textbytes.span_hashes(data, begins, stops), line) / np.maximum(lines, 1)
    return bounds, ids, weight, stats


@dataclass
class Machine:
    """Parameters of a fitted machine; the first BUCKETS features are words, then come statistics, then metadata."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def dense(self, values: np.ndarray) -> np.ndarray:
        """Statistics and metadata on a common scale; what is unknown stands in the middle."""
        return np.nan_to_num(np.clip((values - self.centre) / self.scale, -4, 4), nan=0.0) / math.sqrt(values.shape[1])

    def score(self, bounds: np.ndarray, ids: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
        texts = len(bounds) - 1
        x = self.dense(values)
        w, v = self.linear[BUCKETS:], self.factors[BUCKETS:]
        total = self.bias + x @ w
        sums, squares = x @ v, (x**2) @ (v**2)
        owner = np.repeat(np.arange(texts), np.diff(bounds))
        total += np.bincount(owner, self.linear[ids] * weight, texts)
        for f in range(self.factors.shape[1]):
            part = self.factors[ids, f] * weight
            sums[:, f] += np.bincount(owner, part, texts)
            squares[:, f] += np.bincount(owner, part * part, texts)
        total += 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, labels: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, Adagrad steps over small batches. ``rows`` are (ids, weights) of each text. Without rows every score is 0.5."""
    wide = values.shape[1]
    rng = np.random.default_rng(seed)
    known = np.isfinite(values)
    count = np.maximum(known.sum(0), 1)
    filled = np.where(known, values, 0.0)
    centre = filled.sum(0) / count
    scale = np.sqrt((np.where(known, values - centre, 0.0) ** 2).sum(0) / count)
    scale[scale < 1e-6] = 1.0
    machine = Machine(0.0, np.zeros(BUCKETS + wide), rng.normal(0, 0.05, (BUCKETS + wide, RANK)), centre, scale)
    if not len(labels):
        machine.factors[:] = 0
        return machine
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = math.log(share / (1 - share))
    x = machine.dense(values)
    dense_ids = np.arange(BUCKETS, BUCKETS + wide)
    seen_w, seen_v, seen_b = np.full(BUCKETS + wide, 1e-4), np.full((BUCKETS + wide, RANK), 1e-4), 1e-4
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(labels)))):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            ids = np.concatenate([np.concatenate([rows[k][0], dense_ids]) for k in batch])
            value = np.concatenate([np.concatenate([rows[k][1], x[k]]) for k in batch])
            sizes = np.array([len(rows[k][0]) + wide for k in batch])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(batch)), sizes)
            v = machine.factors[ids] * value[:, None]
            sums = np.add.reduceat(v, at)
            total = machine.bias + np.add.reduceat(machine.linear[ids] * value, at) + 0.5 * (sums**2 - np.add.reduceat(v * v, at)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[batch]) / len(batch)
            push = error[owner] * value
            slope_v = push[:, None] * (sums[owner] - v)
            used, inverse = np.unique(ids, return_inverse=True)
            step_w = np.bincount(inverse, push, len(used)) + PENALTY * machine.linear[used]
            step_v = np.stack([np.bincount(inverse, slope_v[:, f], len(used)) for f in range(RANK)], 1) + PENALTY * machine.factors[used]
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            seen_b += error.sum() ** 2
            machine.linear[used] -= RATE * step_w / np.sqrt(seen_w[used])
            machine.factors[used] -= RATE * step_v / np.sqrt(seen_v[used])
            machine.bias -= RATE * error.sum() / math.sqrt(seen_b)
    return machine


def held_out(key: Column) -> Column:
    """Rows never learned from: a fifth, by the checksum of the key's text. A null key is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _numbers(columns: list[str]) -> list[Column]:
    return [F.log1p(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"_meta{i}") for i, c in enumerate(columns)]


def _values(batch: pa.RecordBatch, first: int, row: int, stats: np.ndarray) -> np.ndarray:
    """Statistics with the metadata columns of the same rows; null is not a number."""
    meta = [batch.column(k).slice(row, len(stats)).to_numpy(zero_copy_only=False).astype(float) for k in range(first, batch.num_columns)]
    return np.column_stack([stats, *meta]) if meta else stats


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE
) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows that are not held out. Rows without a key or label are not used; a key
    labelled twice counts twice. Of documents that share a key one is learned from, that with the smallest hash of its text, so that
    copies of a key do not fill the task that fits."""
    spark = docs.sparkSession
    textbytes.bounded_batches(spark)
    usable = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label")).where(
        F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_key"))
    )
    # The sample is bounded, so its keys may be broadcast.
    chosen = settled(usable.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample))
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.struct(F.col(f"`{text}`").alias("_text"), *_numbers(list(metadata))).alias("_row"))
    known = texts.join(F.broadcast(chosen.select("_key").distinct()), "_key", "left_semi")
    single = known.groupBy("_key").agg(F.min_by("_row", F.struct(F.xxhash64("_row._text"), "_row")).alias("_row"))
    picked = single.join(F.broadcast(chosen), "_key").select("_label", "_row._text", "_key", *[f"_row._meta{i}" for i in range(len(metadata))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in textbytes.slices(batch.column(1)):
                bounds, ids, weight, stats = features(data, offsets)
                values = _values(batch, 3, row, stats)
                parts = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(stats)).cast(pa.int32()), batch.column(2).slice(row, len(stats)).cast(pa.string()),
                        pa.array([ids[a:b].astype(np.int32).tobytes() for a, b in parts], pa.binary()),
                        pa.array([weight[a:b].astype(np.float32).tobytes() for a, b in parts], pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    ["label", "key", "ids", "weights", "stats"],
                )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "label", "stats"], kind="stable")
        rows = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.float32).astype(float)) for a, b in zip(group["ids"], group["weights"], strict=True)]
        values = np.array([np.frombuffer(s) for s in group["stats"]])
        m = train(rows, values, group["label"].to_numpy(float))
        return pd.DataFrame([(m.bias, m.linear.astype(np.float32).tobytes(), m.factors.astype(np.float32).tobytes(), m.centre.tobytes(), m.scale.tobytes())])

    found = picked.mapInArrow(extract, "label int, key string, ids binary, weights binary, stats binary")
    made = found.groupBy(F.lit(0).alias("one")).applyInPandas(
        learn, "bias double, linear binary, factors binary, centre binary, scale binary"
    ).collect()
    wide = len(_STATS) + len(metadata)
    if not made:
        return train([], np.zeros((0, wide)), np.zeros(0))
    row = made[0]
    linear = np.frombuffer(row["linear"], np.float32).astype(float)
    factors = np.frombuffer(row["factors"], np.float32).astype(float).reshape(-1, RANK)
    return Machine(row["bias"], linear, factors, np.frombuffer(row["centre"]), np.frombuffer(row["scale"]))


def with_score(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """All columns (or those in ``keep``) with ``score`` (double, 0 to 1).

    Null and empty texts are scored like any other text, from their statistics and metadata; null metadata counts as average.
    Rows are independent, so repeated rows get equal scores; an empty table stays empty; an input column named like the
    score is replaced.
    """
    textbytes.bounded_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if keep is None else keep) if c != score]
    source = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), *_numbers(list(metadata)))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for row, data, offsets in textbytes.slices(batch.column(0)):
                bounds, ids, weight, stats = features(data, offsets)
                scores.append(shared.value.score(bounds, ids, weight, _values(batch, 2, row, stats)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(scores))], ["_row", "_score"])

    schema = StructType([source.schema["_row"], StructField("_score", DoubleType())])
    scored = source.mapInArrow(run, schema)
    return scored.select(*[F.col(f"_row.`{c}`") for c in carried], F.col("_score").alias(score))


def op1_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
