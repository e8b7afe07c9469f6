"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections.

Unit vectors at the threshold differ by a known normal spread on a random line, so each line gives a window, centred on the query, in
which such a pair collides with a known probability. Lines are cut into cells by the signs of further projections, so that a window
holds few vectors however many there are; within a cell, vectors are sorted along its line and windows give the pairs. A pair's collisions are
counted over all lines, and pairs whose count is what a pair at the threshold reaches with the wanted recall are verified by their
cosine in double precision. A pair found in several cells counts in the first only.

The number of lines is as large as the recall of a pair exactly at the threshold asks for (``MISS``); closer pairs are found with more
certainty. Equal vectors are one representative with a weight. Large cells are searched in pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.components import connected_components
from packetloom.llm.groups import fixed_width, paired_chunks, pairs_within, together, whole_groups
from packetloom.llm.textbytes import mix
from packetloom.session import settled

COSINE = 0.9
#: Chance that a pair exactly at the threshold shares no cell and window, or counts too few collisions.
MISS = 1e-5
#: Vectors of a cell, about.
CELL = 64
#: Half a window, in spreads of the difference of a pair at the threshold; and steps of a line's scale.
_WIDTH = 1.96
_STEPS = 24


@dataclass(frozen=True)
class Plan:
    signs: int
    lines: int
    window: int
    collisions: int


def planned(vectors: int, cosine: float = COSINE, miss: float = MISS) -> Plan:
    """Signs per cell, lines, half a window in steps, and collisions needed, for a number of vectors."""
    signs = max(1, math.ceil(math.log2(max(vectors, 2) / CELL)))
    spread = math.sqrt(2 - 2 * cosine)
    window = math.ceil(_WIDTH * spread * _STEPS) + 1
    inside = math.erf(_WIDTH / math.sqrt(2))
    met = (1 - math.acos(cosine) / math.pi) ** signs * inside
    lines = max(40, math.ceil(math.log(miss) / math.log(1 - met)))
    tail, needed = 0.0, 0
    for k in range(lines + 1):
        tail += math.comb(lines, k) * inside**k * (1 - inside) ** (lines - k)
        if tail > miss / 10:
            needed = k
            break
    return Plan(signs, lines, window, needed)


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, digest): vectors of doubles as bytes; null for those that link with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.large_list(pa.float64()))
            out: list[bytes | None] = []
            flat = np.asarray(pc.fill_null(lists.values, np.nan), dtype=np.float64) if len(lists) else np.zeros(0)
            at = lists.offsets.to_numpy()
            valid = np.asarray(lists.is_valid())
            for i in range(len(lists)):
                x = flat[at[i] : at[i + 1]] + 0.0
                usable = valid[i] and len(x) and np.isfinite(x).all() and x.any()
                if usable:
                    # Scaled by a power of two, so that squares neither overflow nor vanish; exact.
                    x = x * 2.0 ** -np.frexp(np.abs(x).max())[1]
                out.append(x.tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "vector"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(read, "key bigint, vector binary").withColumn("digest", F.sha2("vector", 256))


_CELLS = "cell bigint, row bigint, line int, spot int, codes binary, spots binary"


def _cells(leaders: DataFrame, plan: Plan, seed: int = 3) -> DataFrame:
    """A row per vector and line: its cell, its spot on the line, and its codes and spots on all lines."""
    code_type = np.uint16 if plan.signs <= 16 else np.uint64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(plan.signs, dtype=np.int64)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            sizes = np.asarray(pc.binary_length(batch.column(1))) // 8
            for size in np.unique(sizes).tolist():
                if size not in drawn:
                    drawn[size] = np.random.default_rng((seed, size)).normal(size=(size, plan.lines * (plan.signs + 1)))
                of_size = np.flatnonzero(sizes == size)
                for i in range(0, len(of_size), 512):
                    part = of_size[i : i + 512]
                    x = fixed_width(batch.column(1).take(pa.array(part)), np.float64, size)
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                    p = (x @ drawn[size]).reshape(len(part), plan.lines, plan.signs + 1)
                    codes = ((p[:, :, 1:] > 0) * powers).sum(2)
                    spots = np.clip(np.rint(p[:, :, 0] * _STEPS), -127, 127).astype(np.int8)
                    cell = mix(mix(codes.astype(np.uint64) + (np.arange(plan.lines, dtype=np.uint64) << np.uint64(40))) + np.uint64(size))
                    packed_codes = [c.tobytes() for c in codes.astype(code_type)]
                    packed_spots = [s.tobytes() for s in spots]
                    which = pa.array(np.repeat(np.arange(len(part)), plan.lines))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell.ravel().view(np.int64)), pa.array(np.repeat(rows[part], plan.lines)),
                            pa.array(np.tile(np.arange(plan.lines, dtype=np.int32), len(part))), pa.array(spots.ravel().astype(np.int32)),
                            pa.array(packed_codes, pa.binary()).take(which), pa.array(packed_spots, pa.binary()).take(which),
                        ],
                        ["cell", "row", "line", "spot", "codes", "spots"],
                    )

    return leaders.select("row", "vector").mapInArrow(deal, _CELLS)


def _candidates(leaders: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of rows that share a cell and its window and count enough collisions on all lines."""
    code_type = np.uint16 if plan.signs <= 16 else np.uint64
    chunks = together(paired_chunks(_cells(leaders, plan), ["cell"], "row"), ["cell", "left", "right"], ["spot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["cell", "left", "right"]):
            row, line, spot, side, left, right = (table.column(c).to_numpy() for c in ("row", "line", "spot", "side", "left", "right"))
            codes = fixed_width(table.column("codes"), code_type, plan.lines)
            spots = fixed_width(table.column("spots"), np.int8, plan.lines).astype(np.int16)
            scale = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * 1024 + spot
            ends = np.searchsorted(scale, scale + plan.window, "right")
            for i, j in pairs_within(bounds, ends, limit=1 << 16):
                apart = (left[i] == right[i]) | (side[i] != side[j])
                i, j = i[apart], j[apart]
                close = np.abs(spots[i] - spots[j]) <= plan.window
                enough = close.sum(1) >= plan.collisions
                i, j, close = i[enough], j[enough], close[enough]
                first = (close & (codes[i] == codes[j])).argmax(1) == line[i]
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(row[i], row[j])), pa.array(np.maximum(row[i], row[j]))], ["a", "b"])

    return chunks.mapInArrow(search, "a bigint, b bigint")


def _links(pairs: DataFrame, leaders: DataFrame, cosine: float) -> DataFrame:
    """Pairs whose cosine reaches the threshold."""
    side = lambda name: leaders.select(F.col("row").alias(name), F.col("vector").alias(f"v_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "v_a", "v_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(pc.binary_length(batch.column(k))) for k in (2, 3)]
            for size in np.unique(sizes[0]).tolist():
                rows = pa.array(np.flatnonzero((sizes[0] == size) & (sizes[1] == size)))
                x, y = (fixed_width(batch.column(k).take(rows), np.float64, size // 8) for k in (2, 3))
                value = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                good = rows.take(pa.array(np.flatnonzero(value >= cosine)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])

    return met.mapInArrow(verify, "a bigint, b bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(key, n_links, component, kept) of every row.

    ``n_links`` counts the other rows linked directly, ``component`` is the smallest key reachable, ``kept`` whether that is the
    row's own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other; they are kept. Equal vectors are linked. Rows without a key take no part, have no links, no
    component, and are kept. An empty table stays empty; other columns are not read.
    """
    rows = settled(_vectors(df, key, vector).withColumn("row", F.monotonically_increasing_id()))
    usable = rows.where(F.col("vector").isNotNull() & F.col("key").isNotNull())
    classes = settled(usable.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("weight"), F.min("key").alias("key")))
    leaders = settled(rows.select("row", "vector").join(classes.select("row"), "row", "left_semi"))
    plan = planned(leaders.count(), cosine, miss)
    links = settled(_links(_candidates(leaders, plan), leaders, cosine))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("row").alias("b"), "weight"), "b").groupBy(F.col("a").alias("row")).agg(F.sum("weight").alias("others"))
    found = settled(connected_components(links).withColumnRenamed("node", "row"))
    named = classes.join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    # Components are numbered by rows; what counts is their smallest key.
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    result = named.join(least, "component").join(counts, "row", "left").select(
        "digest", "least", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    out = rows.select("key", F.when(F.col("key").isNotNull(), F.col("digest")).alias("digest")).join(result, "digest", "left")
    component = F.coalesce("least", "key")
    return out.select(
        "key", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"), (F.col("key").isNull() | (component == F.col("key"))).alias("kept")
    )


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_vectors(vectors).select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""
