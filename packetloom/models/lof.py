"""Local outlier factor over exact nearest neighbours.

Equal vectors are collapsed to one point with a weight, so a crowd of copies costs one point. The points are laid out once, in blocks that
follow the cells around pivots and the distance to them; distance bounds tell which blocks a query can need. A task holds the queries of some
blocks and goes through the blocks of candidates in the shared folder, nearest first, keeping the best ``k`` of each query. So nothing is
copied per pair of blocks: the tables written are as large as the points and their neighbours, whatever the number of pairs compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from packetloom.operators.slices import attach_by_slot
from packetloom.session import open_file, scratch_path, settled

NEIGHBORS, LIMIT = 20, 1.5
PIVOTS = 64
BLOCK = 2_048

# Slots that spread a vector which very many rows share.
_SLOTS = 64
#: Queries of a task, at most, and numbers in their vectors, unless one block has more; queries compared at once.
_QUERIES, _NUMBERS, _CHUNK = 16_384, 1 << 22, 256
#: Differences of numbers computed at once.
_DIFFERENCES = 1 << 22
# Stands for the name of a point whose rows have none; it comes last among equals.
_NAMELESS = np.iinfo(np.int64).max


def _vector(column: str):
    return F.transform(F.col(column), lambda e: e.cast("double"))


def _digest() -> list:
    """128 bits that stand for the vector ``v``; zeros and NaNs of any sign are equal, as in a grouping."""
    # Hashes pass over missing numbers, so their places are hashed too.
    return [F.xxhash64(F.lit(i), F.col("v"), F.transform("v", lambda e: e.isNull())).alias(f"h{i}") for i in (1, 2)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count or len(column) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("a vector is missing or not as long as the others")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From differences, so that no digit is lost far from 0."""
    step = max(1, _DIFFERENCES // 4 // max(1, b.size))
    return np.concatenate([np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(2)) for i in range(0, len(a), step)] or [np.zeros((0, len(b)))])


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values; as single floats where those are the same numbers."""
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    values = np.ascontiguousarray(single if (single == values).all() else values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int64) * values.itemsize * values.shape[1]), pa.py_buffer(values)]
    ).cast(pa.binary())


def _unpacked(values: Sequence[bytes], width: int) -> np.ndarray:
    wide = [len(x) == 8 * width for x in values]
    if all(wide) or not any(wide):
        return np.frombuffer(b"".join(values), np.float64 if all(wide) else np.float32).reshape(-1, width).astype(float)
    return np.array([np.frombuffer(x, np.float64 if w else np.float32) for x, w in zip(values, wide, strict=True)], float)


def _collapsed(digests: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, smallest name, weight) of the distinct digests, in their order of appearance."""
    _, first, which = np.unique(digests, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    names, weights = np.full(len(first), _NAMELESS), np.zeros(len(first), np.int64)
    np.minimum.at(names, which.ravel(), p)
    np.add.at(weights, which.ravel(), w)
    return first[order], names[order], weights[order]


def _to_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, v, h1, h2) as points with ``cell`` (nearest pivot) and ``r`` (distance to it); copies in a batch become one."""
    width = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = _matrix(batch.column("v"), width)
            digests = np.stack([batch.column(h).to_numpy() for h in ("h1", "h2")], axis=1)
            first, p, w = _collapsed(digests, batch.column("id").cast(pa.int64()).fill_null(_NAMELESS).to_numpy(), np.ones(len(v), np.int64))
            d = _distances(v[first], pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [_packed(v[first]), pa.array(p), pa.array(w), *(pa.array(h) for h in digests[first].T), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                names=["v", "p", "w", "h1", "h2", "cell", "r"],
            )

    return rows.mapInArrow(assign, "v binary, p long, w long, h1 long, h2 long, cell int, r double")


_BLOCK_ROW = "part int, number int, n int, cells array<int>, lows array<double>, highs array<double>, p binary, w binary, h1 binary, h2 binary, v binary"


def _to_blocks(cells: DataFrame, block: int, width: int) -> DataFrame:
    """One row per block of neighbouring points, from partitions in the order of cells; equal vectors become one point."""

    def made(part: int, number: int, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(rows["cell"], prepend=-1))
        row = {
            "part": part, "number": number, "n": len(rows["p"]), "cells": rows["cell"][cuts].tolist(), "lows": np.minimum.reduceat(rows["r"], cuts).tolist(),
            "highs": np.maximum.reduceat(rows["r"], cuts).tolist(), **{name: rows[name].tobytes() for name in ("p", "w", "h1", "h2")},
            "v": _packed(rows["v"].reshape(1, -1))[0].as_py(),
        }
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n", pa.int32()), ("cells", pa.list_(pa.int32())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())), *((name, pa.binary()) for name in ("p", "w", "h1", "h2", "v"))])
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        part, number = 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column("part")[0].as_py()
            rows = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("p", "w", "h1", "h2", "cell", "r")}
            rows["v"] = _unpacked(batch.column("v").to_pylist(), width)
            rows = {name: np.concatenate([held[name], values]) if held else values for name, values in rows.items()}
            first, p, w = _collapsed(np.stack([rows["h1"], rows["h2"]], axis=1), rows["p"], rows["w"])
            held = {name: values[first] for name, values in rows.items()} | {"p": p, "w": w}
            # The last point may go on in the next batch.
            while len(held["p"]) > block:
                yield made(part, number, {name: values[:block] for name, values in held.items()})
                held, number = {name: values[block:] for name, values in held.items()}, number + 1
        if held:
            yield made(part, number, held)

    return cells.mapInArrow(cut, _BLOCK_ROW)


def _one_per_file(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", 1).parquet(path)
    return path


def _files(spark: SparkSession, path: str, *columns: str) -> list:
    """The given columns and ``file`` of the rows of a table, one per block."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file")).collect()
    return [{**r.asDict(), "file": unquote(r["file"])} for r in rows]


def _stored(path: str, *columns: str) -> list[bytes]:
    with open_file(path) as f:
        table = pq.read_table(f, columns=list(columns))
    return [table.column(c)[0].as_py() for c in columns]


@dataclass
class _Layout:
    """The blocks: their files, sizes, the number of the first point of each, and the parts of cells in them."""

    files: list[str]
    sizes: np.ndarray
    starts: np.ndarray
    segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Blocks whose points one task takes.
    groups: list[list[int]]
    width: int

    def read(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, p, w = _stored(self.files[number], "v", "p", "w")
        n = int(self.sizes[number])
        return _unpacked([v], n * self.width).reshape(n, self.width), np.frombuffer(p, np.int64), np.frombuffer(w, np.int64)

    def each_group(self, spark: SparkSession, fn: Callable[[list[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``fn`` over the blocks of every group, a task for each."""
        groups = self.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    yield from fn(groups[g])

        return spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, schema)

    def gathered(self, files: list[str], column: str, at: np.ndarray) -> np.ndarray:
        """The numbers that ``column`` of the block tables ``files`` has for the points ``at``, block by block."""
        order = np.argsort(at, axis=None, kind="stable")
        wanted = at.ravel()[order]
        cuts = np.searchsorted(wanted, [*self.starts, self.starts[-1] + self.sizes[-1]])
        kind = np.int64 if column == "p" else np.float64
        out = np.zeros(at.size, kind)
        for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if low < high:
                values = np.frombuffer(_stored(files[number], column)[0], kind)
                out[order[low:high]] = values[wanted[low:high] - self.starts[number]]
        return out.reshape(at.shape)


def _laid_out(df: DataFrame, row_id: str, vector: str, pivots: int, block: int) -> tuple[_Layout, np.ndarray, int]:
    """(blocks of all points, pivots, number of rows)."""
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("id"), _vector(vector).alias("v"))
    total = rows.count()
    if total < 2:
        raise ValueError("fewer than two rows")
    # At most ``pivots`` rows. They decide how the points are cut, never what comes out.
    chosen = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()], dtype=float)
    centers = np.unique(chosen, axis=0)
    cells = _to_cells(rows.select("id", "v", *_digest()), centers)
    place = ["cell", "r", "h1", "h2"]
    dealt = cells.repartitionByRange(max(1, -(-total // (8 * block))), *place).sortWithinPartitions(*place)
    path = _one_per_file(_to_blocks(dealt.withColumn("part", F.spark_partition_id()), block, centers.shape[1]), "blocks")
    found = sorted(_files(spark, path, "part", "number", "n", "cells", "lows", "highs"), key=lambda r: (r["part"], r["number"]))
    sizes = np.array([r["n"] for r in found], np.int64)
    queries = min(_QUERIES, _NUMBERS // max(1, centers.shape[1]))
    together = max(1, min(queries // block, -(-len(found) // (3 * spark.sparkContext.defaultParallelism))))
    groups = [list(range(i, min(i + together, len(found)))) for i in range(0, len(found), together)]
    segments = [tuple(np.array(r[c]) for c in ("cells", "lows", "highs")) for r in found]
    return _Layout([r["file"] for r in found], sizes, np.cumsum(sizes) - sizes, segments, groups, centers.shape[1]), centers, total


class _Best:
    """The best ``k`` candidates of some queries: distance, name, number and weight, by distance and name."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d, self.s = np.full((n, k), np.inf), np.full((n, k), _NAMELESS)
        self.at, self.w = np.full((n, k), -1, np.int64), np.zeros((n, k), np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, q: np.ndarray, d: np.ndarray, s: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        good = (w > 0) & ~(d > self.d[q, -1])
        self.held.append(tuple(x[good] for x in (q, d, s, at, w)))
        self.waiting += int(good.sum())
        if self.waiting > 4 * len(self.d):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            self.held = []
            return
        q, *new = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.waiting = [], 0
        touched, row = np.unique(q, return_inverse=True)
        old_row, old_at = np.nonzero(self.w[touched] > 0)
        own = (self.d, self.s, self.at, self.w)
        row = np.concatenate([row, old_row])
        d, s, at, w = (np.concatenate([x, mine[touched[old_row], old_at]]) for x, mine in zip(new, own, strict=True))
        order = np.lexsort((s, d, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(touched)))[row]
        best = rank < self.k
        order, row, rank = order[best], touched[row[best]], rank[best]
        for mine, x in zip(own, (d, s, at, w), strict=True):
            mine[row, rank] = x[order]


def _lower_bounds(to_pivots: np.ndarray, segments: tuple[np.ndarray, np.ndarray, np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """No point of a block is nearer than this to a query at these distances to the pivots (between them and ``most``)."""
    cells, lows, highs = segments
    near, far = to_pivots[..., cells], (to_pivots if most is None else most)[..., cells]
    # A little less, as distances are rounded.
    bound = np.maximum(near - highs - 1e-12 * (near + highs), lows - far - 1e-12 * (lows + far))
    return np.maximum(bound, 0.0).min(axis=-1)


def _search(layout: _Layout, pivots: np.ndarray, k: int, mine: list[int]) -> _Best:
    """The best ``k`` candidates besides itself of every point in the blocks ``mine``.

    Distances are first taken from products in single precision. All pairs that can be among the best by a bound of the rounding error are
    computed from differences, so the neighbours are exact. Where too many pairs pass, points spread too widely for single precision: products
    are taken again in double precision, around the middle of the block.
    """
    width = pivots.shape[1]
    pairs = max(1, _DIFFERENCES // max(1, width))
    own = {j: layout.read(j) for j in mine}
    x = np.concatenate([own[j][0] for j in mine])
    numbers = np.concatenate([layout.starts[j] + np.arange(layout.sizes[j]) for j in mine])
    names = np.concatenate([own[j][1] for j in mine])
    middle = pivots[np.isfinite(pivots).all(axis=1)].mean(axis=0) if np.isfinite(pivots).all(axis=1).any() else np.zeros(width)
    best = _Best(len(x), k)
    to_pivots = _distances(x, pivots)
    low, high = to_pivots.min(axis=0), to_pivots.max(axis=0)
    coarse = np.array([_lower_bounds(low, segments, high) for segments in layout.segments])
    others = [j for j in np.argsort(coarse, kind="stable").tolist() if j not in own]

    # Written over and over.
    space = np.empty(_CHUNK * int(layout.sizes.max()), np.float32)
    flag_space = np.empty(len(space), bool)

    def products(a: np.ndarray, kind: type, left: bool) -> np.ndarray:
        square, one = (a * a).sum(axis=1), np.ones(len(a))
        return np.column_stack([-2.0 * a, square, one] if left else [a, one, square]).astype(kind)

    def slack(a: np.ndarray, b: np.ndarray, rounding: float) -> np.ndarray:
        """How far a product of rows can be from the square of the distance."""
        longest = np.sqrt(np.fmax.reduce((b * b).sum(axis=1), initial=0.0))
        return (width + 16) * rounding * (np.sqrt((a * a).sum(axis=1)) + longest) ** 2

    def passing(near: np.ndarray, worst: np.ndarray, loose: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Places in ``near`` that can be among the best, where ``worst`` is the distance of the worst kept so far."""
        limit = worst * worst * (1 + 1e-9) + loose
        if np.isinf(worst).any() and near.shape[1] > k:
            # Of k + 1 candidates one may be the query itself; several may have its name.
            limit = np.where(lone, np.minimum(limit, np.partition(near, k, axis=1)[:, k] + 2 * loose), limit)
        flags = flag_space[: near.size]
        np.greater(near, np.nextafter(limit.astype(near.dtype), np.inf, dtype=near.dtype)[:, None], out=flags.reshape(near.shape))
        np.logical_not(flags, out=flags)
        if near.size % 8:
            return np.flatnonzero(flags)
        # Few are set, so eight are looked at together.
        some = np.flatnonzero(flags.view(np.uint64))
        return (some[:, None] * 8 + np.arange(8))[flags.reshape(-1, 8)[some]]

    with np.errstate(over="ignore", invalid="ignore"):
        moved = x - middle
        left = products(moved, np.float32, True)
        for j in [*mine, *others]:
            worst = best.d[:, -1]
            if j not in own and coarse[j] > worst.max():
                continue
            wanted = np.flatnonzero(~(_lower_bounds(to_pivots, layout.segments[j]) > worst))
            if not len(wanted):
                continue
            y, p, w = own[j] if j in own else layout.read(j)
            y_moved = y - middle
            right = products(y_moved, np.float32, False).T
            loose = slack(moved, y_moved, 2.0**-23)
            center, ordered = y.mean(axis=0), np.sort(p)
            for i in range(0, len(wanted), _CHUNK):
                rows = wanted[i : i + _CHUNK]
                near = np.matmul(left[rows], right, out=space[: len(rows) * len(y)].reshape(len(rows), len(y)))
                # Where the block has no second point of the query's name.
                lone = np.searchsorted(ordered, names[rows], "right") - np.searchsorted(ordered, names[rows]) <= 1
                hit = passing(near, worst[rows], loose[rows], lone)
                if len(hit) > 4 * (k + 1) * len(rows):
                    a, b = x[rows] - center, y - center
                    hit = passing(products(a, np.float64, True) @ products(b, np.float64, False).T, worst[rows], slack(a, b, 2.0**-52), lone)
                q, c = rows[hit // len(y)], hit % len(y)
                for h in range(0, len(q), pairs):
                    qs, cs = q[h : h + pairs], c[h : h + pairs]
                    at = layout.starts[j] + cs
                    # Points of one name are no neighbours of each other.
                    self_too = (numbers[qs] == at) | (names[qs] == p[cs]) & (p[cs] != _NAMELESS)
                    d = np.where(self_too, 0.0, np.sqrt(((x[qs] - y[cs]) ** 2).sum(axis=1)))
                    best.add(qs, d, p[cs], at, w[cs] - self_too)
        best.settle()
    return best


@dataclass
class _Found:
    """What is known of the points of each block: their neighbours, in files of one block each."""

    layout: _Layout
    files: list[str]
    k: int

    def read(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, distances, weights) of the neighbours, a row for each point."""
        at, d, w = _stored(self.files[number], "at", "d", "w")
        n = int(self.layout.sizes[number])
        return tuple(np.frombuffer(x, kind).reshape(n, -1) for x, kind in ((at, np.int64), (d, np.float64), (w, np.int64)))


def _all_neighbours(df: DataFrame, row_id: str, vector: str, k: int, pivots: int, block: int) -> _Found:
    layout, centers, total = _laid_out(df, row_id, vector, pivots, block)
    k = min(k, total - 1)

    def searched(mine: list[int]) -> Iterator[pa.RecordBatch]:
        best = _search(layout, centers, k, mine)
        # Weights of a query add up to k.
        before = np.cumsum(best.w, axis=1) - best.w
        weights = np.clip(k - before, 0, best.w)
        farthest = np.where(weights > 0, best.d, -np.inf).max(axis=1)
        at = 0
        for number in mine:
            some = slice(at, at := at + int(layout.sizes[number]))
            yield pa.RecordBatch.from_pydict(
                {"number": pa.array([number], pa.int32()), **{name: pa.array([x[some].tobytes()]) for name, x in (("at", best.at), ("d", best.d), ("w", weights), ("kd", farthest))}}
            )

    spark = df.sparkSession
    path = _one_per_file(layout.each_group(spark, searched, "number int, at binary, d binary, w binary, kd binary"), "neighbours")
    return _Found(layout, _in_order(spark, path), k)


def _in_order(spark: SparkSession, path: str) -> list[str]:
    return [r["file"] for r in sorted(_files(spark, path, "number"), key=lambda r: r["number"])]


def _names(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NAMELESS)


def _points(spark: SparkSession, layout: _Layout) -> DataFrame:
    """``p, w, h1, h2`` of all points."""

    def read(mine: list[int]) -> Iterator[pa.RecordBatch]:
        for number in mine:
            p, *others = (np.frombuffer(x, np.int64) for x in _stored(layout.files[number], "p", "w", "h1", "h2"))
            yield pa.RecordBatch.from_arrays([_names(p), *map(pa.array, others)], names=["p", "w", "h1", "h2"])

    return layout.each_group(spark, read, "p long, w long, h1 long, h2 long")


def _names_repeat(spark: SparkSession, layout: _Layout) -> bool:
    """Whether rows with different vectors have the same name."""
    return not _points(spark, layout).where("p IS NOT NULL").groupBy("p").count().where("count > 1").isEmpty()


def _named_neighbours(spark: SparkSession, found: _Found, repeated: bool) -> DataFrame:
    """``q, s, d, w`` by names; points of one name are one query, whose nearest come from those of all."""
    layout, k = found.layout, found.k

    def read(mine: list[int]) -> Iterator[pa.RecordBatch]:
        for number in mine:
            at, d, w = found.read(number)
            q = np.repeat(np.frombuffer(_stored(layout.files[number], "p")[0], np.int64), at.shape[1])
            used = w.ravel() > 0
            s = layout.gathered(layout.files, "p", at.ravel()[used])
            yield pa.RecordBatch.from_pydict({"q": _names(q[used]), "s": _names(s), "d": pa.array(d.ravel()[used]), "w": pa.array(w.ravel()[used])})

    rows = layout.each_group(spark, read, "q long, s long, d double, w long")
    if not repeated:
        return rows
    order = Window.partitionBy("q").orderBy("d", "s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(order), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < k).select("q", "s", "d", F.least(F.col("w"), k - F.col("before")).alias("w"))


def nearest(df: DataFrame, row_id: str, vector: str, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """(points, neighbours, k): ``neighbours`` holds ``q, s, d, w`` with the weights of a query adding up to k."""
    spark = df.sparkSession
    found = _all_neighbours(df, row_id, vector, k, pivots, block)
    layout = found.layout

    def points(mine: list[int]) -> Iterator[pa.RecordBatch]:
        for number in mine:
            v, p, w = layout.read(number)
            yield pa.RecordBatch.from_pydict({"v": pa.ListArray.from_arrays(np.arange(len(v) + 1) * layout.width, v.ravel()), "p": _names(p), "w": pa.array(w)})

    return layout.each_group(spark, points, "v array<double>, p long, w long"), _named_neighbours(spark, found, _names_repeat(spark, layout)), found.k


def _factors_by_name(spark: SparkSession, found: _Found) -> DataFrame:
    """``h1, h2, lof`` where rows with different vectors have the same name: these are one point with many places."""
    neighbours = settled(_named_neighbours(spark, found, True))
    slot = F.pmod(F.xxhash64("q"), F.lit(_SLOTS))
    distance = neighbours.groupBy("q").agg(F.max("d").alias("kd")).withColumnRenamed("q", "s")
    reach = attach_by_slot(neighbours, distance, ["s"], slot).withColumn("reach", F.greatest("kd", "d"))
    density = reach.groupBy("q").agg((1.0 / (F.sum(F.col("reach") * F.col("w")) / F.sum("w") + 1e-10)).alias("lrd"))
    around = attach_by_slot(neighbours, density.select(F.col("q").alias("s"), F.col("lrd").alias("lrd_s")), ["s"], slot)
    mean = around.groupBy("q").agg((F.sum(F.col("lrd_s") * F.col("w")) / F.sum("w")).alias("mean_lrd"))
    factor = mean.join(density, "q").select(F.col("q").alias("p"), (F.col("mean_lrd") / F.col("lrd")).alias("lof"))
    return _points(spark, found.layout).join(factor, "p").select("h1", "h2", "lof")


def _factors(spark: SparkSession, found: _Found) -> DataFrame:
    """``h1, h2, lof`` of all points."""
    layout = found.layout

    def of_blocks(mine: list[int], files: list[str], column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number, distances, weights, values of the neighbours) of blocks; the values are gathered for all of them at once."""
        known = [found.read(number) for number in mine]
        at = np.concatenate([x[0] for x in known])
        values = layout.gathered(files, column, np.maximum(at, 0))
        ends = np.cumsum([len(x[0]) for x in known])
        for number, (a, d, w), end in zip(mine, known, ends, strict=True):
            yield number, d, w, values[end - len(a) : end]

    def densities(mine: list[int]) -> Iterator[pa.RecordBatch]:
        for number, d, w, kd in of_blocks(mine, found.files, "kd"):
            reach = np.where(w > 0, np.maximum(kd, d), 0.0)
            lrd = 1.0 / ((reach * w).sum(axis=1) / w.sum(axis=1) + 1e-10)
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "lrd": pa.array([lrd.tobytes()])})

    dense = _in_order(spark, _one_per_file(layout.each_group(spark, densities, "number int, lrd binary"), "densities"))

    def factors(mine: list[int]) -> Iterator[pa.RecordBatch]:
        for number, _, w, around in of_blocks(mine, dense, "lrd"):
            lrd = np.frombuffer(_stored(dense[number], "lrd")[0], np.float64)
            mean = np.where(w > 0, around * w, 0.0).sum(axis=1) / w.sum(axis=1)
            h1, h2 = (pa.array(np.frombuffer(x, np.int64)) for x in _stored(layout.files[number], "h1", "h2"))
            # A vector with a missing or infinite number has no factor.
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = mean / lrd
            yield pa.RecordBatch.from_arrays([h1, h2, pa.array(factor, mask=~np.isfinite(factor))], names=["h1", "h2", "lof"])

    return layout.each_group(spark, factors, "h1 long, h2 long, lof double")


def local_outlier_factor(
    df: DataFrame, row_id: str, vector: str, k: int = NEIGHBORS, limit: float = LIMIT, pivots: int = PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """``id, lof, label`` for every row: -1 where the factor exceeds ``limit``."""
    spark = df.sparkSession
    found = _all_neighbours(df, row_id, vector, k, pivots, block)
    per_vector = _factors_by_name(spark, found) if _names_repeat(spark, found.layout) else _factors(spark, found)
    names = df.select(F.col(row_id).alias("id"), _vector(vector).alias("v")).select("id", *_digest())
    # Many rows may share a vector, so the join back is spread by id.
    out = attach_by_slot(names, per_vector, ["h1", "h2"], F.pmod(F.xxhash64("id"), F.lit(_SLOTS)))
    return out.select("id", "lof", F.when(F.col("lof") > limit, -1).otherwise(1).alias("label"))
