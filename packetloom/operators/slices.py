"""Ordered per-key work that stays spread out when one key owns much of the data.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task. Here every key with more rows than a slot
holds is cut into slots of about equally many rows, wherever in time they lie: a busy minute, or a single instant, is cut as finely as
a quiet year. The edges come from a sample of the rows by their hash, one pass that shuffles only what it picks; they decide where
a key is cut, never what comes out. Windows run inside ``(key, slot)``; what must cross an edge travels as one small row per slot, and
only keys that were cut have such rows. Rows without a key or a time belong to no group; they are spread by their hash.

Steps that read their rows twice take a ``source``: a table with the same rows to read the second time. A chain of
steps over one written table then grows by a few scans per step, where reading the chain itself twice
at each step would double the plan every time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.timing import floor_us, width_us
from packetloom.schema import PACKET_ORDER

#: Rows of a slot, at most. A smaller number makes more and smaller groups and gives the same results.
SLOT_ROWS = 1 << 20
#: Width of the slots of time over which per-key results are attached to rows.
DEFAULT_SLICE = "1 minute"

#: Sampled rows from one edge to the next, and edges per slot: so many sampled rows in place of one make a slot that is too large unlikely
#: beyond 1e-12.
_PICKED, _PARTS = 32, 3
#: Steps of the search for a slot: a key has fewer than 2**_STEPS of them.
_STEPS = 20

_SLICE = "__slice"
_EDGES = "__edges"
_ALL = "__all"


def _present(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for column in columns:
        ok = ok & F.col(column).isNotNull()
    return ok


class Cut:
    """Where the keys of ``source`` are cut, in the order of ``order``; ``order[0]`` is the time."""

    def __init__(self, source: DataFrame, keys: Sequence[str], order: Sequence[str] = PACKET_ORDER, size: int = SLOT_ROWS):
        self.order = list(order)
        # Without keys the whole table is one.
        self.keys = list(keys) or [_ALL]
        self.known = [*keys, self.order[0]]
        picked = max(1, min(_PICKED, size // _PARTS))
        chance = F.pmod(F.xxhash64(*keys, *self.order), F.lit(size)) < _PARTS * picked
        sample = self._keyed(source).where(_present(self.known) & chance).select(*self.keys, F.struct(*self.order).alias("__at"))
        numbered = sample.withColumn("__rn", F.row_number().over(Window.partitionBy(*self.keys).orderBy("__at")))
        #: One row for each key that is cut.
        self.edges = numbered.where(F.col("__rn") % picked == 0).groupBy(*self.keys).agg(F.sort_array(F.collect_list("__at")).alias(_EDGES))

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_ALL, F.lit(0)) if self.keys == [_ALL] else df

    def _slot(self) -> Column:
        """The number of edges that are not after the row, by halves."""
        place, edges = F.struct(*self.order), F.col(_EDGES)

        def step(at: Column, size: Column) -> Column:
            return F.when((at + size <= F.size(edges)) & (F.get(edges, at + size - 1) <= place), at + size).otherwise(at)

        found = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(_STEPS))]), F.lit(0), step)
        return F.when(edges.isNull(), F.lit(0)).otherwise(found)

    def rows(self, df: DataFrame) -> DataFrame:
        """``df`` with the slot of each row; rows without a key or time get one below zero, by their hash."""
        # As bigint, so that equal hashes of many such rows stay far from the slots.
        lost = (-1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).cast("int")
        slot = F.when(_present(self.known), self._slot()).otherwise(lost)
        return self._keyed(df).join(self.edges, self.keys, "left").withColumn(_SLICE, slot).drop(_EDGES)

    def cut_rows(self, df: DataFrame) -> DataFrame:
        """The rows of keys that are cut, with their slots."""
        return self._keyed(df).where(_present(self.known)).join(self.edges, self.keys).withColumn(_SLICE, self._slot()).drop(_EDGES)

    def inside(self) -> Window:
        return Window.partitionBy(*self.keys, _SLICE)

    def across(self) -> Window:
        """Over the slots of a key; there is one row of each."""
        return Window.partitionBy(*self.keys).orderBy(_SLICE)

    def carried(self, rows: DataFrame, carry: DataFrame, add: Callable[[DataFrame], DataFrame], columns: Sequence[str]) -> DataFrame:
        """``rows`` joined with one row per (key, slot), completed by ``add``; only ``columns`` are kept."""
        return add(rows.join(carry, [*self.keys, _SLICE], "left")).select(*columns)


def previous_value(
    df: DataFrame, keys: Sequence[str], value: Column, out: str,
    order: Sequence[str] = PACKET_ORDER, source: DataFrame | None = None, size: int = SLOT_ROWS, cut: Cut | None = None,
) -> DataFrame:
    """``lag(value)`` over each key in the given order. Rows with a NULL key or time get NULL."""
    source = df if source is None else source
    cut = cut or Cut(source, keys, order, size)
    inside = cut.inside().orderBy(*order)
    rows = cut.rows(df.withColumn("__value", value)).withColumns({out: F.lag("__value").over(inside), "__rn": F.row_number().over(inside)})
    tails = cut.cut_rows(source.withColumn("__value", value)).groupBy(*cut.keys, _SLICE).agg(F.max_by("__value", F.struct(*order)).alias("__tail"))
    carry = tails.withColumn("__carry", F.lag("__tail").over(cut.across())).drop("__tail")
    first = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col(out))
    return cut.carried(rows, carry, lambda r: r.withColumn(out, F.when(_present(cut.known), first)), [*df.columns, out])


def running_total(
    df: DataFrame, keys: Sequence[str], value: Column, out: str,
    order: Sequence[str] = PACKET_ORDER, source: DataFrame | None = None, size: int = SLOT_ROWS, cut: Cut | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` up to and including the row; no keys means over the whole table. Rows with a NULL key or time get NULL."""
    source = df if source is None else source
    cut = cut or Cut(source, keys, order, size)
    rows = cut.rows(df.withColumn("__value", value))
    rows = rows.withColumn(out, F.sum("__value").over(cut.inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = cut.across().rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.cut_rows(source.withColumn("__value", value)).groupBy(*cut.keys, _SLICE).agg(F.sum("__value").alias("__total"))
    carry = totals.withColumn("__carry", F.sum("__total").over(before)).drop("__total")
    total = F.when(_present(cut.known), F.col(out) + F.coalesce("__carry", F.lit(0)))
    return cut.carried(rows, carry, lambda r: r.withColumn(out, total), [*df.columns, out])


def forward_fill(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str],
    order: Sequence[str] = PACKET_ORDER, source: DataFrame | None = None, size: int = SLOT_ROWS, cut: Cut | None = None,
) -> DataFrame:
    """Replace NULLs by the key's last earlier non-NULL value. Rows with a NULL key or time stay as they are."""
    source = df if source is None else source
    cut = cut or Cut(source, keys, order, size)
    inside = cut.inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = cut.across().rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.rows(df).withColumns({f"__seen_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    place = F.struct(*order)
    tails = cut.cut_rows(source).groupBy(*cut.keys, _SLICE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__tail_{c}") for c in columns]
    )
    carry = tails.select(*cut.keys, _SLICE, *[F.last(f"__tail_{c}", ignorenulls=True).over(before).alias(f"__carry_{c}") for c in columns])
    filled = {c: F.when(_present(cut.known), F.coalesce(c, f"__seen_{c}", f"__carry_{c}")).otherwise(F.col(c)) for c in columns}
    return cut.carried(rows, carry, lambda r: r.withColumns(filled), df.columns)


def trailing_counts(
    df: DataFrame, keys: Sequence[str], column: str, spans_us: dict[str, int],
    ts: str = "timestamp", source: DataFrame | None = None, size: int = SLOT_ROWS,
) -> DataFrame:
    """For each span: non-NULL values of ``column`` in the same key within (time - span, time]; ties all count.

    A count is the difference of two running counts, at the row's time and one span earlier, so neither a dense nor a long span costs
    more than a thin or short one. Rows of one key and time are counted before anything is shuffled; each such instant leaves a mark
    one span earlier, and instants and marks are cut into slots like rows. Rows with a NULL key or time get NULL.
    """
    source = df if source is None else source
    us = F.unix_micros(ts)
    instants = source.select(*keys, us.alias("__t"), F.col(column).isNotNull().cast("long").alias("w")).where(_present([*keys, "__t"]))
    instants = instants.groupBy(*keys, "__t").agg(F.sum("w").alias("__w"))

    def entry(kind: int, at: Column, weight: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("__at_us"), weight.cast("long").alias("w"))

    marks = [entry(i, F.col("__t") - span, F.lit(0)) for i, span in enumerate(spans_us.values(), 1)]
    entries = instants.select(*keys, "__t", F.explode(F.array(entry(0, F.col("__t"), F.col("__w")), *marks)).alias("__e")).select(*keys, "__t", "__e.*")
    cut = Cut(entries, keys, ["__at_us"], size)
    running = cut.inside().orderBy("__at_us").rangeBetween(Window.unboundedPreceding, 0)
    totals = cut.cut_rows(entries).groupBy(*cut.keys, _SLICE).agg(F.sum("w").alias("__total"))
    carry = totals.withColumn("__carry", F.sum("__total").over(cut.across().rowsBetween(Window.unboundedPreceding, -1))).drop("__total")
    reached = cut.rows(entries).withColumn("__n", F.sum("w").over(running))
    reached = cut.carried(reached, carry, lambda r: r.withColumn("__n", F.col("__n") + F.coalesce("__carry", F.lit(0))), [*keys, "__t", "kind", "__n"])
    at = [F.max(F.when(F.col("kind") == i, F.col("__n"))) for i in range(len(spans_us) + 1)]
    # Rows that match nothing are spread by their hash.
    counts = reached.groupBy(*keys, "__t").agg(*[(at[0] - x).alias(name) for x, name in zip(at[1:], spans_us, strict=True)]).withColumn("__salt", F.lit(0).cast("long"))
    salt = F.when(_present([*keys, ts]), F.lit(0)).otherwise(F.xxhash64(*df.columns))
    return df.withColumns({"__t": us, "__salt": salt}).join(counts, [*keys, "__t", "__salt"], "left").select(*df.columns, *spans_us)


def next_within(
    df: DataFrame, keys: Sequence[str], is_target: Column, span_us: int, out: str,
    ts: str = "timestamp", order: Sequence[str] = PACKET_ORDER, source: DataFrame | None = None, size: int = SLOT_ROWS,
) -> DataFrame:
    """Time in microseconds of the first target row of the same key in [time, time + span], else NULL.

    A running minimum from the end of each slot finds the nearest target in it; of the slots before and after, the last and the first
    target come along. Nothing is copied, however long the span is. Rows with a NULL key or time get NULL.
    """
    source = df if source is None else source
    cut = Cut(source, keys, order, size)
    us = F.unix_micros(ts)
    target = F.when(is_target, us)
    ahead = cut.inside().orderBy(F.desc("__us")).rangeBetween(Window.unboundedPreceding, 0)
    rows = cut.rows(df.withColumns({"__us": us, "__target": target})).withColumn(out, F.min("__target").over(ahead))
    ends = cut.cut_rows(source.withColumn("__target", target)).groupBy(*cut.keys, _SLICE).agg(F.min("__target").alias("__low"), F.max("__target").alias("__high"))
    carry = ends.withColumns({
        "__before": F.max("__high").over(cut.across().rowsBetween(Window.unboundedPreceding, -1)),
        "__after": F.min("__low").over(cut.across().rowsBetween(1, Window.unboundedFollowing)),
    }).drop("__low", "__high")
    # Rows of one time may lie in several slots; all of them see each other.
    nearest = F.when(F.col("__before") == F.col("__us"), F.col("__us")).otherwise(F.coalesce(F.col(out), F.col("__after")))
    found = F.when(_present(cut.known) & (nearest - F.col("__us") <= span_us), nearest)
    return cut.carried(rows, carry, lambda r: r.withColumn(out, found), [*df.columns, out])


def gap_sessions(
    df: DataFrame, keys: Sequence[str], gap: str | int, out: str = "session_no",
    ts: str = "timestamp", order: Sequence[str] = PACKET_ORDER, source: DataFrame | None = None, size: int = SLOT_ROWS,
) -> DataFrame:
    """Number the activity bursts of each key: a new one starts after a silence of ``gap`` or more. Rows with a NULL key or time get NULL."""
    cut = Cut(df if source is None else source, keys, order, size)
    prev = previous_value(df, keys, F.unix_micros(ts), "__prev_us", order, source, cut=cut)
    starts = F.when(F.unix_micros(ts) - F.col("__prev_us") < width_us(gap), 0).otherwise(1)
    return running_total(prev, keys, starts, out, order, cut=cut).drop("__prev_us")


def attach_by_slot(
    df: DataFrame, features: DataFrame, keys: Sequence[str], slot: Column, source: DataFrame | None = None,
) -> DataFrame:
    """Left join of per-key ``features`` onto rows, shuffled on ``(key, slot)``; NULL keys match nothing.

    Only columns the rows do not have yet are added.

    The features are first joined to the distinct ``(key, slot)`` pairs, so a hot key is spread over as many
    tasks as it has slots.
    """
    features = features.select(*keys, *[c for c in features.columns if c not in df.columns])
    left = df.withColumn(_SLICE, F.coalesce(slot, F.lit(-1)))
    again = left if source is None else source.withColumn(_SLICE, F.coalesce(slot, F.lit(-1)))
    slots = again.select(*keys, _SLICE).where(_present(keys)).distinct()
    return (
        left.join(slots.join(features, list(keys)), [*keys, _SLICE], "left")
        .select(*df.columns, *[c for c in features.columns if c not in keys])
    )


def merge_back(
    df: DataFrame, features: DataFrame, keys: Sequence[str],
    width: str | int | None = DEFAULT_SLICE, ts: str = "timestamp", source: DataFrame | None = None,
) -> DataFrame:
    """Attach per-key features to rows, with the time slice as the slot.

    ``width=None`` joins on the keys alone: for keys that already hold a narrow time window.
    """
    if width is None:
        return df.join(features, list(keys), "left")
    return attach_by_slot(df, features, keys, floor_us(F.unix_micros(ts), width), source)
