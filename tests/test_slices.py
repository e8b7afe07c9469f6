"""Sliced operators give what one plain window per key gives, for slots of any size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from packetloom.operators import slices


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({
        "frame_no": np.arange(n),
        # One key holds most rows; equal times occur.
        "key": rng.choice(["hot", "a", "b"], n, p=[0.8, 0.1, 0.1]),
        "us": rng.integers(0, 200, n) * 500_000,
        "value": rng.integers(0, 50, n),
    })
    df = spark.createDataFrame(pdf).selectExpr(
        "frame_no", "CASE WHEN frame_no % 40 = 0 THEN NULL ELSE key END AS key", "timestamp_micros(us) AS timestamp",
        "CASE WHEN frame_no % 3 = 0 THEN NULL ELSE value END AS value",
    )
    return df.persist()


def _same(a, b):
    order = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=str)
    assert order(a) == order(b)


def by_key():
    return Window.partitionBy("key").orderBy("timestamp", "frame_no")


def keyed(value):
    return F.when(F.col("key").isNotNull() & F.col("timestamp").isNotNull(), value)


SIZES = [7, 60, 1 << 20]


@pytest.mark.parametrize("size", SIZES)
def test_previous_value(rows, size):
    expected = rows.withColumn("p", keyed(F.lag("frame_no").over(by_key())))
    _same(slices.previous_value(rows, ["key"], F.col("frame_no"), "p", size=size), expected)


@pytest.mark.parametrize("size", SIZES)
def test_running_total(rows, size):
    expected = rows.withColumn("t", keyed(F.sum(F.lit(1)).over(by_key())))
    _same(slices.running_total(rows, ["key"], F.lit(1), "t", size=size), expected)
    everything = rows.withColumn("t", F.row_number().over(Window.orderBy("timestamp", "frame_no")).cast("long"))
    _same(slices.running_total(rows, [], F.lit(1), "t", size=size), everything)


@pytest.mark.parametrize("size", SIZES)
def test_forward_fill(rows, size):
    filled = F.last("value", ignorenulls=True).over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    expected = rows.withColumn("value", F.coalesce(keyed(filled), F.col("value")))
    _same(slices.forward_fill(rows, ["key"], ["value"], size=size), expected)


@pytest.mark.parametrize("size", SIZES)
def test_trailing_count(rows, size):
    def count(span):
        frame = Window.partitionBy("key").orderBy(F.unix_micros("timestamp")).rangeBetween(1 - span, 0)
        return keyed(F.count("value").over(frame))

    spans = {"c": 3_000_000, "d": 500_000, "e": 11_000_000, "f": 40 * 86_400_000_000}
    expected = rows.withColumns({name: count(span) for name, span in spans.items()})
    _same(slices.trailing_counts(rows, ["key"], "value", spans, size=size), expected)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("span", [0, 4_000_000, 40 * 86_400_000_000])
def test_next_within(rows, size, span):
    us = F.unix_micros("timestamp")
    frame = Window.partitionBy("key").orderBy(us).rangeBetween(0, span)
    target = F.col("value") > 40
    nearest = keyed(F.min(F.when(target, us)).over(frame))
    marked = rows.withColumn("hit", F.coalesce(target, F.lit(False)))
    _same(slices.next_within(marked, ["key"], F.col("hit"), span, "n", size=size), marked.withColumn("n", nearest))


def test_merge_back_keeps_every_row(rows):
    totals = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    _same(slices.merge_back(rows, totals, ["key"], "5 seconds"), rows.join(totals, "key", "left"))


@pytest.fixture(scope="module")
def crowded(spark):
    """Nine tenths of the rows on one source; a third of all in one minute, a fifth in one instant, a tenth without a key."""
    place = "CASE WHEN id % 3 = 0 THEN 86400000000 + id * 5000 WHEN id % 5 = 0 THEN 7200000000 ELSE id * 9000000 END"
    key = "CASE WHEN id % 10 = 1 THEN NULL WHEN id % 20 = 2 THEN 'cold' ELSE 'hot' END"
    return spark.range(12_000).selectExpr("id AS frame_no", f"{key} AS key", f"timestamp_micros({place}) AS timestamp", "CAST(id % 7 AS INT) AS value").persist()


@pytest.mark.parametrize("size", [100, 1000])
def test_no_group_is_larger_than_a_slot(crowded, size):
    cut = slices.Cut(crowded, ["key"], size=size)
    groups = cut.rows(crowded).groupBy("key", "__slice").count()
    assert groups.agg(F.max("count")).first()[0] <= size
    assert groups.where("key = 'hot'").count() < 8 * 12_000 / size
    assert groups.where("key IS NULL").agg(F.max("count")).first()[0] < 10
    # Within a key, slots follow the order of the rows.
    bounds = cut.rows(crowded).where("key IS NOT NULL").groupBy("key", "__slice").agg(F.min(F.struct("timestamp", "frame_no")).alias("low"), F.max(F.struct("timestamp", "frame_no")).alias("high"))
    after = F.lead("low").over(Window.partitionBy("key").orderBy("__slice"))
    assert bounds.withColumn("after", after).where("after <= high").count() == 0


def test_small_keys_are_not_cut(rows):
    cut = slices.Cut(rows, ["key"])
    assert cut.edges.count() == 0 and cut.rows(rows).where("key IS NOT NULL").select("__slice").distinct().collect() == [(0,)]


def test_crowded_keys_give_the_same_at_any_size(crowded):
    def numbers(size):
        out = slices.previous_value(crowded, ["key"], F.col("frame_no"), "p", size=size)
        out = slices.trailing_counts(out, ["key"], "value", {"minute": 60_000_000, "day": 86_400_000_000}, source=crowded, size=size)
        return slices.gap_sessions(out, ["key"], "20 seconds", source=crowded, size=size)

    _same(numbers(300), numbers(1 << 20))


@pytest.mark.parametrize("size", SIZES)
def test_gap_sessions(rows, size):
    got = slices.gap_sessions(rows, ["key"], "2 seconds", size=size)
    us = F.unix_micros("timestamp")
    starts = F.when(us - F.lag(us).over(by_key()) < 2_000_000, 0).otherwise(1)
    expected = rows.withColumn("s", starts).withColumn("session_no", keyed(F.sum("s").over(by_key()))).drop("s")
    _same(got, expected)
