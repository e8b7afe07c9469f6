"""Cleaning, quantiles, feature selection, score comparison."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import clean, compare, report
from packetloom.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def dirty(spark):
    """100 rows: 22 missing, 11 infinite, one constant column."""
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({f"feat_{i}": rng.normal(size=100) for i in range(5)})
    pdf["feat_with_missing"] = [None if i < 22 else float(i) for i in range(100)]
    pdf["feat_with_inf"] = [float("inf") if i < 11 else float(i) for i in range(100)]
    pdf["constant_feat"] = 5.0
    pdf["count_feat"] = np.arange(100)
    df = spark.createDataFrame(pdf)
    return df.withColumn("feat_with_missing", F.nanvl("feat_with_missing", F.lit(None)))


def test_cleaning_report(dirty):
    got = {r["metric"]: r["value"] for r in clean.cleaning_report(dirty).collect()}
    assert (got["rows_before"], got["columns_before"], got["columns_after"]) == ("100", "9", "8")
    assert (got["removed_columns"], got["infinite_values"]) == ("constant_feat", "11")
    assert (got["missing_before"], got["missing_after"]) == ("22", "0")


@pytest.mark.parametrize("small", [3, 50, 10**6])
def test_quantiles_by_narrowing_equal_numpy(spark, small):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(0, 5, 2000), "b": rng.integers(0, 4, 2000).astype(float), "c": np.r_[np.full(1990, 7.0), rng.normal(size=10)]})
    df = spark.createDataFrame(pdf).withColumn("d", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], probs, small=small)
    for c in "abc":
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], probs)), rel=1e-12)
    assert got["d"] == [None] * 6
    lower = exact_quantiles(df, ["a"], [0.1], method="lower", small=small)["a"][0]
    assert lower == np.percentile(pdf["a"], 10, method="lower")


def test_narrowing_copes_with_copies(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1.0).otherwise(F.col("id") * 1.0).alias("x"))
    assert exact_quantiles(df, ["x"], [0.25, 0.5], small=5)["x"] == [1.0, 1.0]


def test_infinities_are_values_at_any_size(spark):
    df = spark.range(51).select(F.when(F.col("id") == 50, float("inf")).otherwise(F.col("id") * 1.0).alias("x"), F.lit(float("-inf")).alias("y"))
    for small in (2, 7, 10_000):
        got = exact_quantiles(df, ["x", "y"], [0.0, 0.5, 1.0], small=small)
        assert got == {"x": [0.0, 25.0, float("inf")], "y": [float("-inf")] * 3}
    assert exact_quantiles(df, ["x"], [0.5, 0.5], method=["linear", "lower"])["x"] == [25.0, 25.0]


def test_align_features_fails_on_request(dirty):
    with pytest.raises(ValueError):
        clean.align_features(dirty, ["nope"], on_missing="error")
    assert clean.align_features(dirty, ["nope", "feat_with_inf"]).agg(F.sum("nope"), F.max("feat_with_inf")).first()[:] == (0.0, 99.0)


def test_numeric_only_leaves_out_booleans(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s")
    assert clean.numeric_columns(df) == ["i", "d"]


def test_feature_selection(spark):
    df = spark.range(200).selectExpr("id * 1.0 AS a", "id * 2.0 + 1 AS twin", "hash(id) % 1000 * 1.0 AS other", "1.0 AS flat")
    assert clean.select_features(df, ["a", "twin", "other", "flat"]) == ["a", "other"]


def test_drift_and_retraining(spark):
    low = spark.range(1000).selectExpr("id / 2000 AS score")
    high = spark.range(1000).selectExpr("0.5 + id / 2000 AS score")
    assert not compare.needs_retraining(compare.drift(low, low, 0, 1))
    assert compare.needs_retraining(compare.drift(low, high, 0, 1))


def test_prepare_time_from_numbers(spark):
    df = spark.sql("SELECT 1704110400.25D AS timestamp")
    assert str(clean.prepare_time(df).first()["timestamp"]) == "2024-01-01 12:00:00.250000"


def test_header_of_nothing(spark):
    empty = spark.createDataFrame([], "timestamp timestamp, anomaly int")
    row = report.report_header(empty, F.col("anomaly") == -1).first()
    assert (row["total_samples"], row["anomalies"], row["anomaly_ratio"]) == (0, 0, 0.0)


def test_sketches_of_small_windows_add_up(spark):
    from packetloom.operators import sketches

    df = spark.range(40_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 10 = 1 THEN 'b' ELSE 'a' END AS k", "timestamp_seconds(id) AS timestamp",
        "CASE WHEN id % 3 > 0 THEN pmod(id * 7919, 9000) END AS v", "id % 4 AS w",
    )
    small = sketches.distinct_sketches(df, ["k"], ["v", "w"], "1 minute")
    assert small.groupBy("k", "time_window").count().where("count > 1").count() == 0 and small.where("k IS NULL").count() == 0
    got = {(r["k"], r["width"], r["time_window"]): r for r in sketches.merged_sketches(small, ["k"], ["v", "w"], {"h": "1 hour", "d": "1 day"}).collect()}
    direct = df.where("k IS NOT NULL").groupBy("k", F.date_trunc("hour", "timestamp").alias("t")).agg(F.count_distinct("v").alias("v"), F.count_distinct("w").alias("w")).collect()
    assert len(got) == len(direct) + 2
    for r in direct:
        mine = got[r["k"], "h", r["t"]]
        assert abs(mine["v_distinct"] - r["v"]) <= 4 * sketches.deviation() * r["v"] and mine["w_distinct"] == r["w"]
    # Keys that are left out are merged as well.
    everything = sketches.merged_sketches(small, [], ["v"], {"d": "1 day"}).first()["v_distinct"]
    assert abs(everything - df.where("k IS NOT NULL").agg(F.count_distinct("v")).first()[0]) <= 4 * sketches.deviation() * everything
    assert sketches.merged_sketches(small.limit(0), ["k"], ["v"], {"d": "1 day"}).collect() == []
