"""Properties of the models."""

import threading
import time
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.models import iforest, lof, ocsvm, seqpca, triage

FEATURES = [f"feat_{i}" for i in range(5)]


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 5))
    x[95:] += 10
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["id"] = np.arange(100)
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def forest(clusters):
    return iforest.fit(clusters, FEATURES, ["id"], contamination=0.1)


def _scores(model, df):
    return [r["anomaly_score"] for r in model.score(df).orderBy("id").select("anomaly_score").collect()]


def test_shifted_rows_score_as_more_anomalous(forest, clusters):
    scores = _scores(forest, clusters)
    assert max(scores[95:]) < np.mean(scores[:95])
    flagged = forest.score(clusters).where("decision < 0").count()
    assert flagged == 10


def test_same_forest_under_any_partitioning(forest, clusters):
    again = iforest.fit(clusters.repartition(7, "feat_0"), FEATURES, ["id"], contamination=0.1)
    pd.testing.assert_frame_equal(forest.nodes, again.nodes)


def test_save_and_load(spark, forest, clusters, tmp_path):
    forest.save(spark, str(tmp_path / "m"), iforest.training_metrics(forest, clusters))
    loaded = iforest.IsolationForest.load(spark, str(tmp_path / "m"))
    assert _scores(loaded, clusters) == _scores(forest, clusters) and loaded.offset == forest.offset
    assert {p.name for p in (tmp_path / "m").iterdir()} == {"nodes", "about", "importances", "metrics"}
    metrics = spark.read.json(str(tmp_path / "m" / "metrics")).first().asDict()
    assert metrics["n_samples"] == 100 and metrics["n_features"] == 5 and metrics["num_anomalies"] == 10
    assert {"anomaly_score_mean", "anomaly_score_std", "model_parameters"} <= set(metrics)


def test_importances(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"important": rng.normal(size=200) * 5, "noise1": rng.normal(size=200), "noise2": rng.normal(size=200), "id": np.arange(200)})
    model = iforest.fit(spark.createDataFrame(pdf), ["important", "noise1", "noise2"], ["id"])
    values = [r["importance"] for r in model.importances(spark).collect()]
    assert sum(values) == pytest.approx(1.0) and max(values) < 0.8 and min(values) > 0.1


def test_constant_data_grows_single_leaves(spark):
    df = spark.range(50).selectExpr("id", "1.0 AS x")
    model = iforest.fit(df, ["x"], ["id"], trees=5)
    assert (model.nodes["feature"] == -1).all()
    assert model.importances(spark).first()["importance"] == 1.0


def test_samples_are_exact_and_distinct(clusters):
    samples = iforest.draw_samples(clusters, FEATURES, ["id"], 100, 20, 32, 42)
    assert {r["n"] for r in samples.groupBy("tree").agg(F.count_distinct("x").alias("n")).collect()} == {32}


def test_scoring_restores_the_input_columns(forest, clusters):
    holes = clusters.withColumn("feat_0", F.when(F.col("id") > 3, F.col("feat_0"))).drop("feat_4")
    out = forest.score(holes)
    assert out.where("id <= 3 AND feat_0 IS NOT NULL").count() == 0 and "feat_4" not in out.columns
    with pytest.raises(ValueError):
        forest.score(holes, on_missing="error")


def _brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist[:, -1][near], dist).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("pivots, block", [(1, 10_000), (6, 16), (12, 7)])
def test_lof_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(80, 4)), rng.normal(size=(40, 4)) * 0.2 + 6, [[30.0] * 4]]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r for r in lof.local_outlier_factor(df, "id", "v", 10, pivots=pivots, block=block).collect()}
    assert [got[i]["lof"] for i in range(len(x))] == pytest.approx(list(_brute_lof(x, 10)), rel=1e-9)
    assert got[len(x) - 1]["label"] == -1


def test_lof_with_a_crowd_of_copies(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(60, 3)), np.tile([[2.0, 2.0, 2.0]], (40, 1)), [[9.0, 9.0, 9.0]]]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["lof"] for r in lof.local_outlier_factor(df, "id", "v", 8, pivots=5, block=9).collect()}
    expected = _brute_lof(x, 8)
    assert len(got) == 101
    assert [got[i] for i in range(101)] == pytest.approx(list(expected), rel=1e-6)


@contextmanager
def _most_on_disk(spark):
    """A list whose last number is the most bytes that lay in block files at once."""
    manager, seen, done = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            files = manager.getAllFiles()
            seen.append(max(seen[-1], sum(files.apply(i).length() for i in range(files.size()))))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield seen
    finally:
        done.set()
        watcher.join()


def test_lof_copies_no_vectors_per_pair_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").coalesce(2)
    with _most_on_disk(spark) as before:
        time.sleep(0.2)
    with _most_on_disk(spark) as seen:
        got = {r["id"]: r["lof"] for r in lof.local_outlier_factor(df, "id", "v", 5, pivots=4, block=32).collect()}
    # The points take 0.4 MB; a copy for each of 94 blocks takes 30 and more.
    assert seen[-1] - before[-1] < 4_000_000
    assert [got[i] for i in range(len(x))] == pytest.approx(list(_brute_lof(x, 5)), rel=1e-9)


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e8, 1.0), (0.0, 1e-30)])
def test_neighbours_at_equal_distances_are_taken_by_name(spark, shift, scale):
    # A grid, where very many points are equally far, and the same grid far off, so that one block spans both.
    grid = np.array([[i, j, l] for i in range(6) for j in range(6) for l in range(6)], float)
    x = np.r_[grid, grid + 1e7] * scale + shift
    names = np.random.default_rng(2).permutation(len(x))
    x = x[np.argsort(names)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    points, neighbours, k = lof.nearest(df, "id", "v", 7, pivots=3, block=300)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    expected = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert sorted((r["q"], r["s"], r["w"]) for r in neighbours.collect()) == sorted((i, int(s), 1) for i, row in enumerate(expected) for s in row)
    assert sorted((r["p"], tuple(r["v"]), r["w"]) for r in points.collect()) == [(i, tuple(row), 1) for i, row in enumerate(x.tolist())]


def test_lof_of_rows_without_a_name(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    ids = [None, None, *range(2, 50)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, v array<double>")
    got = lof.local_outlier_factor(df, "id", "v", 6, pivots=4, block=16).collect()
    assert sorted(r["lof"] for r in got) == pytest.approx(sorted(_brute_lof(x, 6)), rel=1e-9)
    assert sorted(str(r["id"]) for r in got) == sorted(map(str, ids))


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_a_vector_with_an_odd_number_has_no_factor_and_changes_no_other(spark, odd):
    x = np.random.default_rng(6).normal(size=(50, 3))
    df = spark.createDataFrame([*((i, [float(v) for v in row]) for i, row in enumerate(x)), (50, [odd, 0.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: (r["lof"], r["label"]) for r in lof.local_outlier_factor(df, "id", "v", 6, pivots=4, block=16).collect()}
    assert got.pop(50) == (None, 1) and [got[i][0] for i in range(50)] == pytest.approx(list(_brute_lof(x, 6)), rel=1e-9)


@pytest.mark.parametrize("block", [7, 100])
def test_rows_of_one_name_are_one_point_with_many_places(spark, block):
    rng = np.random.default_rng(6)
    x, k = rng.normal(size=(60, 3)), 6
    names = np.arange(60) // 3
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(names, x, strict=True)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [sorted((d[i, j], names[j]) for i in np.flatnonzero(names == n) for j in np.flatnonzero(names != n))[:k] for n in range(20)]
    lrd = np.array([1 / (np.mean([max(e, near[s][-1][0]) for e, s in row]) + 1e-10) for row in near])
    expected = np.array([np.mean([lrd[s] for _, s in row]) for row in near]) / lrd
    got = lof.local_outlier_factor(df, "id", "v", k, pivots=4, block=block).collect()
    assert len(got) == 60 and [r["lof"] for r in sorted(got, key=lambda r: r["id"])] == pytest.approx(list(np.repeat(expected, 3)), rel=1e-9)


def test_one_class_threshold_is_the_nu_quantile(spark, clusters):
    model = ocsvm.fit(clusters, FEATURES, nu=0.1, epochs=5, components=64)
    out = model.score(clusters)
    assert 9 <= out.where("label = -1").count() <= 10
    far = spark.createDataFrame([tuple([50.0] * 5)], ", ".join(f"{f} double" for f in FEATURES))
    inner = out.agg(F.expr("percentile(svm_score, 0.5)")).first()[0]
    assert model.score(far).first()["svm_score"] < inner


def test_sequence_error_is_larger_for_strange_sequences(spark):
    rng = np.random.default_rng(0)
    make = lambda shift: [[float(v) for v in row] for row in rng.uniform(size=(6, 3)) + shift]
    train = spark.createDataFrame([(make(0),) for _ in range(40)], "sequence array<array<double>>")
    model = seqpca.fit(train, 6, 4)
    test = spark.createDataFrame([(0, make(0)), (1, make(5)), (2, make(0)[:4])], "id int, sequence array<array<double>>")
    rows = {r["id"]: r["seq_recon_mae"] for r in model.score(test).collect()}
    assert rows[1] > rows[0] and rows[2] is None


def test_triage_runs_the_second_model_on_the_middle_band_only(spark):
    rows = [("a", 0, 1, 0.9, 1), ("b", 0, 2, 0.65, 1), ("c", 0, 3, 0.65, 0), ("d", 0, 4, 0.1, 1), ("e", 0, 5, 0.7, 1)]
    df = spark.createDataFrame(rows, "client_ip string, timestamp int, frame_no int, score double, is_ready int")
    seen = []

    def second(middle):
        seen.extend(r["client_ip"] for r in middle.collect())
        return middle.withColumn("seq_score", F.when(F.col("client_ip") == "b", 0.95).otherwise(0.2))

    out = {r["client_ip"]: r for r in triage.with_severity(triage.collaborative(df, second)).collect()}
    assert sorted(seen) == ["b", "e"]
    assert out["a"]["result_type"] == "isolation_forest_high_risk" and out["a"]["severity"] == "critical"
    assert (out["b"]["result_type"], out["b"]["final_score"]) == ("lstm_sequence_anomaly", 0.95)
    assert [out[c]["result_type"] for c in "cde"] == ["normal"] * 3
