"""Queries for model training, scoring and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.base import QUERIES, SLICE, STEPS, WINDOW, packets, query, table
from packetloom.catalog.clients import client_sessions
from packetloom.catalog.tables import SCORED_STEPS, scored
from packetloom.models import iforest, lof, ocsvm, seqpca, triage
from packetloom.operators import flow, host, profile, scalar, sequence
from packetloom.operators.clean import fill_zero
from packetloom.operators.compare import label_by_threshold
from packetloom.plans import detect
from packetloom.schema import MODEL_FEATURES
from packetloom.session import settled

_BAND = (0.7, 0.5, 0.6)

STEPS["triaged"] = """SELECT *, CASE WHEN score >= 0.7 THEN 'isolation_forest_high_risk'
      WHEN score >= 0.5 AND is_ready = 1 AND seq_score > 0.6 THEN 'lstm_sequence_anomaly' ELSE 'normal' END AS result_type,
    CASE WHEN score < 0.7 AND score >= 0.5 AND is_ready = 1 AND seq_score > 0.6 THEN seq_score ELSE score END AS final_score FROM scored"""


def _triaged(spark, sf):
    rows = scored(spark, sf)
    ready = sequence.behaviour_sequences(rows, "client_ip", ["total_bytes"], 5).drop("sequence", "seq_score")
    return triage.collaborative(ready, lambda middle: middle.withColumn("seq_score", (F.col("total_bytes") % 97) / 97.0), *_BAND)


@query("model_triage", "client_ip:s frame_no result_type:s final_score:f", "SELECT * FROM triaged", SCORED_STEPS + " triaged")
def _(spark, sf):
    return _triaged(spark, sf)


@query(
    "model_alert_severity", "client_ip:s frame_no severity:s reason:s",
    """SELECT client_ip, frame_no, CASE WHEN result_type = 'normal' THEN 'info' ELSE 'critical' END AS severity,
       CASE result_type WHEN 'normal' THEN 'Normal traffic'
         WHEN 'isolation_forest_high_risk' THEN 'Static feature anomaly detected by Isolation Forest'
         ELSE 'Behavioral sequence anomaly confirmed by the sequence model' END AS reason FROM triaged""",
    SCORED_STEPS + " triaged",
)
def _(spark, sf):
    return triage.with_severity(_triaged(spark, sf))


def training_rows(spark, sf):
    df = scalar.packet_features(packets(spark, sf))
    df = host.with_host_features(flow.with_flow_features(df, SLICE), WINDOW, SLICE)
    return settled(fill_zero(df.select("frame_no", "src_ip", *MODEL_FEATURES)))


def _forest(rows, **options):
    return iforest.fit(rows, MODEL_FEATURES, ["frame_no"], **options)


@query("model_iforest_nodes", "tree node feature threshold:f size depth")
def _(spark, sf):
    return spark.createDataFrame(_forest(training_rows(spark, sf)).nodes, iforest.NODES)


@query("model_iforest_scores", "frame_no src_ip:s anomaly_score:f score:f label")
def _(spark, sf):
    rows = training_rows(spark, sf)
    model = _forest(rows, contamination=0.1)
    return model.score(rows).withColumn("label", label_by_threshold("anomaly_score", model.offset))


@query("model_iforest_importances", "feature:s importance:f")
def _(spark, sf):
    return _forest(training_rows(spark, sf)).importances(spark)


@query("model_iforest_top_importances", "feature:s importance:f")
def _(spark, sf):
    return iforest.top_importances(_forest(training_rows(spark, sf)).importances(spark), 5)


@query(
    "model_iforest_metrics",
    "n_samples n_features contamination:f threshold:f num_anomalies anomaly_score_mean:f anomaly_score_std:f anomaly_score_median:f",
)
def _(spark, sf):
    rows = training_rows(spark, sf)
    return iforest.training_metrics(_forest(rows), rows)


# What SQL can say about a model: the properties every fitted one has.


@query(
    "model_iforest_trees", "tree root_size leaf_total two_way shallow",
    """SELECT t AS tree, least(256, n) AS root_size, least(256, n) AS leaf_total, 1 AS two_way, 1 AS shallow
       FROM range(100) AS r(t), (SELECT count(*) AS n FROM packets)""",
)
def _(spark, sf):
    nodes = spark.createDataFrame(_forest(training_rows(spark, sf)).nodes, iforest.NODES)
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root_size"), F.sum(F.when(leaf, F.col("size"))).alias("leaf_total"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).cast("int").alias("two_way"), (F.max("depth") <= 8).cast("int").alias("shallow"),
    )


@query(
    "model_iforest_score_bounds", "n in_range below_share at_share",
    "SELECT count(*) AS n, count(*) AS in_range, 1 AS below_share, 1 AS at_share FROM packets",
)
def _(spark, sf):
    rows = training_rows(spark, sf)
    model = _forest(rows, contamination=0.1)
    scores = model.score(rows).select("anomaly_score")
    below, at = F.count_if(F.col("anomaly_score") < model.offset), F.count_if(F.col("anomaly_score") <= model.offset)
    n = F.count(F.lit(1))
    # The offset is the quantile of the scores at the share asked for.
    return scores.agg(
        n.alias("n"), F.count_if(F.col("anomaly_score").between(-1.0, 0.0)).alias("in_range"),
        (below <= F.ceil((n - 1) * 0.1)).cast("int").alias("below_share"), (at >= F.floor((n - 1) * 0.1)).cast("int").alias("at_share"),
    )


@query("model_iforest_importance_total", "features used total:f", f"SELECT {len(MODEL_FEATURES)} AS features, {len(MODEL_FEATURES)} AS used, 1.0 AS total")
def _(spark, sf):
    shares = _forest(training_rows(spark, sf)).importances(spark)
    return shares.agg(F.count_distinct("feature").alias("features"), F.count_if(F.col("importance").between(0.0, 1.0)).alias("used"), F.sum("importance").alias("total"))


@query("model_one_class_share", "n below_share at_share", "SELECT count(*) AS n, 1 AS below_share, 1 AS at_share FROM embeddings", "")
def _(spark, sf):
    scored_rows = QUERIES["model_one_class"](spark, sf)
    n, flagged = F.count(F.lit(1)), F.count_if(F.col("label") == -1)
    return scored_rows.agg(n.alias("n"), (flagged <= F.ceil((n - 1) * 0.1) + 1).cast("int").alias("below_share"), (flagged >= F.floor((n - 1) * 0.1)).cast("int").alias("at_share"))


@query(
    "model_sequence_ready", "client_ip:s frame_no is_ready has_error",
    """SELECT client_ip, frame_no, (count(*) OVER w = 5)::INT AS is_ready, (count(*) OVER w = 5)::INT AS has_error
       FROM csessions WINDOW w AS (PARTITION BY client_ip ORDER BY timestamp, frame_no ROWS 4 PRECEDING)""", "packets csessions",
)
def _(spark, sf):
    rows = QUERIES["model_sequence_error"](spark, sf)
    return rows.withColumn("has_error", (F.col("seq_recon_mae") >= 0).cast("int")).fillna(0, subset=["has_error"])


_IMPUTED = ("tcp_seq", "tcp_ack", "dns_an_count", "http_response_code", "frame_len")


@query(
    "model_training_rows", "frame_no " + " ".join(f"{c}:f" for c in _IMPUTED),
    """SELECT frame_no, coalesce(tcp_seq, 0) AS tcp_seq, coalesce(tcp_ack, 0) AS tcp_ack, coalesce(dns_an_count, m1) AS dns_an_count,
       coalesce(http_response_code, m2) AS http_response_code, frame_len
       FROM packets, (SELECT quantile_cont(dns_an_count::DOUBLE, 0.5) AS m1, quantile_cont(http_response_code::DOUBLE, 0.5) AS m2 FROM packets)""",
)
def _(spark, sf):
    return detect.training_rows(packets(spark, sf), _IMPUTED, ["frame_no"])


# The factor in plain SQL: every pair of vectors, the k nearest, reachability, density.
_LOF = """SELECT vec_id AS id, avg(o.lrd) / any_value(l.lrd) AS lof, CASE WHEN avg(o.lrd) / any_value(l.lrd) > 1.5 THEN -1 ELSE 1 END AS label
    FROM near JOIN dense l ON near.vec_id = l.vec_id JOIN dense o ON near.other = o.vec_id GROUP BY near.vec_id"""
STEPS["near"] = """SELECT a.vec_id, b.vec_id AS other, list_distance(a.e, b.e) AS d
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b
    WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 20"""
STEPS["dense"] = """SELECT near.vec_id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near
    JOIN (SELECT vec_id AS other, max(d) AS kd FROM near GROUP BY 1) USING (other) GROUP BY near.vec_id"""


@query("model_lof", "id lof:f label", _LOF.replace("SELECT vec_id AS id", "SELECT near.vec_id AS id"), "near dense")
def _(spark, sf):
    return lof.local_outlier_factor(table(spark, sf, "embeddings"), "vec_id", "embedding")


_FAR = 100_000_000.0
for _name in ("near", "dense"):
    STEPS[f"{_name}_far"] = STEPS[_name].replace("CAST(embedding AS DOUBLE[])", f"[x + {_FAR} FOR x IN CAST(embedding AS DOUBLE[])]").replace("near", "near_far")


@query(
    "model_lof_shifted", "id lof:g label", _LOF.replace("SELECT vec_id AS id", "SELECT near_far.vec_id AS id").replace("JOIN dense", "JOIN dense_far")
    .replace("FROM near ", "FROM near_far ").replace(" near.", " near_far."), "near_far dense_far",
)
def _(spark, sf):
    moved = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + _FAR))
    return lof.local_outlier_factor(moved, "vec_id", "embedding")


@query("model_one_class", "id svm_score:f label")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    columns = [f"x{i}" for i in range(64)]
    rows = vectors.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return ocsvm.fit(rows, columns, nu=0.1, epochs=5).score(rows)


@query("model_sequence_error", "client_ip:s frame_no is_ready seq_recon_mae:f")
def _(spark, sf):
    rows = sequence.behaviour_sequences(client_sessions(spark, sf), "client_ip", ["total_bytes", "packets"], 5)
    return seqpca.fit(rows, 5, 4).score(rows)
