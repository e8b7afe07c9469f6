"""Training and detection runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions.timing import floor_time
from packetloom.models import iforest, seqpca, triage
from packetloom.operators import profile, report, sequence
from packetloom.operators.clean import align_features, finite, impute_tcp_or_median
from packetloom.schema import MODEL_FEATURES, PACKET_ORDER
from packetloom.session import settled

MODES = ("isolation_forest", "lstm_autoencoder", "collaborative")


@dataclass
class Models:
    forest: iforest.IsolationForest
    sequences: seqpca.SequenceModel | None = None


def session_vectors(features: DataFrame, run: str | None = None) -> DataFrame:
    """One row per source (and run): its first packet with all features, the totals, and L3 comparison inputs."""
    keys = [F.col("src_ip").alias("client_ip")]
    if run:
        keys.append(floor_time(F.col("timestamp"), run).alias("run_start"))
    named = features.withColumns({
        "uri": F.col("http_request_uri") if "http_request_uri" in features.columns else F.lit(None).cast("string"),
        "user_agent": F.col("http_user_agent") if "http_user_agent" in features.columns else F.lit(None).cast("string"),
    })
    skip = {"total_bytes", "packets"}
    row = F.struct(*[c for c in named.columns if c not in skip])
    return named.where(F.col("src_ip").isNotNull()).groupBy(*keys).agg(
        F.min_by(row, F.struct(*PACKET_ORDER)).alias("r"), F.sum("frame_len").alias("total_bytes"), F.count(F.lit(1)).alias("packets"),
    ).select("client_ip", *(["run_start"] if run else []), "r.*", "total_bytes", "packets")


def hold_out(vectors: DataFrame, share: float = 0.2, row_key: Sequence[str] = ("client_ip", "frame_no"), min_samples: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows), split by a hash of the row, so a row always falls on the same side."""
    n = vectors.count()
    if n < min_samples:
        raise ValueError(f"{n} rows, at least {min_samples} are needed to train")
    held = F.pmod(F.xxhash64(*row_key), F.lit(10_000)) < int(share * 10_000)
    return vectors.where(~held), vectors.where(held)


def training_rows(vectors: DataFrame, features: Sequence[str], row_key: Sequence[str] = ("client_ip", "frame_no")) -> DataFrame:
    """What a forest is fitted on: the key and all features as numbers, absent and infinite ones missing, missing ones imputed."""
    columns = [finite(vectors, f).cast("double").alias(f) if f in vectors.columns else F.lit(None).cast("double").alias(f) for f in features]
    numbers = impute_tcp_or_median(vectors.select(F.struct(*row_key).alias("__key"), *columns))
    return numbers.select("__key.*", *features)


def train(
    vectors: DataFrame, features: Sequence[str] = MODEL_FEATURES, contamination: float | str = "auto",
    length: int | None = None, encoding_dim: int = 32, row_key: Sequence[str] = ("client_ip", "frame_no"), **forest_options,
) -> Models:
    """Fit the forest, and the sequence model when a sequence length is given."""
    clean = settled(training_rows(vectors, features, row_key))
    forest = iforest.fit(clean, features, row_key, contamination=contamination, **forest_options)
    if length is None:
        return Models(forest)
    ready = sequence.behaviour_sequences(align_features(vectors, features), "client_ip", features, length)
    return Models(forest, seqpca.fit(settled(ready.select("sequence")), length, encoding_dim))


def load_or_train(spark: SparkSession, path: str, vectors: DataFrame, **options) -> iforest.IsolationForest:
    """The saved forest below ``path``; trained on the current sessions and saved there when absent."""
    try:
        return iforest.IsolationForest.load(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    forest = train(vectors, **options).forest
    forest.save(spark, path)
    return forest


def detect(vectors: DataFrame, models: Models, mode: str = "collaborative", length: int | None = None, **thresholds) -> DataFrame:
    """Scores, verdict, severity and ``anomaly`` (-1 or 1) per session. Sequences are as long as the model's; another ``length`` is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    compared = profile.compare_with_history(vectors)
    scored = models.forest.score(compared)
    if mode == "isolation_forest":
        judged = scored.withColumns({"result_type": F.lit("isolation_forest"), "final_score": F.col("score")})
        return triage.with_severity(judged).withColumn("anomaly", F.when(F.col("decision") < 0, -1).otherwise(1))
    if models.sequences is None:
        raise ValueError(f"mode {mode!r} needs a sequence model")
    if length not in (None, models.sequences.length):
        raise ValueError(f"the sequence model takes sequences of {models.sequences.length}, not {length}")
    length = models.sequences.length
    features = models.forest.features
    # Sequences read their rows several times.
    scored = settled(scored)
    ready = sequence.behaviour_sequences(align_features(scored, features), "client_ip", features, length)
    sequences = models.sequences
    if mode == "lstm_autoencoder":
        limit = thresholds.get("sequence", triage.SEQUENCE_ANOMALY)
        judged = sequences.score(ready).drop("sequence").withColumns({"result_type": F.lit("lstm_autoencoder"), "final_score": F.col("seq_recon_mae")})
        return triage.with_severity(judged).withColumn("anomaly", F.when(F.col("final_score") > limit, -1).otherwise(1))
    judged = triage.collaborative(
        ready, lambda middle: middle.withColumn("seq_score", sequences.score_column()), **thresholds
    ).drop("sequence")
    return triage.with_severity(judged).withColumn("anomaly", F.when(F.col("result_type") == "normal", 1).otherwise(-1))


def report_tables(features: DataFrame, results: DataFrame, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the report."""
    sessions = results.select("client_ip", "timestamp", "frame_no", "uri", "user_agent", "total_bytes")
    anomalies = results.where(F.col("anomaly") == -1)
    local = report.local_host(features)
    shown = report.anomalies_to_show(results)
    history = profile.profile_totals(sessions), profile.profile_values(sessions)
    tables = {
        "header": report.report_header(results, F.col("anomaly") == -1),
        "protocols": report.protocol_counts(features),
        "top_sources": report.top_hosts(features, "src"),
        "top_destinations": report.top_hosts(features, "dst"),
        "local_host": local,
        "local_host_protocols": report.host_protocols(features, local),
        "local_host_peers_out": report.top_peers(features, local, "src"),
        "local_host_peers_in": report.top_peers(features, local, "dst"),
        "edges": report.top_edges(features),
        "explanation": report.anomaly_explanation(anomalies),
        "anomalies": shown,
        "anomaly_details": report.anomaly_details(shown, *history),
    }
    return {"summary": summary, **tables} if summary is not None else tables
