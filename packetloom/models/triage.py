"""From scores to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Default thresholds (fixed values).
HIGH_RISK, SUSPICIOUS, SEQUENCE_ANOMALY = 0.75, 0.6, 0.8

SESSION_ID = ("client_ip", "timestamp", "frame_no")

# Verdict -> severity and reason (fixed values).
SEVERITIES = {
    "isolation_forest_high_risk": ("critical", "Static feature anomaly detected by Isolation Forest"),
    "lstm_sequence_anomaly": ("critical", "Behavioral sequence anomaly confirmed by the sequence model"),
    "normal": ("info", "Normal traffic"),
    "isolation_forest": ("warning", "Anomaly detected by a single model"),
    "lstm_autoencoder": ("warning", "Anomaly detected by a single model"),
}


def verdict(
    high: float = HIGH_RISK, suspicious: float = SUSPICIOUS, sequence: float = SEQUENCE_ANOMALY,
    score: str = "score", seq_score: str = "seq_score", ready: str = "is_ready",
) -> dict[str, Column]:
    """``result_type`` and ``final_score``: high risk by score; in the middle band the sequence model decides."""
    confirmed = (F.col(score) >= suspicious) & (F.col(ready) == 1) & (F.col(seq_score) > sequence)
    return {
        "result_type": F.when(F.col(score) >= high, "isolation_forest_high_risk").when(confirmed, "lstm_sequence_anomaly").otherwise("normal"),
        "final_score": F.when((F.col(score) < high) & confirmed, F.col(seq_score)).otherwise(F.col(score)),
    }


def collaborative(
    scored: DataFrame, score_sequences: Callable[[DataFrame], DataFrame], high: float = HIGH_RISK,
    suspicious: float = SUSPICIOUS, sequence: float = SEQUENCE_ANOMALY, session_id: Sequence[str] = SESSION_ID,
) -> DataFrame:
    """Cheap model first: only ready sessions of the middle band reach ``score_sequences``.

    ``score_sequences`` adds ``seq_score`` to the rows it gets. The filter stands before the model and its
    result is joined back by session, so the model cannot run on the rest.
    """
    middle = scored.where((F.col("score") >= suspicious) & (F.col("score") < high) & (F.col("is_ready") == 1))
    looked = score_sequences(middle).select(*session_id, "seq_score")
    return scored.join(looked, list(session_id), "left").withColumns(verdict(high, suspicious, sequence))


def with_severity(df: DataFrame, column: str = "result_type") -> DataFrame:
    """Alert severity and reason for each verdict; unknown ones are 'info'."""
    severity, reason = F.lit("info"), F.concat(F.lit("Detection result: "), F.coalesce(column, F.lit("none")))
    for name, (level, text) in SEVERITIES.items():
        severity = F.when(F.col(column) == name, level).otherwise(severity)
        reason = F.when(F.col(column) == name, text).otherwise(reason)
    return df.withColumns({"severity": severity, "reason": reason})
