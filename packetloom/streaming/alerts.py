"""Scoring a stream of sessions into an alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.models.iforest import IsolationForest
from packetloom.models.triage import HIGH_RISK, SUSPICIOUS, with_severity


def judged(sessions: DataFrame, model: IsolationForest, high: float = HIGH_RISK, suspicious: float = SUSPICIOUS) -> DataFrame:
    """Score and verdict per session; the same code serves batch and stream."""
    scored = model.score(sessions)
    kind = F.when(F.col("score") >= high, "isolation_forest_high_risk").when(F.col("score") >= suspicious, "isolation_forest").otherwise("normal")
    return with_severity(scored.withColumn("result_type", kind))


def write_alerts(
    sessions: DataFrame, model: IsolationForest, path: str, checkpoint: str, high: float = HIGH_RISK,
    suspicious: float = SUSPICIOUS, available_now: bool = True,
) -> StreamingQuery:
    """Start the query. Each batch writes its own folder and overwrites it on a retry, so no alert is doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        alerts = judged(batch, model, high, suspicious).where(F.col("result_type") != "normal")
        alerts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
