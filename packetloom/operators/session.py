"""Bidirectional sessions, rolled up from the flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.net import LOCAL_NETWORKS, direction, session_key
from packetloom.functions.timing import seconds_between
from packetloom.operators.flow import complete_flows
from packetloom.operators.guard import has_columns
from packetloom.operators.scalar import EPS
from packetloom.operators.slices import DEFAULT_SLICE, merge_back
from packetloom.schema import FLOW_KEY, PACKET_ORDER

SMALL_PACKET = 64


def with_session_key(df: DataFrame, local_networks: Sequence[str] = LOCAL_NETWORKS) -> DataFrame:
    """Drop rows without a complete 5-tuple, then add ``session_key`` and ``direction``."""
    return complete_flows(df).withColumns({"session_key": session_key(), "direction": direction(local_networks)})


def session_table(
    df: DataFrame, local_networks: Sequence[str] = LOCAL_NETWORKS,
    small_packet: int = SMALL_PACKET, distinct_flows: bool = False,
) -> DataFrame:
    """One row per session. Packets collapse to flows first; sessions then read the small flow table.

    Active time adds up the flow duration once per packet, so it can exceed the duration of the session;
    ``distinct_flows=True`` adds it once per flow.
    """
    if not has_columns(df, ["timestamp", *FLOW_KEY, "frame_len"], "session_table"):
        return df
    size = F.col("frame_len").cast("decimal(38,0)")
    flows = complete_flows(df).groupBy(*FLOW_KEY).agg(
        F.count("frame_len").alias("n"),
        F.sum("frame_len").alias("bytes"),
        F.sum(size * size).alias("squares"),
        F.sum(F.when(F.col("frame_len") < small_packet, 1).otherwise(0)).alias("small"),
        F.min(F.struct(*PACKET_ORDER)).alias("head"),
        F.max("timestamp").alias("last"),
        F.count(F.lit(1)).alias("rows"),
    )
    flows = with_session_key(flows, local_networks).withColumn(
        "duration", seconds_between(F.col("last"), F.col("head.timestamp"))
    )
    active = F.col("duration") if distinct_flows else F.col("duration") * F.col("rows")

    def side(which: str, column: str) -> Column:
        return F.sum(F.when(F.col("direction") == which, F.col(column)).otherwise(0))

    sessions = flows.groupBy("session_key").agg(
        *[F.min_by(c, "head").alias(f"{c}_first") for c in FLOW_KEY],
        F.sum("n").alias("total_packets"),
        F.sum("bytes").alias("total_bytes"),
        F.sum("squares").alias("__squares"),
        F.max("duration").alias("session_duration"),
        F.min("head.timestamp").alias("session_start"),
        F.max("last").alias("session_end"),
        side("inbound", "n").alias("inbound_frame_len_count"),
        side("inbound", "bytes").alias("inbound_frame_len_sum"),
        side("outbound", "n").alias("outbound_frame_len_count"),
        side("outbound", "bytes").alias("outbound_frame_len_sum"),
        F.sum("small").alias("small_packet_count"),
        F.sum(active).alias("session_active_time"),
    )
    return sessions.withColumns(_ratios()).drop("__squares")


def _ratios() -> dict[str, Column]:
    n, total = F.col("total_packets"), F.col("total_bytes")
    duration, active = F.col("session_duration"), F.col("session_active_time")
    eps = F.lit(EPS)
    # Whole numbers keep the spread exact: equal sizes give exactly 0.
    spread = F.col("__squares") * n.cast("decimal(20,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    return {
        "avg_packet_size": F.try_divide(total, n),
        "std_packet_size": F.when(n > 1, F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1)))),
        "session_bytes_ratio": F.col("outbound_frame_len_sum") / (F.col("inbound_frame_len_sum") + eps),
        "session_packets_ratio": F.col("outbound_frame_len_count") / (F.col("inbound_frame_len_count") + eps),
        "small_packet_ratio": F.try_divide(F.col("small_packet_count"), n),
        "session_idle_time": duration - active,
        "active_idle_ratio": active / (duration - active + eps),
        "packets_per_second": n / (duration + eps),
        "bytes_per_second": total / (duration + eps),
    }


def session_flag_histogram(df: DataFrame, local_networks: Sequence[str] = LOCAL_NETWORKS) -> DataFrame:
    """``tcp_flags`` -> count per session and direction, as a map (at most one entry per flag value)."""
    counts = (
        with_session_key(df, local_networks).where(F.col("tcp_flags").isNotNull())
        .groupBy("session_key", "direction", "tcp_flags").agg(F.count(F.lit(1)).alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct("tcp_flags", "n")))
    return counts.groupBy("session_key", "direction").agg(F.map_from_entries(entries).alias("tcp_flags"))


def with_session_features(
    df: DataFrame, width: str | int = DEFAULT_SLICE, local_networks: Sequence[str] = LOCAL_NETWORKS, **options,
) -> DataFrame:
    """Session statistics on every packet that has a complete 5-tuple; other rows are dropped."""
    if not has_columns(df, ["timestamp", *FLOW_KEY, "frame_len"], "with_session_features"):
        return df
    sessions = session_table(df, local_networks, **options)
    return merge_back(with_session_key(df, local_networks), sessions, ["session_key"], width)


def initiator_counts(df: DataFrame) -> DataFrame:
    """Packets sent by the side that spoke first, and by the other, per session."""
    heads = complete_flows(df).groupBy(*FLOW_KEY).agg(
        F.min(F.struct(*PACKET_ORDER)).alias("head"), F.count(F.lit(1)).alias("n")
    )
    endpoint = F.struct("src_ip", "src_port")
    sides = heads.withColumn("session_key", session_key()).groupBy("session_key", endpoint.alias("e")).agg(
        F.min("head").alias("head"), F.sum("n").alias("n")
    )
    return sides.groupBy("session_key").agg(
        F.min_by("n", "head").alias("flow_fwd_pkt_count"),
        F.sum("n").alias("__all"),
    ).select("session_key", "flow_fwd_pkt_count", (F.col("__all") - F.col("flow_fwd_pkt_count")).alias("flow_bwd_pkt_count"))
