"""Unidirectional flows: one row per 5-tuple, and their features on each packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.timing import seconds_between
from packetloom.operators.guard import has_columns
from packetloom.operators.scalar import EPS, flag
from packetloom.operators.slices import DEFAULT_SLICE, merge_back, previous_value
from packetloom.schema import FLOW_KEY, PACKET_ORDER

REQUIRED = ["timestamp", *FLOW_KEY, "frame_len"]
HTTP_CLASSES = ("http_rsp_success", "http_rsp_redirect", "http_rsp_client_error", "http_rsp_server_error")


def complete_flows(df: DataFrame) -> DataFrame:
    """Packets with every part of the 5-tuple; the others belong to no flow."""
    return df.na.drop(subset=list(FLOW_KEY))


def _gap_us(df: DataFrame) -> DataFrame:
    us = F.unix_micros("timestamp")
    prev = previous_value(df, FLOW_KEY, us, "__prev")
    return prev.withColumn("__gap_us", F.coalesce(us - F.col("__prev"), F.lit(0))).drop("__prev")


def flow_gaps(df: DataFrame, out: str = "inter_arrival_time") -> DataFrame:
    """Seconds since the previous packet of the same flow; 0 for the first one."""
    return _gap_us(df).withColumn(out, F.col("__gap_us") / 1e6).drop("__gap_us")


def flow_table(df: DataFrame) -> DataFrame:
    """Counts, sizes, times, gaps and rates per 5-tuple.

    The group-by is on the bare 5-tuple: partial aggregation shrinks a hot flow to one row per task first.
    """
    classes = [c for c in HTTP_CLASSES if c in df.columns]
    packets = complete_flows(df).select(*FLOW_KEY, *PACKET_ORDER, "frame_len", *classes)
    flows = _gap_us(packets).groupBy(*FLOW_KEY).agg(
        F.count("frame_len").alias("flow_pkt_count"),
        F.sum("frame_len").alias("flow_byte_count"),
        F.avg("frame_len").alias("flow_mean_pkt_size"),
        F.stddev_samp("frame_len").alias("flow_std_pkt_size"),
        F.min("timestamp").alias("flow_start_time"),
        F.max("timestamp").alias("flow_end_time"),
        (F.avg("__gap_us") / 1e6).alias("flow_inter_arrival_time_mean"),
        (F.stddev_samp("__gap_us") / 1e6).alias("flow_inter_arrival_time_stddev"),
        (F.max("__gap_us") / 1e6).alias("flow_inter_arrival_time_max"),
        *[F.sum(c).alias(f"{c}_sum") for c in classes],
    )
    return flows.withColumn(
        "flow_duration_seconds", seconds_between(F.col("flow_end_time"), F.col("flow_start_time"))
    ).withColumns(flow_rates())


def flow_rates() -> dict[str, Column]:
    count, size, duration = F.col("flow_pkt_count"), F.col("flow_byte_count"), F.col("flow_duration_seconds")
    return {
        "flow_pkts_per_sec": count / (duration + F.lit(EPS)),
        "flow_bytes_per_sec": size / (duration + F.lit(EPS)),
        "flow_bytes_per_packet": F.try_divide(size, count),
        "flow_is_short": flag(duration < 1.0),
        "flow_is_long": flag(duration > 300.0),
        "flow_is_single_packet": flag(count == 1),
        "flow_pkt_size_variance": F.col("flow_std_pkt_size") * F.col("flow_std_pkt_size"),
        "flow_pkt_size_cv": F.col("flow_std_pkt_size") / (F.col("flow_mean_pkt_size") + F.lit(EPS)),
    }


def with_flow_features(df: DataFrame, width: str | int = DEFAULT_SLICE, flows: DataFrame | None = None) -> DataFrame:
    """Flow features on every packet of the flow. Does nothing when they are there already."""
    if "flow_pkt_count" in df.columns or not has_columns(df, REQUIRED, "with_flow_features"):
        return df
    return merge_back(df, flow_table(df) if flows is None else flows, FLOW_KEY, width)


def slow_connections(flows: DataFrame, min_seconds: float, max_packets: int, max_bytes: int) -> DataFrame:
    """Flows that stay open very long while carrying almost nothing."""
    return flows.where(
        (F.col("flow_duration_seconds") >= min_seconds)
        & (F.col("flow_pkt_count") <= max_packets)
        & (F.col("flow_byte_count") <= max_bytes)
    )
