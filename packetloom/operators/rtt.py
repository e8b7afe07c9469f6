"""Round-trip times from handshakes and from acknowledgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.net import LOCAL_NETWORKS, flow_key, in_networks, reverse_flow_key
from packetloom.functions.timing import width_us
from packetloom.operators.guard import has_columns
from packetloom.operators.slices import DEFAULT_SLICE, SLOT_ROWS, merge_back, next_within

SYN, ACK = 0x02, 0x10
REQUIRED = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "tcp_seq", "tcp_ack"]


def with_flow_key(df: DataFrame) -> DataFrame:
    return df if "flow_key" in df.columns else df.withColumn("flow_key", flow_key())


def _within(ms: Column, timeout: str | int) -> Column:
    return F.when((ms > 0) & (ms < width_us(timeout) / 1000.0), ms)


def handshake_rtt(
    df: DataFrame, timeout: str | int = "60 seconds", local_networks: Sequence[str] = LOCAL_NETWORKS,
    match: str = "last", size: int = SLOT_ROWS,
) -> DataFrame:
    """``flow_key, rtt_ms``: local SYN to remote SYN-flagged answer, keyed by the client's direction.

    ``match='last'`` pairs the last of each, in one aggregation: both directions share the client's key.
    ``match='first_after'`` takes the first answer after each SYN and keeps the flow's smallest, with ``size`` rows in a slot of a busy flow.
    """
    local = in_networks("src_ip", local_networks)
    syn = (
        df.where((F.col("protocol") == "TCP") & (F.col("tcp_flags").bitwiseAND(SYN) != 0))
        .select("timestamp", "frame_no", local.alias("is_syn"), F.when(local, flow_key()).otherwise(reverse_flow_key()).alias("flow_key"))
        .where(F.col("flow_key").isNotNull())
    )
    us = F.unix_micros("timestamp")
    if match == "last":
        pairs = syn.groupBy("flow_key").agg(
            F.max(F.when(F.col("is_syn"), us)).alias("__syn"), F.max(F.when(~F.col("is_syn"), us)).alias("__reply")
        )
    elif match == "first_after":
        answered = next_within(syn, ["flow_key"], ~F.col("is_syn"), width_us(timeout), "__reply", size=size)
        pairs = answered.where("is_syn").withColumn("__syn", us)
    else:
        raise ValueError(f"unknown match: {match!r}")
    rtt = pairs.select("flow_key", _within((F.col("__reply") - F.col("__syn")) / 1000.0, timeout).alias("rtt_ms"))
    rtt = rtt.where(F.col("rtt_ms").isNotNull())
    return rtt if match == "last" else rtt.groupBy("flow_key").agg(F.min("rtt_ms").alias("rtt_ms"))


def with_ack_rtt(
    df: DataFrame, timeout: str | int = "60 seconds", direction: str = "same", source: DataFrame | None = None,
) -> DataFrame:
    """``rtt_ack_ms`` per packet: time to the last packet that acknowledges exactly its last byte.

    ``direction='same'`` looks inside the packet's own flow, ``'reverse'`` in the opposite one. One value per
    packet, so rows never multiply.
    """
    tcp = F.col("protocol") == "TCP"
    length = F.greatest(F.lit(1), F.coalesce(F.col("ip_len"), F.lit(0)) - 40)

    def expecting(rows: DataFrame) -> DataFrame:
        return with_flow_key(rows).withColumns({
            "__key": F.when(tcp, F.col("flow_key")), "__expected": F.when(tcp, F.col("tcp_seq") + length),
        })

    source = df if source is None else source
    acks = (
        with_flow_key(source).where(tcp & (F.col("tcp_flags").bitwiseAND(ACK) != 0))
        .withColumn("__key", F.col("flow_key") if direction == "same" else reverse_flow_key())
        .groupBy("__key", F.col("tcp_ack").alias("__expected"))
        .agg(F.max("timestamp").alias("__acked"))
    )
    # A key and a number hold few packets. Rows without them match nothing, so they are spread by their time.
    salt = F.when(F.col("__key").isNull() | F.col("__expected").isNull(), F.unix_micros("timestamp")).otherwise(F.lit(0))
    matched = expecting(df).withColumn("__salt", salt).join(acks.withColumn("__salt", F.lit(0).cast("long")), ["__key", "__expected", "__salt"], "left")
    ms = (F.unix_micros("__acked") - F.unix_micros("timestamp")) / 1000.0
    return matched.withColumn("rtt_ack_ms", _within(ms, timeout)).select(*with_flow_key(df).columns, "rtt_ack_ms")


def mean_of_present(a: Column, b: Column) -> Column:
    """Row mean that skips NULLs."""
    return F.coalesce((a + b) / 2, a, b)


def rtt_stats_of(acked: DataFrame, shakes: DataFrame, width: str | int = DEFAULT_SLICE) -> DataFrame:
    """RTT statistics per ``flow_key`` from packets that have their ``rtt_ack_ms`` and the handshakes of their flows."""
    narrow = with_flow_key(acked).select("timestamp", "frame_no", "flow_key", "rtt_ack_ms")
    samples = merge_back(narrow, shakes, ["flow_key"], width, source=narrow)
    return _stats(samples.withColumn("rtt_combined_ms", mean_of_present(F.col("rtt_ms"), F.col("rtt_ack_ms"))))


def _samples(df: DataFrame, timeout, local_networks, direction, width) -> DataFrame:
    """Packets with ``rtt_ack_ms``, plus each flow's handshake time as ``rtt_ms``."""
    shakes = handshake_rtt(df, timeout, local_networks)
    return merge_back(with_ack_rtt(df, timeout, direction), shakes, ["flow_key"], width, source=with_flow_key(df))


def rtt_table(
    df: DataFrame, timeout: str | int = "60 seconds", local_networks: Sequence[str] = LOCAL_NETWORKS,
    direction: str = "same", width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """RTT statistics per ``flow_key`` over the combined per-packet values."""
    samples = _samples(df, timeout, local_networks, direction, width)
    return _stats(samples.withColumn("rtt_combined_ms", mean_of_present(F.col("rtt_ms"), F.col("rtt_ack_ms"))))


def _stats(samples: DataFrame) -> DataFrame:
    value = "rtt_combined_ms"
    return samples.where(F.col("flow_key").isNotNull()).groupBy("flow_key").agg(
        F.avg(value).alias("avg_rtt_ms"), F.stddev_samp(value).alias("std_rtt_ms"), F.min(value).alias("min_rtt_ms"),
        F.max(value).alias("max_rtt_ms"), F.count(value).alias("rtt_sample_count"),
    )


def with_rtt_features(
    df: DataFrame, timeout: str | int = "60 seconds", local_networks: Sequence[str] = LOCAL_NETWORKS,
    direction: str = "same", width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """Per-packet RTTs and the flow's RTT statistics on every packet."""
    if not has_columns(df, REQUIRED, "with_rtt_features"):
        return df
    samples = _samples(df, timeout, local_networks, direction, width).withColumn(
        "rtt_combined_ms", mean_of_present(F.col("rtt_ms"), F.col("rtt_ack_ms"))
    )
    narrow = ["timestamp", "frame_no", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "tcp_seq",
              "tcp_ack", "ip_len"]
    stats = rtt_table(df.select(*[c for c in narrow if c in df.columns]), timeout, local_networks, direction, width)
    return merge_back(samples, stats, ["flow_key"], width, source=with_flow_key(df))
