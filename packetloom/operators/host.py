"""Host behaviour in tumbling time windows, and per-packet time features of a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.entropy import count_entropy
from packetloom.functions.timing import floor_time, seconds_between, width_us
from packetloom.operators import slices
from packetloom.operators.guard import has_columns
from packetloom.operators.slices import (
    DEFAULT_SLICE, forward_fill, gap_sessions, merge_back, previous_value,
)

REQUIRED = ["timestamp", "src_ip", "dst_ip", "frame_len"]
DEFAULT_WINDOW = "1 second"


def _windowed(df: DataFrame, ip: str, window: str) -> DataFrame:
    return (
        df.where(F.col(ip).isNotNull() & F.col("timestamp").isNotNull())
        .withColumn("time_window", floor_time(F.col("timestamp"), window))
    )


def _distinct(column: str, rsd: float | None) -> Column:
    """Exact distinct count, or its sketch with the given relative error."""
    return F.count_distinct(column) if rsd is None else F.approx_count_distinct(column, rsd)


def grouped_entropy(df: DataFrame, keys: Sequence[str], column: str, entropy: str, distinct: str) -> DataFrame:
    """Entropy and number of the distinct values of a column per group; two levels, never a list of values."""
    counts = df.groupBy(*keys, column).agg(F.count(column).alias("__n"))
    present = F.when(F.col("__n") > 0, F.col("__n"))
    return counts.groupBy(*keys).agg(count_entropy(present).alias(entropy), F.count(present).alias(distinct))


def src_host_windows(df: DataFrame, window: str = DEFAULT_WINDOW, rsd: float | None = None) -> DataFrame:
    packets = _windowed(df, "src_ip", window)
    keys = ["src_ip", "time_window"]
    aggs = [
        F.count("frame_len").alias("src_host_pkt_count_win"),
        F.sum("frame_len").alias("src_host_byte_count_win"),
        _distinct("dst_ip", rsd).alias("src_host_distinct_dst_ips_win"),
    ]
    for column, short in (("dns_qry_name_len", "dns_qry_len"), ("dns_qry_name_entropy", "dns_qry_entropy")):
        if column in df.columns:
            aggs.append(F.avg(column).alias(f"src_host_{short}_mean_win"))
            aggs.append(F.stddev_samp(column).alias(f"src_host_{short}_std_win"))
    if "tls_ja3" in df.columns:
        aggs.append(_distinct("tls_ja3", rsd).alias("src_host_distinct_ja3_win"))
    hosts = packets.groupBy(*keys).agg(*aggs)
    if "dst_port" in df.columns:
        ports = grouped_entropy(
            packets, keys, "dst_port", "src_host_dst_port_entropy_win", "src_host_distinct_dst_ports_win"
        )
        hosts = hosts.join(ports, keys)
    return _frequency_change(hosts)


def _frequency_change(hosts: DataFrame) -> DataFrame:
    """Change in distinct peers against the source's previous observed window; 0 for the first.

    A source that is seen in very many windows is cut like any other busy key.
    """
    peers = F.col("src_host_distinct_dst_ips_win")
    before = previous_value(hosts, ["src_ip"], peers, "__before", order=["time_window"])
    return before.withColumn("src_host_session_freq_change_win", F.coalesce(peers - F.col("__before"), F.lit(0))).drop("__before")


def dst_host_windows(df: DataFrame, window: str = DEFAULT_WINDOW, rsd: float | None = None) -> DataFrame:
    return _windowed(df, "dst_ip", window).groupBy("dst_ip", "time_window").agg(
        F.count("frame_len").alias("dst_host_pkt_count_win"),
        F.sum("frame_len").alias("dst_host_byte_count_win"),
        _distinct("src_ip", rsd).alias("dst_host_distinct_src_ips_win"),
    )


def _attach(df: DataFrame, hosts: DataFrame, ip: str, window: str, width: str | int, source: DataFrame) -> DataFrame:
    narrow = width_us(window) <= width_us(width)
    marked, again = (d.withColumn("time_window", floor_time(F.col("timestamp"), window)) for d in (df, source))
    return merge_back(marked, hosts, [ip, "time_window"], None if narrow else width, source=again).drop("time_window")


def with_host_features(
    df: DataFrame, window: str = DEFAULT_WINDOW, width: str | int = DEFAULT_SLICE, fill: str = "zero",
    source: DataFrame | None = None,
) -> DataFrame:
    """Source and destination window features on every packet.

    ``fill='zero'`` sets what has no host to 0; ``fill='forward'`` first carries the last value of the
    same source forward.
    """
    if not has_columns(df, REQUIRED, "with_host_features"):
        return df
    source = df if source is None else source
    src, dst = src_host_windows(source, window), dst_host_windows(source, window)
    out = _attach(_attach(df, src, "src_ip", window, width, source), dst, "dst_ip", window, width, source)
    added = [c for c in out.columns if c not in df.columns]
    if fill == "forward":
        out = forward_fill(out, ["src_ip"], added)
    return out.na.fill(0, subset=added)


def with_pair_gaps(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``inter_arrival_time``: seconds since the previous packet of the same (src, dst); NULL for the first."""
    prev = previous_value(df, ["src_ip", "dst_ip"], F.col("timestamp"), "__prev", source=source)
    return prev.withColumn("inter_arrival_time", seconds_between(F.col("timestamp"), F.col("__prev"))).drop("__prev")


def trailing_counts(df: DataFrame, windows: dict[str, str], key: str = "src_ip", source: DataFrame | None = None) -> DataFrame:
    """Packets of the same source in (t - w, t] for several widths; equal times count each other."""
    return slices.trailing_counts(df, [key], "frame_len", {name: width_us(w) for name, w in windows.items()}, source=source)


def sliding_src_windows(df: DataFrame, window: str, slide: str) -> DataFrame:
    """Counts per source in overlapping windows."""
    return (
        df.where(F.col("src_ip").isNotNull())
        .groupBy("src_ip", F.window("timestamp", window, slide).alias("w"))
        .agg(F.count("frame_len").alias("pkt_count"), F.sum("frame_len").alias("byte_count"))
        .select("src_ip", F.col("w.start").alias("window_start"), "pkt_count", "byte_count")
    )


def activity_bursts(df: DataFrame, gap: str, key: str = "src_ip") -> DataFrame:
    """What ``F.session_window(timestamp, gap)`` gives per source, without sorting a source in one task."""
    numbered = gap_sessions(df, [key], gap, "__burst").where(F.col("__burst").isNotNull())
    return numbered.groupBy(key, "__burst").agg(
        F.min("timestamp").alias("burst_start"), F.max("timestamp").alias("__last"),
        F.count("frame_len").alias("packets"), F.sum("frame_len").alias("bytes"),
    ).select(key, "burst_start", F.timestamp_micros(F.unix_micros("__last") + width_us(gap)).alias("burst_end"), "packets", "bytes")


def time_chunks(df: DataFrame, chunk: str = "300 seconds") -> DataFrame:
    """Rows and bytes per ingestion chunk."""
    return df.groupBy(F.window("timestamp", chunk).alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes")
    ).select(F.col("w.start").alias("chunk_start"), "packets", "bytes")
