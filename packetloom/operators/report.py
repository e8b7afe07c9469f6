"""The tables behind the report. Each is a small aggregate, whatever the size of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.timing import seconds_between
from packetloom.schema import FLOW_KEY

SHORT_FLOW, FAST_BYTES, MANY_PACKETS = 1e-6, 1e9, 100
DISPLAY_ROWS = 100
TEXT_LIMIT = 100


def detection_sessions(df: DataFrame) -> DataFrame:
    """Records per source."""
    return df.where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.count(F.lit(1)).alias("records"))


def first_rows(df: DataFrame, key: str = "src_ip", order: Sequence[str] = ("timestamp", "frame_no")) -> DataFrame:
    """The first row of each key, whole; partial aggregation keeps one row per key and task."""
    place, row = F.struct(*order), F.struct(*[c for c in df.columns if c != key])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, place).alias("r")).select(key, "r.*")


def protocol_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("protocol").agg(F.count(F.lit(1)).alias("count"))


def report_header(results: DataFrame, is_anomaly: Column) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(is_anomaly).alias("anomalies"),
        F.coalesce(F.try_divide(F.count_if(is_anomaly), F.count(F.lit(1))), F.lit(0.0)).alias("anomaly_ratio"),
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
    )


# Explanation texts by reason (fixed values).
EXPLANATIONS = {
    "short_flow": "Extremely short flow duration",
    "fast_bytes": "Astronomical data rates",
    "many_packets": "High packet count from a single host",
}


def anomaly_explanation(anomalies: DataFrame) -> DataFrame:
    """``reason, text, applies`` from one pass over the anomalies."""
    checks = {
        "short_flow": F.bool_or(F.col("flow_duration_seconds") < SHORT_FLOW),
        "fast_bytes": F.max("flow_bytes_per_sec") > FAST_BYTES,
        "many_packets": F.max("src_host_pkt_count_win") > MANY_PACKETS,
    }
    row = anomalies.agg(*[F.coalesce(c.cast("int"), F.lit(0)).alias(name) for name, c in checks.items()])
    cells = [F.struct(F.lit(n).alias("reason"), F.lit(EXPLANATIONS[n]).alias("text"), F.col(n).alias("applies")) for n in checks]
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def run_summary(counters: DataFrame, records: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``stage, metric, value`` of a run; ``counters`` is the ingest rollup, ``records`` the rows that reached sessions."""
    read, done = F.col("total_packets_read"), F.col("packets_successfully_processed")
    parts = [
        _long(counters.where(F.col("is_total") == 1), "ingestion", {
            "files_found": F.col("total_files"), "packets_read": read, "packets_filtered": read - done, "packets_processed": done,
        }),
        _long(records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("s")), "sessionization", {
            "records_before_aggregation": F.col("n"), "unique_sessions": F.col("s"),
        }),
    ]
    if results is not None:
        scored = F.col("anomaly").isNotNull()
        parts.append(_long(results.agg(
            F.count_if(scored).alias("p"), F.count_if(~scored).alias("s"), F.count_if(F.col("anomaly") == -1).alias("a"),
        ), "detection", {"sessions_processed": F.col("p"), "sessions_skipped": F.col("s"), "anomalies_detected": F.col("a")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _long(row: DataFrame, stage: str, metrics: dict[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(stage).alias("stage"), F.lit(m).alias("metric"), v.cast("long").alias("value")) for m, v in metrics.items()]
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def host_activity(df: DataFrame, side: str) -> DataFrame:
    """Sum of the host-window packet counts per address on one side ('src' or 'dst')."""
    return df.where(F.col(f"{side}_ip").isNotNull()).groupBy(F.col(f"{side}_ip").alias("ip")).agg(
        F.sum(f"{side}_host_pkt_count_win").alias("activity")
    )


def top_hosts(df: DataFrame, side: str, n: int = 5) -> DataFrame:
    return host_activity(df, side).orderBy(F.desc("activity"), "ip").limit(n)


def busiest_sources(df: DataFrame, n: int = 5) -> DataFrame:
    """The sources with the most packets, and the mean duration of the flows of their packets.

    Packets of one flow share its duration, so the mean over packets is one over flows, weighted by their packets: no packet is
    joined. Packets with an incomplete flow key count, but have no duration.
    """
    complete = F.lit(True)
    for c in FLOW_KEY:
        complete = complete & F.col(c).isNotNull()
    flows = df.where(F.col("src_ip").isNotNull()).groupBy(*FLOW_KEY).agg(
        F.count(F.lit(1)).alias("packets"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    duration = F.when(complete, seconds_between(F.col("last"), F.col("first")))
    weighted = F.try_divide(F.sum(duration * F.col("packets")), F.sum(F.when(duration.isNotNull(), F.col("packets"))))
    return flows.groupBy("src_ip").agg(F.sum("packets").alias("packets"), weighted.alias("mean_flow_duration")).orderBy(F.desc("packets"), "src_ip").limit(n)


def bidirectional_hosts(df: DataFrame) -> DataFrame:
    """Addresses seen on both sides, with their total activity."""
    src, dst = host_activity(df, "src"), host_activity(df, "dst").withColumnRenamed("activity", "__in")
    return src.join(dst, "ip").select("ip", (F.col("activity") + F.col("__in")).alias("activity"))


def local_host(df: DataFrame) -> DataFrame:
    """The most active address that both sends and receives."""
    return bidirectional_hosts(df).orderBy(F.desc("activity"), "ip").limit(1)


def main_host(df: DataFrame) -> DataFrame:
    """The source with the most rows; the smallest address on a tie."""
    return detection_sessions(df).orderBy(F.desc("records"), "src_ip").limit(1)


def host_protocols(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Protocol counts and their percentage within the traffic of each host of ``hosts(ip)``."""
    ends = F.array_distinct(F.array("src_ip", "dst_ip"))
    counts = (
        df.select("protocol", F.explode(ends).alias("ip")).join(hosts.select("ip"), "ip", "left_semi")
        .groupBy("ip", "protocol").agg(F.count(F.lit(1)).alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy("ip"))
    return counts.withColumn("percentage", F.col("count") * 100.0 / total)


def top_peers(df: DataFrame, hosts: DataFrame, side: str, n: int = 5) -> DataFrame:
    """Per host the ``n`` busiest peers when it is on ``side``, with the protocols used."""
    other = "dst" if side == "src" else "src"
    pairs = (
        df.select(F.col(f"{side}_ip").alias("host"), F.col(f"{other}_ip").alias("peer"), "protocol")
        .join(hosts.select(F.col("ip").alias("host")), "host", "left_semi")
        .groupBy("host", "peer", "protocol").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host", "peer").agg(F.sum("n").alias("interactions"), F.collect_set("protocol").alias("protocols"))
    )
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("interactions"), "peer"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n).withColumn(
        "protocols", F.array_join(F.array_sort("protocols"), ", ")
    )


def peer_protocols(df: DataFrame) -> DataFrame:
    """Protocols used per (source, destination), as one sorted text; there are few protocol names."""
    return df.groupBy("src_ip", "dst_ip").agg(F.array_join(F.array_sort(F.collect_set("protocol")), ", ").alias("protocols"))


def top_edges(df: DataFrame, n: int = 10) -> DataFrame:
    """The busiest edges out of the main host, labelled by host name where one is known."""
    out = df.join(main_host(df).select("src_ip"), "src_ip", "left_semi")
    label = F.max("dst_hostname") if "dst_hostname" in df.columns else F.lit(None).cast("string")
    edges = out.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("count"), label.alias("__name"))
    edges = edges.orderBy(F.desc("count"), "dst_ip").limit(n)
    source_label = F.concat("src_ip", F.lit(" (host)")) if "src_hostname" in df.columns else F.col("src_ip")
    return edges.select("src_ip", "dst_ip", "count", source_label.alias("src_label"), F.coalesce("__name", "dst_ip").alias("dst_label"))


def anomalies_to_show(results: DataFrame, n: int = DISPLAY_ROWS) -> DataFrame:
    ties = [c for c in ("client_ip", "timestamp", "frame_no") if c in results.columns]
    return results.where(F.col("anomaly") == -1).orderBy(F.desc("score"), *ties).limit(n)


def anomaly_details(anomalies: DataFrame, totals: DataFrame, values: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """Each anomaly beside its client's profile, with highlight flags; the lists of values are cut at ``limit`` characters.

    Only the values that can still show are gathered: the first ``limit`` in sort order.
    """
    ranked = values.withColumn("__r", F.row_number().over(Window.partitionBy("client_ip", "kind").orderBy("value")))
    shown = ranked.where(F.col("__r") <= limit).groupBy("client_ip", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "value"))), lambda e: e["value"]), ", ").alias("text")
    )
    cut = F.when(F.length("text") > limit, F.concat(F.substring("text", 1, limit), F.lit("..."))).otherwise(F.col("text"))
    lists = shown.groupBy("client_ip").agg(
        *[F.max(F.when(F.col("kind") == k, cut)).alias(f"profile_{k}s") for k in ("uri", "user_agent")]
    )
    history = totals.select("client_ip", F.col("session_count").alias("profile_session_count"), F.col("total_bytes").alias("profile_total_bytes"))
    return (
        anomalies.join(history, "client_ip", "left").join(lists, "client_ip", "left")
        .withColumns({
            "highlight_uri": (F.col("is_new_uri_for_ip") == 1).cast("int"),
            "highlight_user_agent": (F.col("is_new_user_agent_for_ip") == 1).cast("int"),
            "profile_uris": F.coalesce("profile_uris", F.lit("None")),
            "profile_user_agents": F.coalesce("profile_user_agents", F.lit("None")),
        })
    )
