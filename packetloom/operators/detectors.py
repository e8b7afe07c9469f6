"""Attack indicators over application traffic, and table upkeep."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.net import flow_key, reverse_flow_key
from packetloom.functions.timing import floor_time
from packetloom.operators.slices import forward_fill


def brute_force(df: DataFrame, window: str = "1 minute") -> DataFrame:
    """Client errors per (client, URI, window). A response belongs to the last request of its reversed flow."""
    request = F.col("http_request_uri").isNotNull()
    response = F.col("http_response_code").isNotNull()
    talk = df.where(request | response).select(
        "timestamp", "frame_no", "http_response_code",
        F.when(request, flow_key()).otherwise(reverse_flow_key()).alias("flow_key"),
        F.when(request, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("client_ip"),
        F.col("http_request_uri").alias("uri"),
    )
    paired = forward_fill(talk, ["flow_key"], ["uri"]).where(F.col("http_response_code").isNotNull() & F.col("uri").isNotNull())
    failed = F.col("http_response_code").between(400, 499)
    return paired.groupBy("client_ip", "uri", floor_time(F.col("timestamp"), window).alias("window_start")).agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(failed).alias("client_errors")
    )


def registered_domain(name: Column) -> Column:
    """The last two labels."""
    return F.substring_index(name, ".", -2)


def dns_tunnel_indicators(df: DataFrame, window: str = "1 minute") -> DataFrame:
    """Per (source, domain, window): queries, distinct names, lengths and the mix of query types."""
    asked = df.where(F.col("dns_qry_name").isNotNull())
    keys = ["src_ip", "domain", "window_start"]
    return asked.withColumns({
        "domain": registered_domain(F.col("dns_qry_name")), "window_start": floor_time(F.col("timestamp"), window),
    }).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("dns_qry_name").alias("distinct_names"),
        F.avg(F.length("dns_qry_name")).alias("mean_name_length"), F.max(F.length("dns_qry_name")).alias("max_name_length"),
        F.count_if(F.col("dns_qry_type").isin(5, 16)).alias("txt_or_cname"),
    )


def dns_type_mix(df: DataFrame) -> DataFrame:
    """Number of queries per source and query type."""
    return df.where(F.col("dns_qry_type").isNotNull()).groupBy("src_ip", "dns_qry_type").agg(F.count(F.lit(1)).alias("queries"))


def retained(df: DataFrame, now: datetime | Column, days: int, ts: str = "timestamp") -> DataFrame:
    """Rows not older than ``days``; on a date-partitioned table this prunes whole partitions."""
    at = now if isinstance(now, Column) else F.lit(now)
    return df.where(F.col(ts) >= F.timestamp_micros(F.unix_micros(at) - days * 86_400_000_000))


def incremental(df: DataFrame, high_water: datetime, lookback_seconds: int, seen: DataFrame, key: list[str], ts: str = "timestamp") -> DataFrame:
    """New rows since the high-water mark, looking back a little for late ones, without those already taken."""
    start = F.timestamp_micros(F.unix_micros(F.lit(high_water)) - lookback_seconds * 1_000_000)
    recent = df.where(F.col(ts) > start).dropDuplicates(key)
    return recent.join(seen.where(F.col(ts) > start).select(*key), key, "left_anti")
