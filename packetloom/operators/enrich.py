"""Address enrichment: distinct addresses, network lookup, cache and the double join."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.net import address_bits, ipv4_to_long
from packetloom.operators.slices import DEFAULT_SLICE, merge_back

GEO_COLUMNS = ("country", "country_iso", "city", "latitude", "longitude", "asn", "asn_org")

# How long a lookup stays valid (fixed values): located addresses never expire, the rest after one day.
NOT_FOUND_TTL_SECONDS = 86_400
INTEL_TTL_SECONDS = 86_400


def unique_ips(df: DataFrame) -> DataFrame:
    """Distinct addresses seen as source or destination. Each side shrinks first, before the union is shuffled."""
    src = df.select(F.col("src_ip").alias("ip")).distinct()
    return src.union(df.select("dst_ip").distinct()).where(F.col("ip").isNotNull()).distinct()


def networks_from_cidr(df: DataFrame, column: str = "network") -> DataFrame:
    """Add ``prefix`` (the network's bits) for an IPv4 or IPv6 CIDR column, and ``start`` and ``end`` (numbers) for IPv4."""
    parts = df.withColumn("__base", F.split_part(column, F.lit("/"), F.lit(1))).withColumn(
        "__bits", F.split_part(column, F.lit("/"), F.lit(2)).cast("int")
    )
    start = ipv4_to_long("__base")
    size = F.pow(F.lit(2.0), 32 - F.col("__bits")).cast("long")
    return parts.withColumns({
        "start": start, "end": start + size - 1, "prefix": F.substring(address_bits("__base"), F.lit(1), F.col("__bits") + 1),
    }).drop("__base", "__bits")


def locate(ips: DataFrame, networks: DataFrame, attributes: Sequence[str] = GEO_COLUMNS) -> DataFrame:
    """Attributes of the most specific network (with a ``prefix``) that holds each address; ``found`` is 0 when none does.

    An address is joined under its prefix of each length that a network has: at most 33 lengths for IPv4 and 129 for IPv6. Of
    equal networks the one with the smallest attributes counts.
    """
    nets = networks.where(F.col("prefix").isNotNull()).select("prefix", *attributes)
    lengths = sorted(r["n"] for r in nets.select(F.length("prefix").alias("n")).distinct().collect())
    named = ips.select("ip").withColumn("__bits", address_bits("ip"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("__bits"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("__bits"), F.lit(1), n))
    keyed = named.select("ip", F.explode_outer(prefixes).alias("prefix"))
    best = F.min(F.when(F.col("__net").isNotNull(), F.struct((-F.length("prefix")).alias("__length"), *attributes)))
    out = keyed.join(nets.withColumn("__net", F.lit(1)), "prefix", "left").groupBy("ip").agg(best.alias("best"))
    return out.select("ip", F.when(F.col("best").isNotNull(), 1).otherwise(0).alias("found"), *[F.col(f"best.{a}").alias(a) for a in attributes])


def attach(df: DataFrame, dim: DataFrame, width: str | int = DEFAULT_SLICE, ts: str = "timestamp") -> DataFrame:
    """Join per-address attributes twice, with ``src_`` and ``dst_`` prefixes."""
    for side in ("src", "dst"):
        renamed = dim.select(F.col("ip").alias(f"{side}_ip"), *[F.col(c).alias(f"{side}_{c}") for c in dim.columns if c != "ip"])
        df = merge_back(df, renamed, [f"{side}_ip"], width, ts)
    return df


def cache_entries(lookups: DataFrame, now: datetime | Column, ttl_seconds: Column | int | None) -> DataFrame:
    """Rows to append to the cache: key, value, when written and when it expires (NULL: never)."""
    written = now if isinstance(now, Column) else F.lit(now)
    ttl = (ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)).cast("long")
    value = F.to_json(F.struct(*[c for c in lookups.columns if c != "ip"]))
    return lookups.select(
        F.col("ip").alias("key"), value.alias("value"), written.cast("timestamp").alias("written_at"),
        F.timestamp_micros(F.unix_micros(written.cast("timestamp")) + ttl * 1_000_000).alias("expiry"),
    )


def cache_current(cache: DataFrame, now: datetime | Column) -> DataFrame:
    """The newest entry of each key, unless it has expired."""
    at = now if isinstance(now, Column) else F.lit(now)
    newest = cache.groupBy("key").agg(F.max_by(F.struct("value", "expiry"), "written_at").alias("e"))
    return newest.select("key", "e.value", "e.expiry").where(F.col("expiry").isNull() | (F.col("expiry") >= at))


def cache_hits(ips: DataFrame, current: DataFrame) -> DataFrame:
    return ips.join(current.select(F.col("key").alias("ip")), "ip", "left_semi")


def cache_misses(ips: DataFrame, current: DataFrame) -> DataFrame:
    return ips.join(current.select(F.col("key").alias("ip")), "ip", "left_anti")
