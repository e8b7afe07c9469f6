"""Session exports (CSV) and address intelligence (JSON) landed as files."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger("packetloom")

# Flat column -> path in the nested answer (fixed values).
INTEL_FIELDS = {
    "company_name": "company.name", "company_domain": "company.domain", "connection_asn": "connection.asn",
    "connection_org": "connection.organization", "connection_type": "connection.type",
    "country_code": "location.country.code", "country_name": "location.country.name", "city": "location.city",
    "latitude": "location.latitude", "longitude": "location.longitude", "security_is_threat": "security.is_threat",
}

INTEL_SCHEMA = (
    "ip string, company struct<name:string,domain:string>, connection struct<asn:long,organization:string,type:string>, "
    "location struct<country:struct<code:string,name:string>,city:string,latitude:double,longitude:double>, "
    "security struct<is_threat:boolean,threats:array<string>>"
)


def sanitize_column_name(name: str, split_camel: bool = False) -> str:
    """Lower case, spaces and dots to '_', other signs removed; optionally 'SrcIP' -> 'src_ip' first."""
    if split_camel:
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[ .]", "_", name.lower()))


def read_session_export(spark: SparkSession, path: str, split_camel: bool = False) -> DataFrame:
    """A landed session export; its ``firstPacket`` becomes ``timestamp``. Empty without that column."""
    raw = spark.read.option("header", "true").csv(path)
    clean = raw.toDF(*[sanitize_column_name(c, split_camel) for c in raw.columns])
    first = "first_packet" if split_camel else "firstpacket"
    if first not in clean.columns:
        log.error("no firstPacket column in %s", path)
        return spark.createDataFrame([], "timestamp timestamp")
    return clean.withColumnRenamed(first, "timestamp").withColumn("timestamp", F.try_to_timestamp("timestamp"))


def flatten_intel(nested: DataFrame) -> DataFrame:
    """One row per address with 12 flat columns; the list of threats as comma text ('' when empty)."""
    columns = [F.col(path).alias(name) for name, path in INTEL_FIELDS.items()]
    threats = F.array_join(F.coalesce("security.threats", F.array().cast("array<string>")), ",").alias("threat_types")
    return nested.where(F.col("ip").isNotNull() & (F.col("ip") != "")).select("ip", *columns, threats)


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    return flatten_intel(spark.read.schema(INTEL_SCHEMA).json(path))
