"""Filters, limits, validation and counters at ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.net import is_private_ip, is_valid_ip

MAX_PACKETS = 50_000
MIN_SIZE, MAX_SIZE = 14, 65_535


def transport_only(df: DataFrame, predicate: str | None = None) -> DataFrame:
    """TCP and UDP packets, or what a SQL predicate keeps; either way a filter the scan can take."""
    return df.where(predicate or "tcp_flags IS NOT NULL OR src_port IS NOT NULL")


def cap_per_file(df: DataFrame, limit: int = MAX_PACKETS) -> DataFrame:
    """The first ``limit`` packets of each file.

    Frame numbers are unique in a file, so a bucket of ``limit`` numbers holds at most ``limit`` rows. Counts
    per bucket tell which buckets are needed; only those are ranked.
    """
    bucket = F.floor(F.col("frame_no") / F.lit(limit))
    before = Window.partitionBy("file_path").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        df.groupBy("file_path", bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .where(F.col("__before") < limit).drop("__n")
    )
    rank = F.row_number().over(Window.partitionBy("file_path", "__bucket").orderBy("frame_no"))
    return (
        df.withColumn("__bucket", bucket).join(needed, ["file_path", "__bucket"])
        .withColumn("__rank", rank + F.col("__before"))
        .where(F.col("__rank") <= limit)
        .select(*df.columns)
    )


def size_in_range(low: int = MIN_SIZE, high: int = MAX_SIZE) -> Column:
    return F.col("frame_len").between(low, high)


def reject_reason(low: int = MIN_SIZE, high: int = MAX_SIZE) -> Column:
    """Why a row is not plausible, or NULL. Missing values are fine."""
    def bad(column: str, ok: Column) -> Column:
        return F.col(column).isNotNull() & ~ok

    reason = F.when(bad("src_ip", (F.col("src_ip") == "") | is_valid_ip("src_ip")), "src_ip")
    reason = reason.when(bad("dst_ip", (F.col("dst_ip") == "") | is_valid_ip("dst_ip")), "dst_ip")
    for port in ("src_port", "dst_port"):
        reason = reason.when(bad(port, F.col(port).between(0, 65_535)), port)
    return reason.when(bad("frame_len", size_in_range(low, high)), "frame_len")


def validate(df: DataFrame, low: int = MIN_SIZE, high: int = MAX_SIZE) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", reject_reason(low, high))
    return (
        marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.where(F.col("reject_reason").isNotNull()),
    )


def ingest_counters(
    df: DataFrame, low: int = MIN_SIZE, high: int = MAX_SIZE, malformed: Column | None = None,
) -> DataFrame:
    """Packets read, skipped for each reason and processed, per file and in total (NULL file), in one pass."""
    broken = F.lit(False) if malformed is None else malformed
    sized = F.coalesce(size_in_range(low, high), F.lit(True))
    invalid = reject_reason(low, high).isNotNull()
    marked = df.select(
        "file_path", broken.alias("broken"), (~broken & ~sized).alias("out_of_size"),
        (~broken & sized & invalid).alias("invalid"), (~broken & sized & ~invalid).alias("good"),
    )
    return marked.rollup("file_path").agg(
        F.grouping("file_path").alias("is_total"),
        F.count_distinct("file_path").alias("total_files"),
        F.count(F.lit(1)).alias("total_packets_read"),
        F.count_if("broken").alias("malformed_packets_skipped"),
        F.count_if("out_of_size").alias("packets_out_of_size_range"),
        F.count_if("invalid").alias("packets_failed_validation"),
        F.count_if("good").alias("packets_successfully_processed"),
    )


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of the columns."""
    return df.na.drop(subset=list(columns))


def public_only(df: DataFrame, ip: str) -> DataFrame:
    """Rows whose address is well formed and public."""
    return df.where(is_valid_ip(ip) & ~is_private_ip(ip))
