"""Streams of packet files: pickup, late rows, duplicates, host windows (sketched, or whole by two aggregations in a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions.entropy import count_entropy
from packetloom.schema import PACKET_SCHEMA
from packetloom.sources.records import canonical


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files below ``path`` as packets; the query's checkpoint remembers which were read."""
    reader = spark.readStream.schema(PACKET_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.format(fmt).load(path)
    return canonical(raw.withColumn("file_path", F.coalesce("file_path", F.col("_metadata.file_path"))))


def on_time(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bound lateness and drop packets that arrive twice."""
    return df.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["file_path", "frame_no"])


def src_host_stream(df: DataFrame, window: str = "1 second", rsd: float = 0.01) -> DataFrame:
    """Source windows of a watermarked stream. Distinct counts are sketches here; everything else equals the batch."""
    return df.where(F.col("src_ip").isNotNull()).groupBy(F.window("timestamp", window).alias("w"), "src_ip").agg(
        F.count("frame_len").alias("src_host_pkt_count_win"), F.sum("frame_len").alias("src_host_byte_count_win"),
        F.approx_count_distinct("dst_ip", rsd).alias("src_host_distinct_dst_ips_win"),
        F.approx_count_distinct("dst_port", rsd).alias("src_host_distinct_dst_ports_win"),
    ).select("src_ip", F.col("w.start").alias("time_window"), *_src_columns())


#: Columns whose distinct values a source window counts, and those whose mean and deviation it has; names as in the batch.
_COUNTED = {"dst_ip": "distinct_dst_ips", "dst_port": "distinct_dst_ports", "tls_ja3": "distinct_ja3"}
_MEASURED = {"dns_qry_name_len": "dns_qry_len", "dns_qry_name_entropy": "dns_qry_entropy"}


def whole_src_host_stream(df: DataFrame, window: str = "1 second") -> DataFrame:
    """Every column of the batch's ``src_host_windows`` but the frequency change, with exact distinct counts, of a watermarked stream.

    A first aggregation counts each value per window and source, a second one sums up the values; both close a window when the
    watermark has passed it, so state holds one row per value of the open windows. A hot source is spread over its values. Rows without
    source or time are left out, as in the batch; columns that the stream lacks give no features.
    """
    counted = [c for c in _COUNTED if c in df.columns]
    measured = [c for c in _MEASURED if c in df.columns]
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in counted])).alias("v")
    rows = df.where(F.col("src_ip").isNotNull()).select("timestamp", "src_ip", "frame_len", *measured, kinds)
    # Measures belong to packets; each packet has one row of the first kind.
    own = lambda c: F.when(F.col("v.kind") == counted[0], F.col(c))
    values = rows.groupBy(F.window("timestamp", window).alias("w"), "src_ip", "v.kind", "v.value").agg(
        F.count(F.lit(1)).alias("rows"), F.count(own("frame_len")).alias("packets"), F.sum(own("frame_len")).alias("bytes"),
        *[x for c in measured for x in (
            F.count(own(c)).alias(f"n_{c}"), F.sum(own(c)).alias(f"sum_{c}"), (F.var_pop(own(c)) * F.count(own(c))).alias(f"square_{c}"),
        )],
    )
    present = lambda c: F.when((F.col("kind") == c) & F.col("value").isNotNull(), F.col("rows"))
    out = [F.sum("packets").alias("src_host_pkt_count_win"), F.sum("bytes").alias("src_host_byte_count_win")]
    out += [F.count(present(c)).alias(f"src_host_{_COUNTED[c]}_win") for c in counted]
    if "dst_port" in counted:
        out.append(count_entropy(present("dst_port")).alias("src_host_dst_port_entropy_win"))
    for c in measured:
        n, total = F.sum(f"n_{c}"), F.sum(f"sum_{c}")
        # Squares around the window's mean: those around each value's mean, and those of these means.
        mean = F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))
        square = F.sum(f"square_{c}") + F.sum(mean * F.col(f"sum_{c}")) - total * total / F.nullif(n, F.lit(0))
        out.append((total / F.nullif(n, F.lit(0))).alias(f"src_host_{_MEASURED[c]}_mean_win"))
        out.append(F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1))).alias(f"src_host_{_MEASURED[c]}_std_win"))
    closed = values.groupBy("w", "src_ip").agg(*out)
    return closed.select("src_ip", F.col("w.start").alias("time_window"), *[c for c in closed.columns if c not in ("w", "src_ip")])


def _src_columns() -> list[str]:
    return [f"src_host_{c}_win" for c in ("pkt_count", "byte_count", "distinct_dst_ips", "distinct_dst_ports")]


def dst_host_stream(df: DataFrame, window: str = "1 second", rsd: float = 0.01) -> DataFrame:
    return df.where(F.col("dst_ip").isNotNull()).groupBy(F.window("timestamp", window).alias("w"), "dst_ip").agg(
        F.count("frame_len").alias("dst_host_pkt_count_win"), F.sum("frame_len").alias("dst_host_byte_count_win"),
        F.approx_count_distinct("src_ip", rsd).alias("dst_host_distinct_src_ips_win"),
    ).select("dst_ip", F.col("w.start").alias("time_window"), "dst_host_pkt_count_win", "dst_host_byte_count_win", "dst_host_distinct_src_ips_win")


def burst_stream(df: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Activity bursts per source on a watermarked stream; a burst is emitted once its gap has passed."""
    return df.where(F.col("src_ip").isNotNull()).groupBy("src_ip", F.session_window("timestamp", gap).alias("w")).agg(
        F.count("frame_len").alias("packets"), F.sum("frame_len").alias("bytes"),
    ).select("src_ip", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "packets", "bytes")


def client_session_stream(df: DataFrame, run: str = "5 minutes") -> DataFrame:
    """One row per source and run, closed by the watermark: what the stateful steps read instead of packets."""
    head = F.struct("timestamp", "frame_no", F.col("http_request_uri").alias("uri"), F.col("http_user_agent").alias("user_agent"))
    return df.where(F.col("src_ip").isNotNull()).groupBy(F.window("timestamp", run).alias("w"), F.col("src_ip").alias("client_ip")).agg(
        F.min_by(head, F.struct("timestamp", "frame_no")).alias("h"), F.sum("frame_len").alias("total_bytes"), F.count(F.lit(1)).alias("packets"),
    ).select("client_ip", "h.*", "total_bytes", "packets")
