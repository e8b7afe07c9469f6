"""Queries over files that are written from the packets and read back: exports, answers, broken lines, training sets, a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.base import packets, query
from packetloom.operators.scalar import http_header_count, ja3_string
from packetloom.session import scratch_path
from packetloom.sources.exports import read_intel, read_session_export
from packetloom.sources.records import CORRUPT, canonical, discover, read_records, read_training_set
from packetloom.sources.sinks import write_training_set
from packetloom.streaming.packets import on_time, packet_stream


@query(
    "source_discovered", "protocol:s files_with_content",
    "SELECT DISTINCT protocol, 1 AS files_with_content FROM packets",
)
def _(spark, sf):
    path = scratch_path(spark, "landed")
    packets(spark, sf).select("frame_no", "protocol").write.partitionBy("protocol").parquet(path)
    files = discover(spark, path, "*.parquet").select(F.regexp_extract("path", "protocol=([^/]+)/", 1).alias("protocol"), "length")
    return files.groupBy("protocol").agg((F.min("length") > 0).cast("int").alias("files_with_content"))


@query(
    "source_session_export", "session_id timestamp:t src_ip:s bytes_total:s",
    "SELECT frame_no AS session_id, CASE WHEN frame_no % 97 <> 0 THEN timestamp END AS timestamp, src_ip, frame_len AS bytes_total FROM packets",
)
def _(spark, sf):
    # Names as exports write them; some rows have no readable time.
    path = scratch_path(spark, "export")
    time = F.when(F.col("frame_no") % 97 == 0, "n/a").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    packets(spark, sf).select(
        F.col("frame_no").alias("SessionId"), time.alias("firstPacket"), F.col("src_ip").alias("SrcIP"), F.col("frame_len").alias("Bytes.Total")
    ).write.option("header", "true").csv(path)
    return read_session_export(spark, path, split_camel=True)


@query(
    "source_intel", "ip:s company_name:s connection_asn country_code:s city:s latitude:f security_is_threat:s threat_types:s",
    """SELECT src_ip AS ip, CASE WHEN n % 4 > 0 THEN 'company ' || CAST(n % 7 AS VARCHAR) END AS company_name, n AS connection_asn,
      CASE n % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' END AS country_code, CASE n % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'town' END AS city, n / 8 AS latitude,
      CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END AS security_is_threat, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'scan' ELSE 'scan,bot' END AS threat_types
    FROM (SELECT src_ip, count(*) AS n FROM packets GROUP BY src_ip)""",
)
def _(spark, sf):
    # Nested answers as they are landed: absent parts, empty lists, and answers without an address.
    n = F.col("n")
    counted = packets(spark, sf).groupBy(F.col("src_ip").alias("ip")).agg(F.count("*").alias("n"))
    place = F.when(n % 3 < 2, F.struct(
        F.struct(F.when(n % 3 == 0, "DE").otherwise("US").alias("code")).alias("country"), F.when(n % 3 == 0, "city").otherwise("town").alias("city"),
    ))
    threats = F.when(n % 3 == 1, F.array(F.lit("scan"))).when(n % 3 == 2, F.array(F.lit("scan"), F.lit("bot"))).when(n % 2 == 0, F.array().cast("array<string>"))
    nested = counted.select(
        "ip", F.when(n % 4 > 0, F.struct(F.concat(F.lit("company "), (n % 7).cast("string")).alias("name"))).alias("company"),
        F.struct(n.alias("asn")).alias("connection"),
        F.when(place.isNotNull(), F.struct(place.country.alias("country"), place.city.alias("city"), (n / 8).alias("latitude"))).otherwise(
            F.struct(F.lit(None).cast("struct<code:string>").alias("country"), F.lit(None).cast("string").alias("city"), (n / 8).alias("latitude"))
        ).alias("location"),
        F.struct((n % 2 == 0).alias("is_threat"), threats.alias("threats")).alias("security"),
    )
    path = scratch_path(spark, "answers")
    nested.union(nested.withColumn("ip", F.lit(""))).union(nested.withColumn("ip", F.lit(None).cast("string"))).write.json(path)
    return read_intel(spark, path)


@query(
    "source_malformed", "frame_no src_ip:s frame_len broken:s",
    """SELECT CASE WHEN frame_no % 10 <> 0 THEN frame_no END AS frame_no, CASE WHEN frame_no % 10 <> 0 THEN src_ip END AS src_ip,
      CASE WHEN frame_no % 10 <> 0 THEN frame_len END AS frame_len, CASE WHEN frame_no % 20 = 0 THEN '{"frame_no":' || CAST(frame_no AS VARCHAR)
      WHEN frame_no % 10 = 0 THEN '{"frame_no":' || CAST(frame_no AS VARCHAR) || ',"frame_len":"long"}' END AS broken FROM packets""",
)
def _(spark, sf):
    # Lines that end early, and lines whose field has the wrong kind.
    path = scratch_path(spark, "lines")
    number = F.col("frame_no").cast("string")
    line = F.when(F.col("frame_no") % 20 == 0, F.concat(F.lit('{"frame_no":'), number)).when(
        F.col("frame_no") % 10 == 0, F.concat(F.lit('{"frame_no":'), number, F.lit(',"frame_len":"long"}'))
    ).otherwise(F.to_json(F.struct("frame_no", "src_ip", "frame_len")))
    packets(spark, sf).select(line.alias("value")).write.text(path)
    return read_records(spark, path, "json", "mark").withColumnRenamed(CORRUPT, "broken")


@query(
    "scalar_ja3_string", "frame_no ja3:s",
    """SELECT frame_no, CASE WHEN frame_no % 3 = 1 AND src_port IS NOT NULL AND frame_no % 7 <> 0 THEN
      CAST(frame_len AS VARCHAR) || ',' || replace(coalesce(dns_response_ip, ''), ',', '-') || ',' || CAST(src_port AS VARCHAR) || '-' || CAST(dst_port AS VARCHAR)
      || ',' || replace(coalesce(tls_ja3, ''), ',', '-') || ',' END AS ja3 FROM packets""",
)
def _(spark, sf):
    df = packets(spark, sf)
    version = F.when(F.col("frame_no") % 7 != 0, F.col("frame_len").cast("string"))
    lists = (F.col("dns_response_ip"), F.concat_ws(",", "src_port", "dst_port"), F.col("tls_ja3"), F.lit(None).cast("string"))
    return df.select("frame_no", ja3_string((F.col("frame_no") % 3).cast("string"), version, *lists).alias("ja3"))


@query(
    "scalar_http_header_count", "frame_no headers",
    """SELECT frame_no, CASE WHEN http_request_uri IS NOT NULL THEN 1 + k WHEN http_response_code IS NOT NULL THEN 1 + 2 * k ELSE 0 END AS headers
    FROM (SELECT *, frame_no % 4 AS k FROM packets)""",
)
def _(spark, sf):
    k = (F.col("frame_no") % 4).cast("int")
    request = F.when(F.col("http_request_uri").isNotNull(), F.concat("http_request_uri", F.repeat(F.lit("\nA: b"), k))).otherwise("")
    response = F.when(F.col("http_response_code").isNotNull(), F.concat(F.lit("HTTP"), F.repeat(F.lit("\nA: b"), k * 2)))
    return packets(spark, sf).select("frame_no", http_header_count(request, response).alias("headers"))


@query(
    "sink_training_set", "frame_no frame_len tcp_seq dns_an_count",
    "SELECT frame_no, frame_len, coalesce(tcp_seq, 0) AS tcp_seq, coalesce(dns_an_count, 0) AS dns_an_count FROM packets",
)
def _(spark, sf):
    path = scratch_path(spark, "training")
    write_training_set(packets(spark, sf).select("frame_no", "timestamp", "src_ip", "frame_len", "tcp_seq", "dns_an_count"), path)
    back = read_training_set(spark, path)
    # Only numbers come back: the address and the time are no features.
    if set(back.columns) != {"frame_no", "frame_len", "tcp_seq", "dns_an_count"}:
        raise ValueError(f"unexpected columns {back.columns}")
    return back


@query(
    "stream_on_time", "frame_no timestamp:t src_ip:s dst_ip:s src_port dst_port protocol:s frame_len",
    "SELECT frame_no, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, frame_len FROM packets",
)
def _(spark, sf):
    # Every fifth packet is landed twice; the stream picks the files up once each and drops what it has seen.
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "out")
    rows = canonical(packets(spark, sf)).withColumn("file_path", F.lit("capture"))
    rows.write.parquet(landed)
    rows.where(F.col("frame_no") % 5 == 0).write.mode("append").parquet(landed)
    running = on_time(packet_stream(spark, landed), "400 days").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "checkpoint")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out)
