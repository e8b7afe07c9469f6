"""Queries for ingest quality and per-packet features."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.base import STEPS, packets, query, table
from packetloom.functions import net
from packetloom.functions.entropy import char_entropy
from packetloom.operators import quality, scalar
from packetloom.session import scratch_path
from packetloom.sources import capture, pcap

_IP_OK = (
    r"regexp_full_match({0}, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}"
    r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"
)


def ip_number(ip: str) -> str:
    part = "CAST(split_part({0}, '.', {1}) AS BIGINT) * {2}"
    return "(" + " + ".join(part.format(ip, i + 1, 256 ** (3 - i)) for i in range(4)) + ")"


def ip_private(ip: str) -> str:
    n = ip_number(ip)
    blocks = [
        (10 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16), (127 << 24, 24),
        ((169 << 24) + (254 << 16), 16), (0, 24), ((198 << 24) + (18 << 16), 17), (240 << 24, 28),
    ]
    return "(" + " OR ".join(f"{n} BETWEEN {a} AND {a + (1 << bits) - 1}" for a, bits in blocks) + ")"


def entropy_of(text: str) -> str:
    return f"coalesce(list_aggregate(string_split(nullif({text}, ''), ''), 'entropy'), 0)"


# Packets with file names and a few broken fields, for the ingest queries.
_DIRTY = (
    "SELECT * REPLACE (CASE WHEN frame_no % 17 = 0 THEN '10.0.0.300' ELSE src_ip END AS src_ip, "
    "CASE WHEN frame_no % 19 = 0 THEN dst_port + 70000 ELSE dst_port END AS dst_port), "
    "'capture-' || CAST(frame_no % 3 AS VARCHAR) AS file_path FROM packets"
)
STEPS["dirty"] = _DIRTY


def dirty(spark, sf):
    return packets(spark, sf).withColumns({
        "src_ip": F.when(F.col("frame_no") % 17 == 0, "10.0.0.300").otherwise(F.col("src_ip")),
        "dst_port": F.when(F.col("frame_no") % 19 == 0, F.col("dst_port") + 70000).otherwise(F.col("dst_port")),
        "file_path": F.concat(F.lit("capture-"), (F.col("frame_no") % 3).cast("string")),
    })


_L1 = "frame_no timestamp:t src_ip:s dst_ip:s src_port dst_port protocol:s frame_len ip_len"


@query("source_packets", _L1 + " payload:s dns_qry_name:s http_request_uri:s sql_query:s tls_ja3:s", "SELECT * FROM packets")
def _(spark, sf):
    return packets(spark, sf)


# Captures written from the packets and read back: by byte ranges, and through the data source.
_CAPTURED = "timestamp:t src_ip:s dst_ip:s src_port dst_port protocol:s frame_len ip_len tcp_flags tcp_seq tcp_ack payload:s"
_ON_THE_WIRE = """SELECT timestamp, src_ip, dst_ip, src_port, dst_port, CASE WHEN tcp_flags IS NULL THEN 'UDP' ELSE 'TCP' END AS protocol,
  greatest(frame_len, CASE WHEN tcp_flags IS NULL THEN 58 ELSE 70 END) AS frame_len, CASE WHEN tcp_flags IS NULL THEN 44 ELSE 56 END AS ip_len,
  tcp_flags, tcp_seq, tcp_ack, payload FROM packets"""


def _captures(spark, sf) -> str:
    path = scratch_path(spark, "captures")
    pcap.write_captures(packets(spark, sf), path)
    return path


@query("source_captures", _CAPTURED, _ON_THE_WIRE)
def _(spark, sf):
    return capture.read_captures(spark, _captures(spark, sf), chunk=1 << 17)


@query("source_captures_format", _CAPTURED, _ON_THE_WIRE)
def _(spark, sf):
    path, index = _captures(spark, sf), scratch_path(spark, "index")
    pcap.write_index(spark, path, index, chunk=1 << 17)
    return spark.read.format(pcap.FORMAT).option("index", index).load(path)


@query("filter_transport", _L1, "SELECT * FROM packets WHERE tcp_flags IS NOT NULL OR src_port IS NOT NULL")
def _(spark, sf):
    return quality.transport_only(packets(spark, sf))


@query("filter_transport_predicate", _L1, "SELECT * FROM packets WHERE protocol = 'DNS' OR dst_port = 443")
def _(spark, sf):
    return quality.transport_only(packets(spark, sf), "protocol = 'DNS' OR dst_port = 443")


@query(
    "limit_per_file", "file_path:s frame_no frame_len",
    "SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY frame_no) <= 100", "packets dirty",
)
def _(spark, sf):
    return quality.cap_per_file(dirty(spark, sf), 100)


@query("filter_frame_size", _L1, "SELECT * FROM packets WHERE frame_len BETWEEN 64 AND 1500")
def _(spark, sf):
    return packets(spark, sf).where(quality.size_in_range(64, 1500))


_REASON = (
    f"CASE WHEN NOT {_IP_OK.format('src_ip')} THEN 'src_ip' WHEN NOT {_IP_OK.format('dst_ip')} THEN 'dst_ip' "
    "WHEN src_port NOT BETWEEN 0 AND 65535 THEN 'src_port' WHEN dst_port NOT BETWEEN 0 AND 65535 THEN 'dst_port' "
    "WHEN frame_len NOT BETWEEN 64 AND 1500 THEN 'frame_len' END"
)


@query("validate_rows", "frame_no reject_reason:s", f"SELECT frame_no, {_REASON} AS reject_reason FROM dirty", "packets dirty")
def _(spark, sf):
    valid, rejected = quality.validate(dirty(spark, sf), 64, 1500)
    return valid.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected)


@query(
    "ingest_counters",
    "file_path:s is_total total_files total_packets_read malformed_packets_skipped packets_out_of_size_range "
    "packets_failed_validation packets_successfully_processed",
    f"""SELECT file_path, GROUPING(file_path) AS is_total, count(DISTINCT file_path) AS total_files,
        count(*) AS total_packets_read, 0 AS malformed_packets_skipped,
        count(*) FILTER (NOT sized) AS packets_out_of_size_range,
        count(*) FILTER (sized AND reason IS NOT NULL) AS packets_failed_validation,
        count(*) FILTER (sized AND reason IS NULL) AS packets_successfully_processed
      FROM (SELECT file_path, frame_len BETWEEN 64 AND 1500 AS sized, {_REASON} AS reason FROM dirty)
      GROUP BY ROLLUP (file_path)""",
    "packets dirty",
)
def _(spark, sf):
    return quality.ingest_counters(dirty(spark, sf), 64, 1500)


@query("drop_incomplete", "frame_no http_response_code", "SELECT * FROM packets WHERE http_response_code IS NOT NULL")
def _(spark, sf):
    return quality.complete(packets(spark, sf), ["http_response_code"])


@query(
    "filter_public_ips", "frame_no dst_ip:s src_ip:s",
    f"SELECT * FROM dirty WHERE {_IP_OK.format('src_ip')} AND NOT {ip_private('src_ip')}", "packets dirty",
)
def _(spark, sf):
    return quality.public_only(dirty(spark, sf), "src_ip")


_BITS = ", ".join(f"(f >> {i}) & 1 AS tcp_flag_{n}" for i, n in enumerate(scalar.TCP_FLAG_BITS))
_FLAGS = "frame_no " + " ".join(f"tcp_flag_{n}" for n in scalar.TCP_FLAG_BITS)


@query("scalar_tcp_flags", _FLAGS, f"SELECT frame_no, {_BITS} FROM (SELECT frame_no, coalesce(tcp_flags, 0) AS f FROM packets)")
def _(spark, sf):
    return scalar.packet_features(packets(spark, sf))


@query(
    "scalar_parse_hex_flags", _FLAGS,
    f"SELECT frame_no, {_BITS} FROM (SELECT frame_no, CASE WHEN frame_no % 7 = 0 THEN 0 ELSE coalesce(tcp_flags, 0) END AS f FROM packets)",
)
def _(spark, sf):
    text = F.when(F.col("frame_no") % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("0x"), F.hex(F.col("tcp_flags").cast("long"))))
    return scalar.packet_features(packets(spark, sf).withColumn("tcp_flags", text))


@query(
    "scalar_scan_flags", "frame_no tcp_flags_null_scan tcp_flags_xmas_scan tcp_flags_syn_flood",
    """SELECT frame_no, (f = 0)::INT AS tcp_flags_null_scan, ((f & 41) = 41)::INT AS tcp_flags_xmas_scan,
       ((f & 2) = 2)::INT AS tcp_flags_syn_flood FROM (SELECT frame_no, coalesce(tcp_flags, 0) AS f FROM packets)""",
)
def _(spark, sf):
    return scalar.anomaly_features(packets(spark, sf))


@query(
    "scalar_suspicious_tld", "frame_no dns_suspicious_tld",
    r"SELECT frame_no, coalesce(regexp_matches(dns_qry_name, '\.(tk|ml|ga|cf)$', 'i'), false)::INT AS dns_suspicious_tld FROM packets",
)
def _(spark, sf):
    return scalar.anomaly_features(packets(spark, sf))


@query("scalar_entropy_urls", "page_id entropy:f url_length", f"SELECT page_id, {entropy_of('url')} AS entropy, length(url) AS url_length FROM pages", "")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", char_entropy(F.col("url")).alias("entropy"), F.length("url").alias("url_length"))


@query(
    "scalar_dns", "frame_no dns_qry_name_len dns_qry_name_entropy:f dns_response_ip_to_query_ratio:f",
    f"""SELECT frame_no, coalesce(length(dns_qry_name), 0) AS dns_qry_name_len, {entropy_of('dns_qry_name')} AS dns_qry_name_entropy,
        coalesce(len(string_split(dns_response_ip, ',')), 0) / (CAST(dns_an_count AS DOUBLE) + 1e-6) AS dns_response_ip_to_query_ratio
        FROM packets""",
)
def _(spark, sf):
    return scalar.dns_features(packets(spark, sf))


@query(
    "scalar_dga", "frame_no dga_domain_entropy:f dga_numeric_ratio:f dga_score:f is_dga_domain",
    f"""SELECT *, coalesce(dga_score > 1.0, false)::INT AS is_dga_domain FROM (
          SELECT *, dga_domain_entropy / 4.0 + dga_numeric_ratio * 2.0 AS dga_score FROM (
            SELECT frame_no, {entropy_of("regexp_replace(dns_qry_name, '[.][^.]*$', '')")} AS dga_domain_entropy,
              coalesce(length(regexp_replace(dns_qry_name, '[^0-9]', '', 'g')) / length(dns_qry_name), 0) AS dga_numeric_ratio
            FROM packets))""",
)
def _(spark, sf):
    return scalar.dga_features(packets(spark, sf))


@query(
    "scalar_ports_and_sizes", "frame_no is_common_port is_high_port is_jumbo_frame is_tiny_packet",
    f"""SELECT frame_no, (dst_port IN {scalar.COMMON_PORTS})::INT AS is_common_port, (dst_port > 1024)::INT AS is_high_port,
        (frame_len > 1500)::INT AS is_jumbo_frame, (frame_len < 64)::INT AS is_tiny_packet FROM packets""",
)
def _(spark, sf):
    return scalar.security_features(packets(spark, sf))


@query(
    "scalar_private_ips", "frame_no src_is_private dst_is_private",
    f"SELECT frame_no, {ip_private('src_ip')}::INT AS src_is_private, {ip_private('dst_ip')}::INT AS dst_is_private FROM packets",
)
def _(spark, sf):
    return scalar.security_features(packets(spark, sf))


@query("scalar_ip_to_number", "frame_no src dst", f"SELECT frame_no, {ip_number('src_ip')} AS src, {ip_number('dst_ip')} AS dst FROM packets")
def _(spark, sf):
    return packets(spark, sf).select(
        "frame_no", net.ipv4_to_long("src_ip").alias("src"), net.ipv4_to_long("dst_ip").alias("dst")
    )


@query(
    "scalar_http_uri", "frame_no http_uri_length http_uri_entropy:f",
    f"SELECT frame_no, coalesce(length(http_request_uri), 0) AS http_uri_length, {entropy_of('http_request_uri')} AS http_uri_entropy FROM packets",
)
def _(spark, sf):
    return scalar.http_features(packets(spark, sf))


@query(
    "scalar_http_methods", "frame_no " + " ".join(f"http_method_{m.lower()}" for m in scalar.HTTP_METHODS),
    "SELECT frame_no, " + ", ".join(
        f"coalesce(http_request_method = '{m}', false)::INT AS http_method_{m.lower()}" for m in scalar.HTTP_METHODS
    ) + " FROM packets",
)
def _(spark, sf):
    return scalar.http_features(packets(spark, sf))


_CLASSES = "http_rsp_success http_rsp_redirect http_rsp_client_error http_rsp_server_error"
STEPS["classed"] = "SELECT *, " + ", ".join(
    f"coalesce(http_response_code BETWEEN {200 + 100 * i} AND {299 + 100 * i}, false)::INT AS {c}" for i, c in enumerate(_CLASSES.split())
) + " FROM packets"


@query("scalar_http_responses", "frame_no " + _CLASSES, "SELECT * FROM classed", "packets classed")
def _(spark, sf):
    return scalar.http_features(packets(spark, sf))


@query(
    "scalar_sql", "frame_no sql_query_length sql_query_entropy:f sql_contains_suspicious_keywords",
    f"""SELECT frame_no, coalesce(length(sql_query), 0) AS sql_query_length, {entropy_of('sql_query')} AS sql_query_entropy,
        coalesce(regexp_matches(sql_query, '{'|'.join(scalar.SUSPICIOUS_SQL)}', 'i'), false)::INT AS sql_contains_suspicious_keywords
        FROM packets""",
)
def _(spark, sf):
    return scalar.sql_features(packets(spark, sf))


@query(
    "scalar_ssh", "frame_no ssh_is_v2 ssh_server_is_potentially_vulnerable",
    """SELECT frame_no, coalesce(regexp_matches(ssh_protocol, '2.0'), false)::INT AS ssh_is_v2,
       coalesce(regexp_matches(ssh_server_version, 'OpenSSH_7.4'), false)::INT AS ssh_server_is_potentially_vulnerable FROM packets""",
)
def _(spark, sf):
    return scalar.ssh_features(packets(spark, sf))


@query("scalar_tls", "frame_no tls_ja3:s", "SELECT frame_no, coalesce(CAST(length(tls_ja3) AS VARCHAR), '') AS tls_ja3 FROM packets")
def _(spark, sf):
    return scalar.tls_features(packets(spark, sf).withColumn("tls_ja3", F.length("tls_ja3")))


_TOKENS = "regexp_extract_all(payload, '..')"


@query(
    "scalar_payload", "frame_no payload_entropy:f payload_printable_char_ratio:f",
    f"""SELECT frame_no, list_aggregate({_TOKENS}, 'entropy') AS payload_entropy,
        len(list_filter({_TOKENS}, lambda t: t BETWEEN '20' AND '7e' OR t BETWEEN '09' AND '0d')) / len({_TOKENS}) AS payload_printable_char_ratio
        FROM packets""",
)
def _(spark, sf):
    return scalar.payload_features(packets(spark, sf))


@query(
    "scalar_calendar", "frame_no hour_of_day day_of_week is_business_hours",
    """SELECT frame_no, hour(timestamp) AS hour_of_day, isodow(timestamp) - 1 AS day_of_week,
       (hour(timestamp) BETWEEN 9 AND 17)::INT AS is_business_hours FROM packets""",
)
def _(spark, sf):
    return scalar.calendar_features(packets(spark, sf))


STEPS["keyed"] = """SELECT *, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port AS flow_key,
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND CAST(src_port AS VARCHAR) <= CAST(dst_port AS VARCHAR))
       THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port
       ELSE dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port END || '-' || protocol AS session_key,
  CASE WHEN starts_with(src_ip, '172.19.') THEN 'outbound' ELSE 'inbound' END AS direction FROM classed"""


@query("scalar_session_key", "frame_no session_key:s direction:s", "SELECT * FROM keyed", "packets classed keyed")
def _(spark, sf):
    from packetloom.operators.session import with_session_key

    return with_session_key(packets(spark, sf))


@query(
    "scalar_flow_keys", "frame_no flow_key:s reverse_key:s is_local",
    """SELECT frame_no, flow_key, dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port AS reverse_key,
       starts_with(src_ip, '172.19.')::INT AS is_local FROM keyed""",
    "packets classed keyed",
)
def _(spark, sf):
    return packets(spark, sf).select(
        "frame_no", net.flow_key().alias("flow_key"), net.reverse_flow_key().alias("reverse_key"),
        net.in_networks("src_ip").cast("int").alias("is_local"),
    )


@query("scalar_small_packet", "frame_no is_small_packet", "SELECT frame_no, (frame_len < 64)::INT AS is_small_packet FROM packets")
def _(spark, sf):
    return packets(spark, sf).select("frame_no", scalar.flag(F.col("frame_len") < 64).alias("is_small_packet"))
