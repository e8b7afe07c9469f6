"""The fixed packet schema (one row per dissected packet) and the feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()

_LAYERS: dict[str, list[tuple[str, T.DataType]]] = {
    "file": [("file_path", _STR), ("frame_no", _LONG)],
    "frame": [("timestamp", T.TimestampType()), ("frame_len", _INT), ("protocol", _STR), ("payload", _STR)],
    "ip": [("src_ip", _STR), ("dst_ip", _STR), ("ip_version", _INT), ("ip_ttl", _INT), ("ip_len", _INT)],
    "transport": [("src_port", _INT), ("dst_port", _INT)],
    "tcp": [
        ("tcp_flags", _INT), ("tcp_window_size", _INT), ("tcp_ack", _LONG), ("tcp_seq", _LONG),
        ("tcp_mss", _STR), ("tcp_window_scale", _STR), ("tcp_sack_permitted", _STR), ("tcp_timestamp", _STR),
        ("tcp_urgent_pointer", _INT), ("tcp_checksum", _STR),
    ],
    "icmp": [("icmp_type", _INT), ("icmp_code", _INT), ("icmp_checksum", _STR), ("icmp_id", _STR), ("icmp_seq", _STR)],
    "ssh": [("ssh_protocol", _STR), ("ssh_server_version", _STR), ("ssh_client_version", _STR)],
    "tds": [("sql_query", _STR)],
    "http": [
        ("http_header_count", _INT), ("http_content_type", _STR), ("http_content_length", _STR),
        ("http_referer", _STR), ("http_cookie", _STR), ("http_authorization", _STR), ("http_x_forwarded_for", _STR),
        ("http_server", _STR), ("http_location", _STR), ("http_request_method", _STR), ("http_request_uri", _STR),
        ("http_user_agent", _STR), ("http_host", _STR), ("http_response_code", _INT),
    ],
    "dns": [
        ("dns_id", _STR), ("dns_flags", _STR), ("dns_qr", _STR), ("dns_opcode", _STR), ("dns_rcode", _STR),
        ("dns_qd_count", _STR), ("dns_an_count", _STR), ("dns_response_ip", _STR), ("dns_qry_name", _STR),
        ("dns_qry_type", _INT),
    ],
    "tls": [("tls_ja3", _STR)],
}

PACKET_SCHEMA = T.StructType([T.StructField(n, t, True) for cols in _LAYERS.values() for n, t in cols])

# Order of packets everywhere: capture time, then place in the capture.
PACKET_ORDER = ("timestamp", "frame_no")
FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")

# Names other producers use for the canonical columns.
COLUMN_ALIASES = {"http_uri": "http_request_uri", "uri": "http_request_uri", "user_agent": "http_user_agent"}

# Default inputs of the isolation forest (fixed values).
MODEL_FEATURES = [
    "flow_pkt_count", "flow_byte_count", "flow_duration_seconds", "flow_pkts_per_sec", "flow_bytes_per_sec",
    "flow_bytes_per_packet", "src_host_pkt_count_win", "src_host_byte_count_win", "src_host_distinct_dst_ips_win",
    "src_host_distinct_dst_ports_win", "src_host_dst_port_entropy_win", "dst_host_pkt_count_win",
    "dst_host_byte_count_win", "dst_host_distinct_src_ips_win", "tcp_flag_syn", "tcp_flag_ack",
]
