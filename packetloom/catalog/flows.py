"""Queries for flows, hosts, sessions and round-trip times."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.base import RTT_TIMEOUT, SLICE, STEPS, WINDOW, packets, query
from packetloom.catalog.scalar import entropy_of
from packetloom.functions.timing import floor_time
from packetloom.operators import flow, host, report, rtt, scalar, session, sketches
from packetloom.operators.slices import forward_fill, previous_value

_KEY = "src_ip, dst_ip, src_port, dst_port, protocol"
_PACKET = "frame_no src_ip:s dst_ip:s src_port dst_port protocol:s"

STEPS["gaps"] = f"""SELECT *, coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp))
    OVER (PARTITION BY {_KEY} ORDER BY timestamp, frame_no), 0) AS gap_us, gap_us / 1e6 AS gap FROM keyed"""
STEPS["flows"] = f"""SELECT *, flow_pkt_count / (flow_duration_seconds + 1e-6) AS flow_pkts_per_sec,
    flow_byte_count / (flow_duration_seconds + 1e-6) AS flow_bytes_per_sec,
    flow_byte_count / flow_pkt_count AS flow_bytes_per_packet,
    (flow_duration_seconds < 1.0)::INT AS flow_is_short, (flow_duration_seconds > 300.0)::INT AS flow_is_long,
    (flow_pkt_count = 1)::INT AS flow_is_single_packet,
    flow_std_pkt_size * flow_std_pkt_size AS flow_pkt_size_variance,
    flow_std_pkt_size / (flow_mean_pkt_size + 1e-6) AS flow_pkt_size_cv
  FROM (SELECT {_KEY}, any_value(flow_key) AS flow_key, any_value(session_key) AS session_key, any_value(direction) AS direction,
    count(frame_len) AS flow_pkt_count, sum(frame_len) AS flow_byte_count, avg(frame_len) AS flow_mean_pkt_size,
    stddev_samp(frame_len) AS flow_std_pkt_size, min(timestamp) AS flow_start_time, max(timestamp) AS flow_end_time,
    avg(gap_us) / 1e6 AS flow_inter_arrival_time_mean, stddev_samp(gap_us) / 1e6 AS flow_inter_arrival_time_stddev,
    max(gap_us) / 1e6 AS flow_inter_arrival_time_max, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS flow_duration_seconds,
    sum(http_rsp_success) AS http_rsp_success_sum, sum(http_rsp_redirect) AS http_rsp_redirect_sum,
    sum(http_rsp_client_error) AS http_rsp_client_error_sum, sum(http_rsp_server_error) AS http_rsp_server_error_sum
    FROM gaps GROUP BY {_KEY})"""
FLOW_STEPS = "packets classed keyed gaps flows"

_FLOW_STATS = (
    "flow_pkt_count flow_byte_count flow_mean_pkt_size:f flow_std_pkt_size:f flow_start_time:t flow_end_time:t "
    "flow_inter_arrival_time_mean:f flow_inter_arrival_time_stddev:f flow_inter_arrival_time_max:f "
    "http_rsp_success_sum http_rsp_redirect_sum http_rsp_client_error_sum http_rsp_server_error_sum"
)
_FLOW_DERIVED = (
    "flow_duration_seconds:f flow_pkts_per_sec:f flow_bytes_per_sec:f flow_bytes_per_packet:f flow_is_short flow_is_long "
    "flow_is_single_packet flow_pkt_size_variance:f flow_pkt_size_cv:f"
)
_KEYS = "src_ip:s dst_ip:s src_port dst_port protocol:s"


def _flows(spark, sf):
    return flow.flow_table(scalar.http_features(packets(spark, sf)))


@query(
    "flagship_top_sources", "src_ip:s packets mean_flow_duration:f",
    f"""SELECT src_ip, count(*) AS packets, avg(flow_duration_seconds) AS mean_flow_duration
        FROM packets JOIN (SELECT {_KEY}, flow_duration_seconds FROM flows) USING ({_KEY})
        GROUP BY src_ip ORDER BY packets DESC, src_ip LIMIT 5""",
    FLOW_STEPS,
)
def _(spark, sf):
    return report.busiest_sources(packets(spark, sf))


@query("flow_gaps", _PACKET + " inter_arrival_time:f", "SELECT *, gap AS inter_arrival_time FROM gaps", "packets classed keyed gaps")
def _(spark, sf):
    return flow.flow_gaps(packets(spark, sf))


@query("flow_stats", _KEYS + " " + _FLOW_STATS, "SELECT * FROM flows", FLOW_STEPS)
def _(spark, sf):
    return _flows(spark, sf)


@query("flow_derived", _KEYS + " " + _FLOW_DERIVED, "SELECT * FROM flows", FLOW_STEPS)
def _(spark, sf):
    return _flows(spark, sf)


@query("flow_shape_flags", _KEYS + " flow_is_short flow_is_long flow_is_single_packet", "SELECT * FROM flows", FLOW_STEPS)
def _(spark, sf):
    return _flows(spark, sf)


@query(
    "flow_merge_back", f"{_PACKET} {_FLOW_STATS} {_FLOW_DERIVED}",
    f"SELECT p.frame_no, f.* FROM packets p JOIN flows f USING ({_KEY})", FLOW_STEPS,
)
def _(spark, sf):
    return flow.with_flow_features(scalar.http_features(packets(spark, sf)), SLICE)


@query(
    "flow_slow_connections", _KEYS + " flow_duration_seconds:f flow_pkt_count flow_byte_count",
    "SELECT * FROM flows WHERE flow_duration_seconds >= 86400 AND flow_pkt_count <= 4 AND flow_byte_count <= 1000", FLOW_STEPS,
)
def _(spark, sf):
    return flow.slow_connections(flow.flow_table(packets(spark, sf)), 86_400, 4, 1_000)


# ---- hosts ----

STEPS["named"] = f"""SELECT *, coalesce(length(dns_qry_name), 0) AS qlen, {entropy_of('dns_qry_name')} AS qent,
    time_bucket(INTERVAL 1 HOUR, timestamp, TIMESTAMP '1970-01-01') AS time_window FROM keyed"""
STEPS["src_hosts"] = """SELECT src_ip, time_window, count(frame_len) AS src_host_pkt_count_win, sum(frame_len) AS src_host_byte_count_win,
    count(DISTINCT dst_ip) AS src_host_distinct_dst_ips_win, count(DISTINCT dst_port) AS src_host_distinct_dst_ports_win,
    entropy(dst_port) AS src_host_dst_port_entropy_win, avg(qlen) AS src_host_dns_qry_len_mean_win,
    stddev_samp(qlen) AS src_host_dns_qry_len_std_win, avg(qent) AS src_host_dns_qry_entropy_mean_win,
    stddev_samp(qent) AS src_host_dns_qry_entropy_std_win, count(DISTINCT tls_ja3) AS src_host_distinct_ja3_win,
    count(DISTINCT dst_ip) - coalesce(lag(count(DISTINCT dst_ip)) OVER (PARTITION BY src_ip ORDER BY time_window), count(DISTINCT dst_ip))
      AS src_host_session_freq_change_win
    FROM named GROUP BY src_ip, time_window"""
STEPS["dst_hosts"] = """SELECT dst_ip, time_window, count(frame_len) AS dst_host_pkt_count_win, sum(frame_len) AS dst_host_byte_count_win,
    count(DISTINCT src_ip) AS dst_host_distinct_src_ips_win FROM named GROUP BY dst_ip, time_window"""
HOST_STEPS = "packets classed keyed named src_hosts dst_hosts"

_SRC = (
    "src_host_pkt_count_win src_host_byte_count_win src_host_distinct_dst_ips_win src_host_distinct_dst_ports_win "
    "src_host_dst_port_entropy_win:f src_host_dns_qry_len_mean_win:f src_host_dns_qry_len_std_win:f "
    "src_host_dns_qry_entropy_mean_win:f src_host_dns_qry_entropy_std_win:f src_host_distinct_ja3_win"
)
_DST = "dst_host_pkt_count_win dst_host_byte_count_win dst_host_distinct_src_ips_win"


@query("host_windows_src", "src_ip:s time_window:t " + _SRC, "SELECT * FROM src_hosts", HOST_STEPS)
def _(spark, sf):
    return host.src_host_windows(scalar.dns_features(packets(spark, sf)), WINDOW)


@query("host_windows_dst", "dst_ip:s time_window:t " + _DST, "SELECT * FROM dst_hosts", HOST_STEPS)
def _(spark, sf):
    return host.dst_host_windows(packets(spark, sf), WINDOW)


@query("host_frequency_change", "src_ip:s time_window:t src_host_session_freq_change_win", "SELECT * FROM src_hosts", HOST_STEPS)
def _(spark, sf):
    return host.src_host_windows(packets(spark, sf), WINDOW)


@query(
    "host_grouped_entropy", "src_ip:s port_entropy:f distinct_ports",
    "SELECT src_ip, entropy(dst_port) AS port_entropy, count(DISTINCT dst_port) AS distinct_ports FROM packets GROUP BY src_ip",
)
def _(spark, sf):
    return host.grouped_entropy(packets(spark, sf), ["src_ip"], "dst_port", "port_entropy", "distinct_ports")


@query(
    "host_distinct_peers", "src_ip:s peers ja3s",
    "SELECT src_ip, count(DISTINCT dst_ip) AS peers, count(DISTINCT tls_ja3) AS ja3s FROM packets GROUP BY src_ip",
)
def _(spark, sf):
    return packets(spark, sf).groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("peers"), F.count_distinct("tls_ja3").alias("ja3s"))


@query("host_distinct_peers_sketch", "src_ip:s time_window:t src_host_distinct_dst_ips_win src_host_distinct_ja3_win")
def _(spark, sf):
    return host.src_host_windows(packets(spark, sf), WINDOW, rsd=0.02)


@query(
    "host_distinct_peers_sketch_error", "src_ip:s time_window:t exact close",
    """SELECT src_ip, date_trunc('hour', timestamp) AS time_window, count(DISTINCT dst_ip) AS exact, 1 AS close FROM packets GROUP BY ALL""",
)
def _(spark, sf):
    # The sketch of each window beside the exact count: within three times its stated deviation.
    rows = packets(spark, sf)
    sketch = host.src_host_windows(rows, WINDOW, rsd=0.02).select("src_ip", "time_window", "src_host_distinct_dst_ips_win")
    exact = host.src_host_windows(rows, WINDOW).select("src_ip", "time_window", F.col("src_host_distinct_dst_ips_win").alias("exact"))
    error = F.abs(F.col("src_host_distinct_dst_ips_win") - F.col("exact"))
    return exact.join(sketch, ["src_ip", "time_window"], "left").withColumn("close", (error <= 3 * 0.02 * F.col("exact")).cast("int"))


_WIDTHS = {"hour": "1 hour", "quarter": "6 hours", "day": "1 day"}


@query(
    "host_distinct_peers_by_width", "src_ip:s width:s time_window:t exact close",
    " UNION ALL ".join(
        f"SELECT src_ip, '{name}' AS width, time_bucket(INTERVAL '{w}', timestamp) AS time_window, count(DISTINCT dst_ip) AS exact, 1 AS close FROM packets GROUP BY ALL"
        for name, w in _WIDTHS.items()
    ),
)
def _(spark, sf):
    # Three widths from one table of hourly sketches, each beside the exact count: within three times the stated deviation.
    rows = packets(spark, sf)
    hourly = sketches.distinct_sketches(rows, ["src_ip"], ["dst_ip"], "1 hour")
    wide = sketches.merged_sketches(hourly, ["src_ip"], ["dst_ip"], _WIDTHS)
    times = F.array(*[F.struct(F.lit(n).alias("width"), floor_time(F.col("timestamp"), w).alias("time_window")) for n, w in _WIDTHS.items()])
    exact = rows.select("src_ip", "dst_ip", F.explode(times).alias("t")).groupBy("src_ip", "t.width", "t.time_window").agg(F.count_distinct("dst_ip").alias("exact"))
    error = F.abs(F.col("dst_ip_distinct") - F.col("exact"))
    return exact.join(wide, ["src_ip", "width", "time_window"], "left").withColumn("close", (error <= 3 * sketches.deviation() * F.col("exact")).cast("int"))


_HOST_MERGE = "SELECT p.frame_no, s.*, d.* FROM named p JOIN src_hosts s USING (src_ip, time_window) JOIN dst_hosts d USING (dst_ip, time_window)"


@query(
    "host_merge_src", f"frame_no src_ip:s {_SRC} src_host_session_freq_change_win",
    "SELECT frame_no, s.* REPLACE (coalesce(src_host_dns_qry_len_std_win, 0) AS src_host_dns_qry_len_std_win, "
    "coalesce(src_host_dns_qry_entropy_std_win, 0) AS src_host_dns_qry_entropy_std_win) "
    "FROM named p JOIN src_hosts s USING (src_ip, time_window)", HOST_STEPS,
)
def _(spark, sf):
    return host.with_host_features(scalar.dns_features(packets(spark, sf)), WINDOW, SLICE)


@query(
    "host_merge_dst", f"frame_no dst_ip:s {_DST}",
    "SELECT frame_no, d.* FROM named p JOIN dst_hosts d USING (dst_ip, time_window)", HOST_STEPS,
)
def _(spark, sf):
    return host.with_host_features(packets(spark, sf), WINDOW, "10 minutes")


@query(
    "host_forward_fill", "frame_no src_ip:s http_response_code dns_qry_type",
    """SELECT frame_no, src_ip,
       last_value(http_response_code IGNORE NULLS) OVER w AS http_response_code, last_value(dns_qry_type IGNORE NULLS) OVER w AS dns_qry_type
       FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY timestamp, frame_no ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    return forward_fill(packets(spark, sf), ["src_ip"], ["http_response_code", "dns_qry_type"])


@query(
    "temporal_pair_gaps", "frame_no src_ip:s dst_ip:s inter_arrival_time:f",
    """SELECT frame_no, src_ip, dst_ip, (epoch_us(timestamp) - lag(epoch_us(timestamp))
       OVER (PARTITION BY src_ip, dst_ip ORDER BY timestamp, frame_no)) / 1e6 AS inter_arrival_time FROM packets""",
)
def _(spark, sf):
    return host.with_pair_gaps(packets(spark, sf))


def _trailing(us: int) -> str:
    return (
        f"count(frame_len) OVER (PARTITION BY src_ip ORDER BY epoch_us(timestamp) "
        f"RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW)"
    )


@query(
    "temporal_trailing_counts", "frame_no src_ip:s packets_in_1s_window packets_in_1h_window packets_in_12h_window",
    f"SELECT frame_no, src_ip, {_trailing(10**6)} AS packets_in_1s_window, {_trailing(3600 * 10**6)} AS packets_in_1h_window, "
    f"{_trailing(43200 * 10**6)} AS packets_in_12h_window FROM packets",
)
def _(spark, sf):
    widths = {"packets_in_1s_window": "1s", "packets_in_1h_window": "1h", "packets_in_12h_window": "12h"}
    return host.trailing_counts(packets(spark, sf), widths)


@query(
    "window_sliding_sources", "src_ip:s window_start:t pkt_count byte_count",
    """SELECT src_ip, window_start, count(*) AS pkt_count, sum(frame_len) AS byte_count FROM (
         SELECT src_ip, frame_len, unnest([time_bucket(INTERVAL 1 HOUR, timestamp, TIMESTAMP '1970-01-01'),
           time_bucket(INTERVAL 1 HOUR, timestamp, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS window_start FROM packets)
       GROUP BY ALL""",
)
def _(spark, sf):
    return host.sliding_src_windows(packets(spark, sf), "2 hours", "1 hour")


@query(
    "window_time_chunks", "chunk_start:t packets bytes",
    """SELECT time_bucket(INTERVAL 300 SECOND, timestamp, TIMESTAMP '1970-01-01') AS chunk_start, count(*) AS packets,
       sum(frame_len) AS bytes FROM packets GROUP BY 1""",
)
def _(spark, sf):
    return host.time_chunks(packets(spark, sf))


# ---- sessions ----

STEPS["sessions"] = """SELECT *, outbound_frame_len_sum / (inbound_frame_len_sum + 1e-6) AS session_bytes_ratio,
    outbound_frame_len_count / (inbound_frame_len_count + 1e-6) AS session_packets_ratio,
    small_packet_count / total_packets AS small_packet_ratio, session_duration - session_active_time AS session_idle_time,
    session_active_time / (session_duration - session_active_time + 1e-6) AS active_idle_ratio,
    total_packets / (session_duration + 1e-6) AS packets_per_second, total_bytes / (session_duration + 1e-6) AS bytes_per_second
  FROM (SELECT session_key, arg_min(src_ip, (timestamp, frame_no)) AS src_ip_first, arg_min(dst_ip, (timestamp, frame_no)) AS dst_ip_first,
    arg_min(src_port, (timestamp, frame_no)) AS src_port_first, arg_min(dst_port, (timestamp, frame_no)) AS dst_port_first,
    arg_min(protocol, (timestamp, frame_no)) AS protocol_first, count(frame_len) AS total_packets, sum(frame_len) AS total_bytes,
    avg(frame_len) AS avg_packet_size, stddev_samp(frame_len) AS std_packet_size, max(flow_duration_seconds) AS session_duration,
    min(timestamp) AS session_start, max(timestamp) AS session_end,
    count(*) FILTER (direction = 'inbound') AS inbound_frame_len_count, coalesce(sum(frame_len) FILTER (direction = 'inbound'), 0) AS inbound_frame_len_sum,
    count(*) FILTER (direction = 'outbound') AS outbound_frame_len_count, coalesce(sum(frame_len) FILTER (direction = 'outbound'), 0) AS outbound_frame_len_sum,
    count(*) FILTER (frame_len < 64) AS small_packet_count, sum(flow_duration_seconds) AS session_active_time
    FROM keyed JOIN (SELECT src_ip, dst_ip, src_port, dst_port, protocol, flow_duration_seconds FROM flows)
      USING (src_ip, dst_ip, src_port, dst_port, protocol) GROUP BY session_key)"""
SESSION_STEPS = FLOW_STEPS + " sessions"

_SESSION = (
    "src_ip_first:s dst_ip_first:s src_port_first dst_port_first protocol_first:s total_packets total_bytes avg_packet_size:f "
    "std_packet_size:f session_duration:f session_start:t session_end:t"
)
_SIDES = "inbound_frame_len_count inbound_frame_len_sum outbound_frame_len_count outbound_frame_len_sum"
_RATIOS = (
    "session_bytes_ratio:f session_packets_ratio:f small_packet_count small_packet_ratio:f session_active_time:f "
    "session_idle_time:f active_idle_ratio:f packets_per_second:f bytes_per_second:f"
)


def _sessions(spark, sf):
    return session.session_table(packets(spark, sf))


@query("session_stats", "session_key:s " + _SESSION, "SELECT * FROM sessions", SESSION_STEPS)
def _(spark, sf):
    return _sessions(spark, sf)


@query("session_directions", "session_key:s " + _SIDES, "SELECT * FROM sessions", SESSION_STEPS)
def _(spark, sf):
    return _sessions(spark, sf)


@query("session_ratios", "session_key:s " + _RATIOS, "SELECT * FROM sessions", SESSION_STEPS)
def _(spark, sf):
    return _sessions(spark, sf)


@query("session_combined", f"session_key:s {_SESSION} {_SIDES} {_RATIOS}", "SELECT * FROM sessions", SESSION_STEPS)
def _(spark, sf):
    return _sessions(spark, sf)


@query(
    "session_merge_back", f"frame_no session_key:s direction:s {_SIDES} total_packets total_bytes",
    "SELECT * FROM (SELECT frame_no, session_key, direction FROM keyed) JOIN sessions USING (session_key)", SESSION_STEPS,
)
def _(spark, sf):
    return session.with_session_features(packets(spark, sf), SLICE)


@query(
    "session_flag_histogram", "session_key:s direction:s histogram:s",
    """SELECT session_key, direction, string_agg(tcp_flags || '=' || n, ',' ORDER BY tcp_flags) AS histogram FROM (
         SELECT session_key, direction, tcp_flags, count(*) AS n FROM keyed WHERE tcp_flags IS NOT NULL GROUP BY ALL)
       GROUP BY ALL""",
    "packets classed keyed",
)
def _(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("tcp_flags")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return session.session_flag_histogram(packets(spark, sf)).select("session_key", "direction", F.array_join(pairs, ",").alias("histogram"))


@query(
    "session_initiator_counts", "session_key:s flow_fwd_pkt_count flow_bwd_pkt_count",
    """SELECT session_key, count(*) FILTER (src_ip = first_ip AND src_port = first_port) AS flow_fwd_pkt_count,
       count(*) FILTER (NOT (src_ip = first_ip AND src_port = first_port)) AS flow_bwd_pkt_count FROM (
         SELECT *, first_value(src_ip) OVER w AS first_ip, first_value(src_port) OVER w AS first_port FROM keyed
         WINDOW w AS (PARTITION BY session_key ORDER BY timestamp, frame_no)) GROUP BY session_key""",
    "packets classed keyed",
)
def _(spark, sf):
    return session.initiator_counts(packets(spark, sf))


# ---- round-trip times ----

STEPS["shakes"] = """SELECT s.flow_key, (s2.t - s.t) / 1000.0 AS rtt_ms
  FROM (SELECT flow_key, max(epoch_us(timestamp)) AS t FROM keyed WHERE protocol = 'TCP' AND tcp_flags & 2 <> 0 AND starts_with(src_ip, '172.19.') GROUP BY 1) s
  JOIN (SELECT dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port AS flow_key, max(epoch_us(timestamp)) AS t
        FROM keyed WHERE protocol = 'TCP' AND tcp_flags & 2 <> 0 AND NOT starts_with(src_ip, '172.19.') GROUP BY 1) s2 USING (flow_key)
  WHERE s2.t > s.t AND s2.t - s.t < 40 * 86400000000"""


def _ack_step(key: str) -> str:
    return f"""SELECT k.*, CASE WHEN a.t > epoch_us(timestamp) AND a.t - epoch_us(timestamp) < 40 * 86400000000
                THEN (a.t - epoch_us(timestamp)) / 1000.0 END AS rtt_ack_ms
      FROM keyed k LEFT JOIN (SELECT {key} AS flow_key, tcp_ack, max(epoch_us(timestamp)) AS t FROM keyed
        WHERE protocol = 'TCP' AND tcp_flags & 16 <> 0 GROUP BY 1, 2) a
      ON k.protocol = 'TCP' AND k.flow_key = a.flow_key AND k.tcp_seq + greatest(1, ip_len - 40) = a.tcp_ack"""


STEPS["acked"] = _ack_step("flow_key")
STEPS["samples"] = """SELECT acked.*, rtt_ms, coalesce((rtt_ms + rtt_ack_ms) / 2, rtt_ms, rtt_ack_ms) AS rtt_combined_ms
  FROM acked LEFT JOIN shakes USING (flow_key)"""
STEPS["rtts"] = """SELECT flow_key, avg(rtt_combined_ms) AS avg_rtt_ms, stddev_samp(rtt_combined_ms) AS std_rtt_ms,
  min(rtt_combined_ms) AS min_rtt_ms, max(rtt_combined_ms) AS max_rtt_ms, count(rtt_combined_ms) AS rtt_sample_count
  FROM samples GROUP BY flow_key"""
RTT_STEPS = "packets classed keyed shakes acked samples rtts"
_RTT = "avg_rtt_ms:f std_rtt_ms:g min_rtt_ms:f max_rtt_ms:f rtt_sample_count"


@query("rtt_handshake", "flow_key:s rtt_ms:f", "SELECT * FROM shakes", "packets classed keyed shakes")
def _(spark, sf):
    return rtt.handshake_rtt(packets(spark, sf), RTT_TIMEOUT)


def _first_after(days: int) -> str:
    return f"""SELECT flow_key, min(d) / 1000.0 AS rtt_ms FROM (
         SELECT s.flow_key, s.frame_no, min(epoch_us(a.timestamp) - epoch_us(s.timestamp)) AS d
         FROM keyed s JOIN keyed a ON s.flow_key = a.dst_ip || ':' || a.dst_port || '-' || a.src_ip || ':' || a.src_port
           AND s.protocol = 'TCP' AND a.protocol = 'TCP' AND s.tcp_flags & 2 <> 0 AND a.tcp_flags & 2 <> 0
           AND starts_with(s.src_ip, '172.19.') AND NOT starts_with(a.src_ip, '172.19.')
           AND a.timestamp >= s.timestamp AND epoch_us(a.timestamp) - epoch_us(s.timestamp) < {days} * 86400000000
         GROUP BY ALL) WHERE d > 0 GROUP BY flow_key"""


@query("rtt_handshake_first_after", "flow_key:s rtt_ms:f", _first_after(20), "packets classed keyed")
def _(spark, sf):
    return rtt.handshake_rtt(packets(spark, sf), "20 days", match="first_after")


@query("rtt_handshake_first_after_40_days", "flow_key:s rtt_ms:f", _first_after(40), "packets classed keyed")
def _(spark, sf):
    return rtt.handshake_rtt(packets(spark, sf), "40 days", match="first_after", size=100)


@query("temporal_gaps_in_small_slots", "frame_no src_ip:s inter_arrival_time:f", "SELECT frame_no, src_ip, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY src_ip ORDER BY timestamp, frame_no)) / 1e6 AS inter_arrival_time FROM packets")
def _(spark, sf):
    df = previous_value(packets(spark, sf), ["src_ip"], F.unix_micros("timestamp"), "before", size=100)
    return df.withColumn("inter_arrival_time", (F.unix_micros("timestamp") - F.col("before")) / 1e6)


@query("rtt_ack_latency", "frame_no flow_key:s rtt_ack_ms:f", "SELECT * FROM acked", "packets classed keyed acked")
def _(spark, sf):
    return rtt.with_ack_rtt(packets(spark, sf), RTT_TIMEOUT)


@query(
    "rtt_ack_latency_reverse", "frame_no flow_key:s rtt_ack_ms:f",
    _ack_step("dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port"), "packets classed keyed",
)
def _(spark, sf):
    return rtt.with_ack_rtt(packets(spark, sf), RTT_TIMEOUT, "reverse")


@query("rtt_stats", f"flow_key:s {_RTT}", "SELECT * FROM rtts", RTT_STEPS)
def _(spark, sf):
    return rtt.rtt_table(packets(spark, sf), RTT_TIMEOUT, width=SLICE)


@query(
    "rtt_merge_back", f"frame_no rtt_ms:f rtt_ack_ms:f rtt_combined_ms:f {_RTT}",
    "SELECT * FROM samples JOIN rtts USING (flow_key)", RTT_STEPS,
)
def _(spark, sf):
    return rtt.with_rtt_features(packets(spark, sf), RTT_TIMEOUT, width=SLICE)
