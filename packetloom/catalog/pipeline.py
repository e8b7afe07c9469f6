"""Queries for the whole feature pipeline and a detection run."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.base import RTT_TIMEOUT, SLICE, STEPS, WINDOW, packets, query, table
from packetloom.catalog.clients import client_sessions
from packetloom.catalog.flows import FLOW_STEPS, RTT_STEPS
from packetloom.plans import detect, features
from packetloom.session import settled
from packetloom.sources.records import canonical, union_records

OPTIONS = features.FeatureOptions(slice_width=SLICE, host_window=WINDOW, rtt_timeout=RTT_TIMEOUT, quality_control=False)

_STEPS = list(dict.fromkeys(f"{FLOW_STEPS} named src_hosts dst_hosts sessions {RTT_STEPS}".split()))
STEPS["everything"] = """SELECT p.frame_no, p.src_ip, p.session_key, coalesce(p.tcp_flags, 0) & 1 AS tcp_flag_fin, p.qlen AS dns_qry_name_len,
    flow_pkt_count, flow_bytes_per_sec, flow_inter_arrival_time_max, total_packets, session_bytes_ratio, src_host_pkt_count_win,
    src_host_dst_port_entropy_win, dst_host_distinct_src_ips_win, rtt_sample_count, avg_rtt_ms, rtt_combined_ms,
    (epoch_us(p.timestamp) - lag(epoch_us(p.timestamp)) OVER (PARTITION BY p.src_ip, p.dst_ip ORDER BY p.timestamp, p.frame_no)) / 1e6 AS inter_arrival_time,
    hour(p.timestamp) AS hour_of_day
  FROM named p JOIN (SELECT src_ip, dst_ip, src_port, dst_port, protocol, flow_pkt_count, flow_bytes_per_sec, flow_inter_arrival_time_max FROM flows) f
      USING (src_ip, dst_ip, src_port, dst_port, protocol)
    JOIN sessions USING (session_key) JOIN src_hosts USING (src_ip, time_window) JOIN dst_hosts USING (dst_ip, time_window)
    JOIN rtts ON rtts.flow_key = p.flow_key JOIN (SELECT frame_no, rtt_combined_ms FROM samples) s ON s.frame_no = p.frame_no"""


@query(
    "pipeline_features",
    "frame_no src_ip:s session_key:s tcp_flag_fin dns_qry_name_len flow_pkt_count flow_bytes_per_sec:f flow_inter_arrival_time_max:f "
    "total_packets session_bytes_ratio:f src_host_pkt_count_win src_host_dst_port_entropy_win:f dst_host_distinct_src_ips_win "
    "rtt_sample_count avg_rtt_ms:f rtt_combined_ms:f inter_arrival_time:f hour_of_day",
    "SELECT * FROM everything", " ".join([*_STEPS, "everything"]),
)
def _(spark, sf):
    return features.build_features(packets(spark, sf), OPTIONS)


@query("pipeline_detection", "client_ip:s frame_no score:f final_score:f result_type:s severity:s anomaly")
def _(spark, sf):
    built = features.build_features(packets(spark, sf), OPTIONS)
    vectors = settled(detect.session_vectors(built, "1 day"))
    models = detect.train(vectors, contamination=0.1, length=5, encoding_dim=8)
    return detect.detect(vectors, models, length=5, high=0.6, suspicious=0.5, sequence=0.5)


@query(
    "source_union", "frame_no src_ip:s protocol:s dns_qry_name:s sql_query:s",
    """SELECT frame_no, src_ip, protocol, dns_qry_name, CAST(NULL AS VARCHAR) AS sql_query FROM packets WHERE protocol = 'DNS'
       UNION ALL SELECT frame_no, src_ip, protocol, NULL, sql_query FROM packets WHERE protocol <> 'DNS'""",
)
def _(spark, sf):
    df = packets(spark, sf)
    parts = [
        df.where("protocol = 'DNS'").select("frame_no", "src_ip", "protocol", "dns_qry_name"),
        df.where("protocol <> 'DNS'").select("frame_no", "src_ip", "protocol", "sql_query"),
    ]
    return canonical(union_records(parts))


@query(
    "source_canonical", "frame_no timestamp:t http_request_uri:s http_user_agent:s tcp_seq",
    "SELECT event_id AS frame_no, ts AS timestamp, event_type AS http_request_uri, props AS http_user_agent, user_id AS tcp_seq FROM events", "",
)
def _(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("frame_no"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("event_type").alias("uri"), F.col("props").alias("user_agent"), F.col("user_id").alias("tcp_seq"),
    )
    return canonical(raw)


@query(
    "model_hold_out", "rows distinct_rows",
    "SELECT count(*) AS rows, count(*) AS distinct_rows FROM csessions", "packets csessions",
)
def _(spark, sf):
    train, test = detect.hold_out(client_sessions(spark, sf), 0.3)
    both = train.select("client_ip", "frame_no").unionByName(test.select("client_ip", "frame_no"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("client_ip", "frame_no").alias("distinct_rows"))
