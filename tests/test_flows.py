"""Hand-made packets: flows, sessions, hosts and round-trip times."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flow, host, rtt, session
from packetloom.operators.quality import cap_per_file, ingest_counters, validate

T0 = datetime(2024, 1, 1, 12)
SCHEMA = (
    "frame_no long, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "frame_len int, ip_len int, tcp_flags int, tcp_seq long, tcp_ack long"
)
CLIENT, SERVER = "172.19.0.5", "8.8.8.8"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def out(no, ms, flags=16, seq=0, ack=0, size=60, port=443, proto="TCP", src=CLIENT):
    return (no, at(ms), src, SERVER, 40000, port, proto, size, size - 14, flags, seq, ack)


def back(no, ms, flags=16, seq=0, ack=0, size=60, proto="TCP"):
    return (no, at(ms), SERVER, CLIENT, 443, 40000, proto, size, size - 14, flags, seq, ack)


def test_single_packet_flow_and_equal_times(spark):
    df = make(spark, [out(1, 0), out(2, 0, port=80), out(3, 0, port=80), out(4, 0, port=None)])
    flows = {r["dst_port"]: r for r in flow.flow_table(df).collect()}
    assert set(flows) == {443, 80}
    one, two = flows[443], flows[80]
    assert one["flow_std_pkt_size"] is None and one["flow_is_single_packet"] == 1
    assert one["flow_pkts_per_sec"] == pytest.approx(1e6)
    assert (two["flow_pkt_count"], two["flow_duration_seconds"], two["flow_std_pkt_size"]) == (2, 0.0, 0.0)


def test_null_port_keeps_its_row_without_features(spark):
    df = make(spark, [out(1, 0), out(2, 5, port=None)])
    merged = {r["frame_no"]: r["flow_pkt_count"] for r in flow.with_flow_features(df).collect()}
    assert merged == {1: 1, 2: None}
    already = flow.with_flow_features(df)
    assert flow.with_flow_features(already) is already


def test_gap_crosses_slices(spark):
    df = make(spark, [out(1, 0), out(2, 59_000), out(3, 61_000), out(4, 300_000)])
    gaps = [r["inter_arrival_time"] for r in flow.flow_gaps(df).orderBy("frame_no").collect()]
    assert gaps == [0.0, 59.0, 2.0, 239.0]


def test_host_windows_across_an_edge_and_null_source(spark):
    df = make(spark, [out(1, 100), out(2, 900), out(3, 1_100), out(4, 200, src="172.19.0.6"), out(5, 300, src=None)])
    rows = {r["frame_no"]: r for r in host.with_host_features(df).collect()}
    assert [rows[i]["src_host_pkt_count_win"] for i in range(1, 6)] == [2, 2, 1, 1, 0]
    assert rows[3]["dst_host_distinct_src_ips_win"] == 1 and rows[1]["dst_host_distinct_src_ips_win"] == 2


def test_reversed_endpoints_share_a_session(spark):
    df = make(spark, [out(1, 0, size=100), back(2, 10, size=300), out(3, 20, size=50), out(4, 5, port=80)])
    rows = session.session_table(df).collect()
    assert len(rows) == 2
    both = next(r for r in rows if r["total_packets"] == 3)
    assert (both["src_ip_first"], both["outbound_frame_len_count"], both["inbound_frame_len_sum"]) == (CLIENT, 2, 300)
    assert both["small_packet_count"] == 1
    single = next(r for r in rows if r["total_packets"] == 1)
    assert (single["inbound_frame_len_count"], single["inbound_frame_len_sum"], single["std_packet_size"]) == (0, 0, None)
    counts = {r["flow_fwd_pkt_count"]: r["flow_bwd_pkt_count"] for r in session.initiator_counts(df).collect()}
    assert counts == {2: 1, 1: 0}


def test_session_flag_histogram(spark):
    df = make(spark, [out(1, 0, flags=2), out(2, 1, flags=16), out(3, 2, flags=16), back(4, 3, flags=18)])
    rows = {r["direction"]: r["tcp_flags"] for r in session.session_flag_histogram(df).collect()}
    assert rows == {"outbound": {2: 1, 16: 2}, "inbound": {18: 1}}


def test_handshake(spark):
    df = make(spark, [out(1, 0, flags=2), back(2, 20, flags=18), out(3, 40)])
    assert [tuple(r) for r in rtt.handshake_rtt(df).collect()] == [(f"{CLIENT}:40000-{SERVER}:443", 20.0)]
    assert rtt.handshake_rtt(df.where("frame_no <> 2")).count() == 0
    late = make(spark, [out(1, 0, flags=2), back(2, 70_000, flags=18)])
    assert rtt.handshake_rtt(late).count() == 0
    assert rtt.handshake_rtt(late, "2 minutes").count() == 1


def test_duplicate_syn_last_wins_or_first_answer(spark):
    df = make(spark, [out(1, 0, flags=2), out(2, 10, flags=2), back(3, 30, flags=18), back(4, 90, flags=18)])
    assert rtt.handshake_rtt(df).first()["rtt_ms"] == 80.0
    assert rtt.handshake_rtt(df, match="first_after").first()["rtt_ms"] == 20.0


def test_ack_latency_directions(spark):
    # 60 bytes on the wire: ip_len 46, payload 6, so seq 100 expects 106.
    df = make(spark, [out(1, 0, seq=100, flags=24), back(2, 25, ack=106), out(3, 70, ack=106), out(4, 80, seq=999)])
    same = {r["frame_no"]: r["rtt_ack_ms"] for r in rtt.with_ack_rtt(df).collect()}
    reverse = {r["frame_no"]: r["rtt_ack_ms"] for r in rtt.with_ack_rtt(df, direction="reverse").collect()}
    assert same == {1: 70.0, 2: None, 3: None, 4: None}
    assert reverse == {1: 25.0, 2: None, 3: None, 4: None}


def test_rtt_statistics_combine_both(spark):
    df = make(spark, [out(1, 0, flags=2, seq=100), back(2, 20, flags=18), out(3, 60, flags=16, ack=106)])
    row = {r["frame_no"]: r for r in rtt.with_rtt_features(df).collect()}
    assert row[1]["rtt_combined_ms"] == pytest.approx((20 + 60) / 2) and row[3]["rtt_combined_ms"] == 20.0
    assert row[1]["rtt_sample_count"] == 2 and row[1]["avg_rtt_ms"] == pytest.approx(30.0)


def test_cap_validation_and_counters(spark):
    df = make(spark, [out(i, i) for i in range(1, 8)]).withColumn("file_path", F.lit("a")).unionByName(
        make(spark, [out(1, 0, src="1.2.3"), out(2, 1, size=10), out(9, 2, port=70000)]).withColumn("file_path", F.lit("b"))
    )
    capped = cap_per_file(df, 2).groupBy("file_path").agg(F.collect_list("frame_no").alias("f")).collect()
    assert {r["file_path"]: sorted(r["f"]) for r in capped} == {"a": [1, 2], "b": [1, 2]}
    valid, rejected = validate(df)
    assert valid.count() == 7
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["dst_port", "frame_len", "src_ip"]
    total = ingest_counters(df).where("is_total = 1").first()
    assert (total["total_files"], total["total_packets_read"], total["packets_out_of_size_range"]) == (2, 10, 1)
    assert (total["packets_failed_validation"], total["packets_successfully_processed"]) == (2, 7)
