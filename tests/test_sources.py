"""Discovery, record files, captures, exports, intelligence, report files."""

import json
import socket
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.schema import PACKET_SCHEMA
from packetloom.sources import capture, exports, records, sinks


def test_discovery(spark, tmp_path):
    (tmp_path / "subdir").mkdir()
    for name in ("test1.pcap", "test2.pcap", "subdir/test3.pcap", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert records.discover(spark, str(tmp_path), "*.pcap").count() == 3
    (tmp_path / "empty").mkdir()
    assert records.discover(spark, str(tmp_path / "empty"), "*.pcap").count() == 0
    assert records.discover(spark, str(tmp_path / "missing"), "*.pcap").count() == 0


@pytest.fixture()
def landed(spark, tmp_path):
    good = [{"frame_no": i, "timestamp": f"2024-01-01T00:00:0{i}Z", "src_ip": "10.0.0.1", "frame_len": 60 + i} for i in range(3)]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, good), "{broken"]))
    return str(tmp_path / "a.json")


def test_malformed_rows(spark, landed):
    assert records.read_packets(spark, landed).count() == 3
    marked = records.read_packets(spark, landed, on_malformed="mark")
    bad = marked.where(F.col(records.CORRUPT).isNotNull()).collect()
    assert marked.count() == 4 and bad[0][records.CORRUPT] == "{broken" and bad[0]["file_path"].endswith("a.json")
    with pytest.raises(Exception):
        records.read_packets(spark, landed, on_malformed="raise").collect()


def test_formats_meet_in_one_schema(spark, landed, tmp_path):
    part = records.read_packets(spark, landed)
    part.write.parquet(str(tmp_path / "b.parquet"))
    both = records.read_packets(spark, [landed, str(tmp_path / "b.parquet")])
    assert both.count() == 6 and both.schema.fieldNames() == PACKET_SCHEMA.fieldNames()
    with pytest.raises(ValueError):
        records.read_packets(spark, "capture.xyz")


def test_own_source(spark):
    records.register_source("made", lambda s, paths, mode: records.canonical(s.sql("SELECT 7 AS frame_no")))
    assert records.read_packets(spark, "x.made").first()["frame_no"] == 7


def _eth(kind, body):
    return b"\x00" * 12 + struct.pack(">H", kind) + body


def _ip(proto, body, src="10.0.0.1", dst="8.8.8.8"):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return head + body


def _pcap(path, frames, order="<", nanos=False):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack(order + "IIII", 1_700_000_000 + i, 250_000_000 if nanos else 250_000, len(f), len(f) + 4) + f
    path.write_bytes(data)


TCP = struct.pack(">HHIIHHHH", 40000, 443, 4_000_000_000, 7, (8 << 12) | 0x12, 500, 0xBEEF, 0) + b"\x02\x04\x05\xb4\x01\x03\x03\x07\x04\x02\x00\x00" + b"hi"
UDP = struct.pack(">HHHH", 53, 5353, 11, 0) + b"abc"
ICMP = struct.pack(">BBHHH", 8, 0, 0x1234, 5, 6)
FRAMES = [_eth(0x0800, _ip(6, TCP)), _eth(0x8100, b"\x00\x01" + struct.pack(">H", 0x0800) + _ip(17, UDP)), _eth(0x0800, _ip(1, ICMP)),
          _eth(0x0806, b"\x00" * 28), _eth(0x86DD, struct.pack(">IHBB", 0x60000000, len(UDP), 17, 64) + b"\x00" * 32 + UDP), _eth(0x0800, b"\x45\x00")]


@pytest.mark.parametrize("order, nanos", [("<", False), (">", False), ("<", True)])
def test_capture_fields(spark, tmp_path, order, nanos):
    _pcap(tmp_path / "a.pcap", FRAMES, order, nanos)
    rows = capture.read_captures(spark, str(tmp_path), "mark").orderBy("frame_no").collect()
    assert [r["malformed"] for r in rows] == [False] * 5 + [True]
    tcp, udp, icmp, arp, v6, _ = rows
    assert (tcp["protocol"], tcp["src_port"], tcp["tcp_seq"], tcp["tcp_flags"], tcp["tcp_mss"], tcp["tcp_window_scale"]) == ("TCP", 40000, 4_000_000_000, 0x12, "1460", "7")
    assert (tcp["payload"], tcp["tcp_checksum"], tcp["tcp_sack_permitted"], tcp["frame_len"]) == ("6869", "0xbeef", "1", len(FRAMES[0]) + 4)
    assert tcp["timestamp"].microsecond == 250_000
    assert (udp["protocol"], udp["dst_port"], udp["payload"], udp["src_ip"]) == ("UDP", 5353, "616263", "10.0.0.1")
    assert (icmp["icmp_type"], icmp["icmp_id"], icmp["icmp_seq"]) == (8, "5", "6")
    assert (arp["protocol"], arp["src_ip"], arp["src_port"]) == ("ARP", None, None)
    assert (v6["protocol"], v6["src_ip"], v6["src_port"], v6["ip_version"]) == ("UDP", "::", 53, 6)
    assert capture.read_captures(spark, str(tmp_path)).count() == 5


def test_capture_in_many_chunks(spark, tmp_path):
    _pcap(tmp_path / "long.pcap", FRAMES[:3] * 100)
    _pcap(tmp_path / "empty.pcap", [])
    (tmp_path / "cut.pcap").write_bytes((tmp_path / "long.pcap").read_bytes()[:-5])
    index = capture.index_captures(records.discover(spark, str(tmp_path / "long.pcap")), chunk=500, block=128).orderBy("start").collect()
    assert len(index) > 20 and [r["start"] for r in index[1:]] == [r["stop"] for r in index[:-1]] and max(r["stop"] - r["start"] for r in index) < 700
    df = capture.read_captures(spark, str(tmp_path), chunk=700)
    whole = {r["file_path"].rsplit("/", 1)[-1]: (r["n"], r["lo"], r["hi"], r["d"]) for r in df.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"), F.count_distinct("frame_no").alias("d")).collect()}
    assert whole == {"long.pcap": (300, 1, 300, 300), "cut.pcap": (299, 1, 299, 299)}


def test_bytes_that_look_like_records_do_not_mislead(spark, tmp_path):
    # Every payload is a chain of plausible headers, so most ranges start at a wrong place first.
    fake = b"".join(struct.pack("<IIII", 1_700_000_000 + i, 5, 4, 4) + b"abcd" for i in range(200))
    _pcap(tmp_path / "f.pcap", [_eth(0x0806, fake[: 20 * (i % 200 + 1)]) for i in range(150)])
    index = capture.index_captures(records.discover(spark, str(tmp_path / "f.pcap")), chunk=3_000).orderBy("start").collect()
    whole = capture.index_captures(records.discover(spark, str(tmp_path / "f.pcap")), chunk=1 << 26).collect()
    assert len(whole) == 1 and (index[0]["start"], index[-1]["stop"]) == (whole[0]["start"], whole[0]["stop"]) and not any(r["damaged"] for r in index)
    rows = capture.read_captures(spark, str(tmp_path), "mark", chunk=3_000).select("frame_no", "frame_len", F.unix_seconds("timestamp").alias("at")).collect()
    assert sorted(tuple(r) for r in rows) == [(i + 1, 14 + 20 * (i % 200 + 1) + 4, 1_700_000_000 + i) for i in range(150)]


def test_ipv6_behind_extension_headers(spark, tmp_path):
    address = bytes.fromhex("20010db8000000000000000000000001")
    routed = struct.pack(">BB6x", 44, 0) + struct.pack(">BBHI", 17, 0, 0, 9) + UDP
    later = struct.pack(">BBHI", 17, 0, 8 << 3, 9) + b"rest"
    head = lambda proto, body: struct.pack(">IHBB", 0x60000000, len(body), proto, 64) + address + b"\x00" * 15 + b"\x01" + body
    _pcap(tmp_path / "six.pcap", [_eth(0x86DD, head(60, routed)), _eth(0x86DD, head(44, later)), _eth(0x86DD, head(60, b"\x11"))])
    rows = capture.read_captures(spark, str(tmp_path), "mark").orderBy("frame_no").collect()
    assert [(r["src_ip"], r["dst_ip"], r["protocol"], r["dst_port"], r["malformed"]) for r in rows] == [
        ("2001:db8::1", "::1", "UDP", 5353, False), ("2001:db8::1", "::1", "IPV6", None, False), (None, None, None, None, True)]


@pytest.mark.parametrize("chunk", [300, 5_000, 1 << 26])
def test_damage_costs_only_the_records_it_touches(spark, tmp_path, chunk):
    _pcap(tmp_path / "d.pcap", [FRAMES[i % 3] for i in range(120)])
    data = bytearray((tmp_path / "d.pcap").read_bytes())
    at, starts = 24, []
    while at < len(data):
        starts.append(at)
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    for i in (5, 60, 90):
        struct.pack_into("<I", data, starts[i] + 8, 0xFFFFFFF0)
    (tmp_path / "d.pcap").write_bytes(data)
    marked = capture.read_captures(spark, str(tmp_path), "mark", chunk=chunk).collect()
    assert sorted(r["frame_no"] for r in marked) == list(range(1, 121))
    assert sorted(r["frame_no"] for r in marked if r["malformed"]) == [6, 61, 91]
    assert capture.read_captures(spark, str(tmp_path), chunk=chunk).count() == 117
    with pytest.raises(Exception, match="no record header"):
        capture.read_captures(spark, str(tmp_path), "raise", chunk=chunk).collect()


def test_session_export(spark, tmp_path):
    (tmp_path / "e.csv").write_text("firstPacket,Src IP,dst.port,Weird#Name\n2024-01-01 00:00:01,10.0.0.1,80,x\nnot a time,10.0.0.2,81,y\n")
    rows = exports.read_session_export(spark, str(tmp_path / "e.csv")).collect()
    assert set(rows[0].asDict()) == {"timestamp", "src_ip", "dst_port", "weirdname"}
    assert sum(r["timestamp"] is None for r in rows) == 1
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    assert exports.read_session_export(spark, str(tmp_path / "none.csv")).count() == 0


def test_column_names():
    assert exports.sanitize_column_name("SrcIP") == "srcip"
    assert exports.sanitize_column_name("SrcIP", split_camel=True) == "src_ip"
    assert exports.sanitize_column_name("Total Bytes.In%") == "total_bytes_in"


def test_intel(spark, tmp_path):
    answers = [
        {"ip": "8.8.8.8", "company": {"name": "G", "domain": "g.com"}, "location": {"country": {"code": "US", "name": "U"}, "city": "MV", "latitude": 1.5}, "security": {"is_threat": True, "threats": ["tor", "bot"]}},
        {"ip": "1.1.1.1"}, {"company": {"name": "no address"}},
    ]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, answers)))
    rows = {r["ip"]: r for r in exports.read_intel(spark, str(tmp_path / "i.json")).collect()}
    assert set(rows) == {"8.8.8.8", "1.1.1.1"}
    assert (rows["8.8.8.8"]["country_code"], rows["8.8.8.8"]["threat_types"], rows["8.8.8.8"]["connection_asn"]) == ("US", "tor,bot", None)
    assert rows["1.1.1.1"]["threat_types"] == "" and len(rows["1.1.1.1"]) == 13


def test_training_set_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, cast(NULL AS double) AS b, 'x' AS s UNION ALL SELECT 2, 0.5D, 'y'")
    sinks.write_training_set(df, str(tmp_path / "t"))
    back = records.read_training_set(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == [(1, 0.0), (2, 0.5)]


def test_report_files(spark, tmp_path):
    tables = {"protocols": spark.sql("SELECT '<TCP>' AS protocol, 3 AS n"), "anomalies": spark.sql("SELECT 1 AS x WHERE false")}
    sinks.write_report(tables, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "protocols")).count() == 1
    page = sinks.report_page(tables)
    assert "&lt;TCP&gt;" in page and "Nothing to report." in page


def test_times_as_iso_text(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678901 UTC' AS t, 1 AS n")
    assert sinks.iso_times(df).first()[:] == ("2024-01-02T03:04:05.678901+00:00", 1)


def test_a_page_says_what_it_leaves_out(spark):
    page = sinks.report_page({"long_table": spark.range(sinks.PAGE_ROWS + 5), "short": spark.range(2), "none": spark.range(0)})
    assert f"The first {sinks.PAGE_ROWS} of {sinks.PAGE_ROWS + 5} rows." in page and page.count("The first") == 1 and "Nothing to report." in page


def test_scratch_is_removed(spark):
    from packetloom import session

    path = session.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    other = spark.newSession()
    assert other.read.parquet(path).count() == 3
    session.remove_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        other.read.parquet(path)
