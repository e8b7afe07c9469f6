"""Addresses against the standard library, entropy against plain counting."""

import ipaddress
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.functions.entropy import char_entropy, hex_payload_stats
from packetloom.functions.timing import floor_time, width_us
from packetloom.operators import scalar

ADDRESSES = (
    "10.1.1.1 172.16.0.1 172.32.0.1 192.168.1.1 127.0.0.1 169.254.1.1 198.18.0.1 198.20.0.1 203.0.113.5 240.0.0.1 "
    "255.255.255.255 100.64.0.1 192.0.0.9 192.0.0.10 192.0.0.8 192.0.0.170 192.0.1.1 224.0.0.251 8.8.8.8 0.1.2.3 bad 1.2.3 "
    "01.2.3.4 256.1.1.1 fe80::1 fd00::1 ::1 :: 2001:db8::1 2001:4860:4860::8888 ::ffff:10.0.0.1 ::ffff:8.8.8.8 2001:1::1 "
    "2001:1::3 2001:3::1 2001:20::5 2001:4:112::1 2001:100::1 2002::1 64:ff9b:1::1 64:ff9b::1 100::1 100:0:0:1::1 "
    "1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1::2::3 ::: 1:2:3:4:5:6:7:8:9 g::1 12345::1 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 "
    "1::2:3:4:5:6:7:8 : ::1.2.3.4 1:2 ff02::1 FE80::A 1:2:3:4:5:6:1.2.3.4 ::1.2.3.400"
).split()


def _expected(ip):
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return False, False
    return True, address.is_private


def test_addresses_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(ip,) for ip in ADDRESSES], "ip string")
    rows = df.select("ip", net.is_valid_ip("ip").alias("v"), net.is_private_ip("ip").alias("p")).collect()
    assert {r["ip"]: (r["v"], r["p"]) for r in rows} == {ip: _expected(ip) for ip in ADDRESSES}


def test_null_address_is_neither_valid_nor_private(spark):
    row = spark.sql("SELECT cast(NULL AS string) AS ip").select(
        net.is_valid_ip("ip").alias("v"), net.is_private_ip("ip").alias("p"), net.in_networks("ip").alias("n")
    ).first()
    assert (row["v"], row["p"], row["n"]) == (False, False, False)


def test_networks(spark):
    df = spark.createDataFrame([("172.19.0.1",), ("172.19.255.255",), ("172.20.0.0",), ("172.190.0.1",)], "ip string")
    assert [r[0] for r in df.select(net.in_networks("ip")).collect()] == [True, True, False, False]


def _entropy(values):
    counts, n = Counter(values), len(values)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def test_char_entropy(spark):
    texts = ["", "aaaa", "google", "xn3k9z7q", "naïve ☃☃ 𝄞", "a.b(c)*$\\"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.select(char_entropy(F.col("t"))).collect()]
    assert got == pytest.approx([*map(_entropy, texts), 0.0], abs=1e-12)


def test_payload_stats_whole_batch(spark):
    payloads = ["00ff00ff", "48656c6c6f0a", "", None, "abc", "zz", "41" * 3000, "AbCd"]
    df = spark.createDataFrame([(p,) for p in payloads], "p string").coalesce(1)
    rows = [r["s"] for r in df.select(hex_payload_stats("p").alias("s")).collect()]
    data = [bytes.fromhex(p) if p and p not in ("abc", "zz") else b"" for p in payloads]
    assert [r["entropy"] for r in rows] == pytest.approx([_entropy(d) for d in data])
    printable = [sum(0x20 <= b <= 0x7E or 9 <= b <= 13 for b in d) / len(d) if d else 0.0 for d in data]
    assert [r["printable"] for r in rows] == pytest.approx(printable)


@pytest.mark.parametrize("text, us", [("1s", 10**6), ("5 minutes", 3 * 10**8), ("300 seconds", 3 * 10**8), ("2h", 72 * 10**8), ("1 day", 864 * 10**8), (7, 7)])
def test_widths(text, us):
    assert width_us(text) == us


def test_bad_width():
    with pytest.raises(ValueError):
        width_us("soon")


def test_floor_time_equals_window_start(spark):
    df = spark.sql("SELECT timestamp_micros(id * 12345678901) AS ts FROM range(200)")
    both = df.select(floor_time(F.col("ts"), "7 seconds").alias("a"), F.window("ts", "7 seconds")["start"].alias("b"))
    assert both.where("a <> b").count() == 0


def test_ja3_and_header_count(spark):
    df = spark.sql("SELECT * FROM VALUES ('1','771','4,5','0,23',NULL,'0','a\\nb',NULL),('2','771','4','0','1','0','','x'),('1','771','','','','',NULL,NULL) AS t(h,v,c,e,g,f,q,s)")
    rows = df.select(
        scalar.ja3_string(*[F.col(c) for c in "hvcegf"]).alias("ja3"), scalar.http_header_count(F.col("q"), F.col("s")).alias("n")
    ).collect()
    assert [tuple(r) for r in rows] == [("771,4-5,0-23,,0", 2), (None, 1), ("771,,,,", 0)]


def test_hex_flags_and_missing_columns(spark):
    df = spark.createDataFrame([("0x012",), ("18",), (None,)], "tcp_flags string")
    rows = scalar.packet_features(df).select("tcp_flag_syn", "tcp_flag_ack").collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 0), (0, 0)]
    assert scalar.dns_features(df) is df
