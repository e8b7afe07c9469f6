"""Profiles over history, sequences, enrichment, application detectors."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.operators import detectors, enrich, profile, sequence

T0 = datetime(2024, 1, 1, 12)
SESSIONS = "client_ip string, timestamp timestamp, frame_no long, uri string, user_agent string, total_bytes long"


def test_two_sessions_of_one_client(spark):
    s = spark.createDataFrame([
        ("10.0.0.1", T0, 1, "/login", "curl", 500), ("10.0.0.1", T0 + timedelta(days=2), 2, "/login", "curl", 250),
    ], SESSIONS)
    first, second = profile.compare_with_history(s).orderBy("frame_no").collect()
    names = ("is_first_session_for_ip", "is_new_uri_for_ip", "is_new_user_agent_for_ip")
    assert [first[n] for n in names] == [1, 1, 1] and first["days_since_first_seen"] == 0
    assert [second[n] for n in names] == [0, 0, 0] and second["days_since_last_seen"] == pytest.approx(2.0)
    before = profile.profile_totals(s.where("frame_no = 1"))
    after = profile.merge_totals(before, profile.profile_totals(s.where("frame_no = 2"))).first()
    assert before.first()["session_count"] == 1 and (after["session_count"], after["total_bytes"]) == (2, 750)


def test_empty_values_are_never_new(spark):
    s = spark.createDataFrame([("a", T0, 1, "", None, 1), ("a", T0, 2, "/x", "ua", 1), ("a", T0, 3, "/x", "ua", 1)], SESSIONS)
    rows = profile.compare_with_history(s).orderBy("frame_no").collect()
    assert [r["is_new_uri_for_ip"] for r in rows] == [0, 1, 0]
    assert [r["is_new_user_agent_for_ip"] for r in rows] == [0, 1, 0]


def test_recent_sessions_keep_the_newest(spark):
    s = spark.createDataFrame([("a", T0 + timedelta(minutes=i), i, None, None, 1) for i in range(60)], SESSIONS)
    kept = profile.recent_sessions(s).agg(F.count(F.lit(1)), F.min("frame_no")).first()
    assert tuple(kept) == (50, 10)


@pytest.mark.parametrize("chunk", [3, 4, 1000])
def test_sequences_across_chunks(spark, chunk):
    rows = [(k, T0 + timedelta(seconds=i), i, float(i)) for k in "ab" for i in range(11)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp, frame_no long, x double")
    got = sequence.behaviour_sequences(df, "k", ["x"], 3, chunk=chunk).collect()
    assert len(got) == 22
    for r in got:
        expected = [[float(i)] for i in range(max(0, r["frame_no"] - 2), r["frame_no"] + 1)]
        assert r["sequence"] == expected and r["is_ready"] == int(len(expected) == 3)


def test_training_windows_of_a_short_table_repeat_it(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=i), i, float(i)) for i in range(3)], "timestamp timestamp, frame_no long, x double")
    rows = sequence.training_windows(df, ["x"], 7).collect()
    assert sorted(r["window_id"] for r in rows) == [0, 1, 2]
    assert all(r["sequence"] == [[float(j % 3)] for j in range(7)] for r in rows)


def test_training_windows_of_a_long_table(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=i), i, float(i)) for i in range(40)], "timestamp timestamp, frame_no long, x double")
    rows = {r["window_id"]: [v[0] for v in r["sequence"]] for r in sequence.training_windows(df, ["x"], 10).collect()}
    assert rows == {w: [float(w * 4 + j) for j in range(10)] for w in range(8)}


def test_longest_prefix_wins(spark):
    nets = enrich.networks_from_cidr(spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "mid"), ("10.1.2.0/24", "tight")], "network string, name string"))
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("10.200.0.1",), ("11.0.0.1",), ("::1",)], "ip string")
    got = {r["ip"]: (r["found"], r["name"]) for r in enrich.locate(ips, nets, ["name"]).collect()}
    assert got == {"10.1.2.3": (1, "tight"), "10.1.9.9": (1, "mid"), "10.200.0.1": (1, "wide"), "11.0.0.1": (0, None), "::1": (0, None)}


def test_cache_expiry_and_newest_entry(spark):
    ips = spark.createDataFrame([("a", 1), ("b", 2)], "ip string, asn int")
    cache = enrich.cache_entries(ips, T0, None).unionByName(
        enrich.cache_entries(ips.where("ip = 'b'"), T0 + timedelta(hours=1), enrich.NOT_FOUND_TTL_SECONDS)
    )
    soon, later = (enrich.cache_current(cache, T0 + timedelta(hours=h)) for h in (2, 30))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "ip string")
    assert sorted(r["ip"] for r in enrich.cache_hits(asked, soon).collect()) == ["a", "b"]
    assert sorted(r["ip"] for r in enrich.cache_misses(asked, later).collect()) == ["b", "c"]


def test_incremental_pull(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(10)] + [(9, T0 + timedelta(hours=9))], "frame_no long, timestamp timestamp")
    got = detectors.incremental(df, T0 + timedelta(hours=5), 2 * 3600, df.where("frame_no IN (4, 5)"), ["frame_no"])
    assert sorted(r["frame_no"] for r in got.collect()) == [6, 7, 8, 9]
