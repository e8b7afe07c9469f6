"""Every streaming form gives what the batch form gives on the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.models import iforest
from packetloom.operators import host, profile, sequence
from packetloom.sources.records import canonical
from packetloom.streaming import alerts, packets, state

T0 = datetime(2024, 1, 1)


def _rows(lo, hi):
    return [
        (i, T0 + timedelta(seconds=7 * i), f"10.0.0.{i % 3}", f"8.8.8.{i % 5}", 40000 + i % 4, 443, "TCP", 60 + i % 50,
         f"/p/{i % 4}" if i % 2 else None, f"ua/{i % 2}" if i % 3 else None)
        for i in range(lo, hi)
    ]


SCHEMA = ("frame_no long, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "frame_len int, http_request_uri string, http_user_agent string")


@pytest.fixture()
def landing(spark, tmp_path):
    """Three landed files; the second one repeats part of the first."""
    parts = [_rows(0, 80), _rows(60, 150), _rows(150, 240)]
    for i, rows in enumerate(parts):
        df = canonical(spark.createDataFrame(rows, SCHEMA)).withColumn("file_path", F.lit("capture-1"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = canonical(spark.createDataFrame(_rows(0, 240), SCHEMA)).withColumn("file_path", F.lit("capture-1"))
    return tmp_path, batch


def _run(stream, tmp_path, name):
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def _same(a, b):
    order = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=str)
    assert order(a) == order(b)


def test_pickup_and_duplicates(spark, landing):
    tmp_path, batch = landing
    stream = packets.on_time(packets.packet_stream(spark, str(tmp_path / "in"), files_per_trigger=1), "1 day")
    got = _run(stream, tmp_path, "dedup")
    assert got.count() == 240 == got.select("frame_no").distinct().count()
    # A second run over the same checkpoint finds nothing new, then only the new file.
    assert _run(stream, tmp_path, "dedup").count() == 240
    canonical(spark.createDataFrame(_rows(240, 250), SCHEMA)).withColumn("file_path", F.lit("capture-1")).write.mode("append").parquet(str(tmp_path / "in"))
    assert _run(stream, tmp_path, "dedup").count() == 250


def test_host_windows(spark, landing):
    tmp_path, batch = landing
    stream = packets.on_time(packets.packet_stream(spark, str(tmp_path / "in")), "1 minute")
    got = _run(packets.src_host_stream(stream, "1 minute"), tmp_path, "hosts")
    expected = host.src_host_windows(batch, "1 minute").select(*got.columns)
    # Append mode holds back the windows the watermark has not passed.
    closed = F.col("time_window") < F.lit(T0 + timedelta(seconds=7 * 239) - timedelta(minutes=2))
    _same(got.where(closed), expected.where(closed))
    assert got.where(closed).count() > 50
    dst = _run(packets.dst_host_stream(stream, "1 minute"), tmp_path, "dst")
    _same(dst.where(closed), host.dst_host_windows(batch, "1 minute").select(*dst.columns).where(closed))


def test_whole_host_windows(spark, tmp_path):
    """Every column of the batch, over files of their own batches, with rows that arrive twice, late ones, and missing values."""
    rows = [
        (i, T0 + timedelta(seconds=7 * i), None if i % 41 == 0 else f"10.0.0.{i % 3}", None if i % 17 == 0 else f"8.8.8.{i * i % 11}",
         None if i % 13 == 0 else 400 + i * i % 7, 60 + i % 50, f"j{i % 4}" if i % 5 == 0 else None, i % 23 if i % 6 == 0 else None, i % 19 / 7 if i % 6 == 0 else None)
        for i in range(400)
    ]
    schema = ("frame_no long, timestamp timestamp, src_ip string, dst_ip string, dst_port int, frame_len int, tls_ja3 string, "
              "dns_qry_name_len int, dns_qry_name_entropy double")
    marked = lambda some: spark.createDataFrame(some, schema).withColumn("file_path", F.lit("c"))
    # Rows of a file come after those of the next one; some come twice; one is far too late.
    for some in (rows[:150], rows[170:260] + rows[100:120], rows[150:170] + rows[260:], [(999, T0, *rows[1][2:])]):
        marked(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state.use_rocksdb(spark)
    stream = spark.readStream.schema(marked(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = packets.on_time(stream, "20 minutes")
    got = _run(state.frequency_change_stream(packets.whole_src_host_stream(stream, "1 minute")), tmp_path, "whole")
    expected = host.src_host_windows(marked(rows), "1 minute")
    assert set(got.columns) == set(expected.columns)
    closed = F.col("time_window") < F.lit(T0 + timedelta(seconds=7 * 399) - timedelta(minutes=22))
    rounded = lambda d: d.where(closed).select(
        *[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "bigint" else F.col(c) for c, t in d.dtypes]
    )
    _same(rounded(got), rounded(expected))
    assert got.where(closed).count() > 60 and got.where("src_host_session_freq_change_win <> 0").count() > 10


def test_bursts(spark, landing):
    tmp_path, batch = landing
    thin = batch.where("frame_no % 40 < 20")
    thin.coalesce(1).write.parquet(str(tmp_path / "thin"))
    stream = packets.on_time(packets.packet_stream(spark, str(tmp_path / "thin")), "1 second")
    got = _run(packets.burst_stream(stream, "1 minute"), tmp_path, "bursts")
    expected = host.activity_bursts(thin, "1 minute")
    closed = F.col("burst_end") < F.lit(T0 + timedelta(seconds=1500))
    assert expected.where(closed).count() > 10
    _same(got.where(closed), expected.where(closed))


@pytest.fixture()
def sessions(spark, landing):
    tmp_path, batch = landing
    s = profile.client_sessions(batch, "1 minute").drop("run_start")
    ordered = s.orderBy("timestamp").collect()
    for i, part in enumerate((ordered[:25], ordered[25:])):
        spark.createDataFrame(part, s.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "sessions" / f"part={i}"))
    read = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "sessions"))
    return tmp_path, s, read


def test_profiles(spark, sessions):
    tmp_path, s, stream = sessions
    got = _run(state.compare_stream(stream), tmp_path, "profiles")
    columns = ["client_ip", "frame_no", "is_new_uri_for_ip", "is_new_user_agent_for_ip", "is_first_session_for_ip"]
    expected = profile.compare_with_history(s)
    _same(got.select(*columns), expected.select(*columns))
    days = lambda d: {(r["client_ip"], r["frame_no"]): (r["days_since_first_seen"], r["days_since_last_seen"]) for r in d.collect()}
    a, b = days(got), days(expected)
    assert all(a[k] == pytest.approx(b[k]) for k in b) and len(a) == len(b)
    last = got.groupBy("client_ip").agg(F.max("profile_session_count").alias("session_count"), F.max("profile_total_bytes").alias("total_bytes"))
    _same(last, profile.profile_totals(s).select("client_ip", "session_count", "total_bytes"))


def test_profiles_that_expire(spark, tmp_path):
    day = timedelta(days=1)
    # Client a comes back after 9 days, b uses /x again after 5, c comes daily with a new address each time.
    rows = [("a", T0, 1, "/x"), ("a", T0 + day, 2, "/y"), ("a", T0 + 10 * day, 3, "/x"), ("b", T0, 4, "/x"), ("b", T0 + 3 * day, 5, "/y"), ("b", T0 + 5 * day, 6, "/x"), ("b", T0 + 6 * day, 7, "/x")]
    rows += [("c", T0 + i * day, 100 + i, f"/{i}") for i in range(40)] + [("d", T0 + 2 * day, 200, None)]
    s = spark.createDataFrame(rows, "client_ip string, timestamp timestamp, frame_no long, uri string").withColumns({"user_agent": F.lit(None).cast("string"), "total_bytes": F.lit(10).cast("long")})
    for lo, hi in ((0, 4), (4, 12), (12, 25), (25, 41)):
        part = s.where((F.col("timestamp") >= F.lit(T0 + lo * day)) & (F.col("timestamp") < F.lit(T0 + hi * day)))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={lo:02d}"))
    read = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = _run(state.compare_stream(read.withWatermark("timestamp", "1 hour"), "4 days"), tmp_path, "expiring")
    columns = ["client_ip", "frame_no", "is_new_uri_for_ip", "is_first_session_for_ip", "days_since_first_seen", "days_since_last_seen"]
    expected = profile.compare_with_history(s, ttl="4 days").select(*columns)
    _same(got.select(*columns), expected)
    by = {r["frame_no"]: r for r in expected.collect()}
    assert (by[3]["is_first_session_for_ip"], by[3]["is_new_uri_for_ip"]) == (1, 1) and (by[6]["is_first_session_for_ip"], by[6]["is_new_uri_for_ip"]) == (0, 1)
    assert by[7]["is_new_uri_for_ip"] == 0
    # What is left of the state: nothing of the silent clients, and of c only what is younger than the ttl and a sweep.
    held = spark.read.format("statestore").option("stateVarName", "uri").option("flattenCollectionTypes", "true").load(str(tmp_path / "expiring-cp"))
    left = {(r["key"]["client_ip"] if hasattr(r["key"], "client_ip") else r["key"][0]) for r in held.select("key").collect()}
    assert left == {"c"} and held.count() <= 4 + 1 + 16


def test_sequences(spark, sessions):
    tmp_path, s, stream = sessions
    got = _run(state.sequence_stream(stream, ["total_bytes", "packets"], 4), tmp_path, "sequences")
    expected = sequence.behaviour_sequences(s, "client_ip", ["total_bytes", "packets"], 4)
    _same(got.select("client_ip", "frame_no", "sequence", "is_ready"), expected.select("client_ip", "frame_no", "sequence", "is_ready"))


def test_alerts(spark, sessions):
    tmp_path, s, stream = sessions
    model = iforest.fit(s, ["total_bytes", "packets"], ["client_ip", "frame_no"], trees=10, contamination=0.2)
    query = alerts.write_alerts(stream, model, str(tmp_path / "alerts"), str(tmp_path / "alerts-cp"), high=0.6, suspicious=0.5)
    assert query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "alerts")).select("client_ip", "frame_no", "result_type", "severity")
    expected = alerts.judged(s, model, 0.6, 0.5).where("result_type <> 'normal'").select(*got.columns)
    assert expected.count() > 0
    _same(got, expected)


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update


class _Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value


class _Handle:
    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def getMapState(self, *_):
        return _Map()


def test_a_late_session_keeps_first_and_last():
    import pandas as pd

    processor = state.ProfileProcessor()
    processor.init(_Handle())
    session = lambda day, n: pd.DataFrame({"timestamp": [pd.Timestamp(f"2024-01-{day:02d}")], "frame_no": [n], "uri": ["/a"], "user_agent": [None], "total_bytes": [1]})
    rows = [next(processor.handleInputRows(("c",), iter([session(day, n)]), None)).iloc[0] for n, day in enumerate((10, 4, 12))]
    assert [r["days_since_last_seen"] for r in rows] == [0.0, 0.0, 2.0]
    assert [r["days_since_first_seen"] for r in rows] == [0.0, 0.0, 8.0]


def test_sketches_of_a_stream_merge_like_those_of_the_batch(spark, landing):
    from packetloom.operators import sketches

    tmp_path, batch = landing
    stream = packets.on_time(packets.packet_stream(spark, str(tmp_path / "in"), files_per_trigger=1), "1 minute")
    got = _run(sketches.distinct_sketches(stream, ["src_ip"], ["dst_ip", "dst_port"], "1 minute"), tmp_path, "sketches")
    closed = F.col("time_window") < F.lit(T0 + timedelta(minutes=20))
    merged = [sketches.merged_sketches(s.where(closed), ["src_ip"], ["dst_ip", "dst_port"], {"5": "5 minutes", "20": "20 minutes"})
              for s in (got, sketches.distinct_sketches(batch, ["src_ip"], ["dst_ip", "dst_port"], "1 minute"))]
    _same(*merged)
    assert merged[0].count() == 3 * 5
