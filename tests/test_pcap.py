"""Captures as a data source: read whole and by pieces, stream, write."""

import io
import ipaddress
import struct
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom import session
from packetloom.sources import capture, pcap

COLUMNS = "frame_no bigint, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq bigint, tcp_ack bigint, frame_len int, payload string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ip = "CASE WHEN id % 4 = 0 THEN '2001:db8::' || hex(id % 7 + 1) ELSE '10.0.0.' || (id % 7 + 1) END"
    df = spark.range(600).selectExpr(
        "id AS frame_no", "timestamp_micros(1700000000000000 + id * 1000001) AS timestamp", f"{ip} AS src_ip", f"{ip} AS dst_ip",
        "CAST(40000 + id % 9 AS INT) AS src_port", "CAST(CASE WHEN id % 3 = 0 THEN 53 ELSE 443 END AS INT) AS dst_port",
        "CAST(CASE WHEN id % 3 > 0 THEN 24 END AS INT) AS tcp_flags", "CASE WHEN id % 3 > 0 THEN id * 7000000 END AS tcp_seq",
        "CASE WHEN id % 3 > 0 THEN id END AS tcp_ack", "CAST(200 + id % 50 AS INT) AS frame_len", "CASE WHEN id % 5 > 0 THEN md5(CAST(id AS STRING)) END AS payload",
    )
    path = str(tmp_path_factory.mktemp("captures"))
    pcap.write_captures(df.repartitionByRange(3, "frame_no").sortWithinPartitions("frame_no"), path)
    return df, path


def fields(df):
    return sorted(map(tuple, df.select("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "frame_len", "payload").collect()), key=str)


def test_what_is_written_is_read(spark, folder):
    df, path = folder
    read = spark.read.format("pcap").load(path)
    assert read.rdd.getNumPartitions() == 3 and fields(read) == fields(df)
    assert fields(capture.read_captures(spark, path, chunk=2_000)) == fields(df)
    assert read.where("tcp_flags IS NULL").select("protocol").distinct().collect() == [("UDP",)]
    again = read.groupBy("file_path").agg(F.count("*").alias("n"), F.max("frame_no").alias("last"))
    assert again.where("n <> last").count() == 0


def test_pieces_of_an_index_are_partitions(spark, folder, tmp_path):
    df, path = folder
    pcap.write_index(spark, path, str(tmp_path / "index"), chunk=4_000)
    read = spark.read.format("pcap").option("index", str(tmp_path / "index")).load(path)
    assert read.rdd.getNumPartitions() > 12 and fields(read) == fields(df)
    assert read.select("file_path", "frame_no").distinct().count() == 600


def test_malformed_frames(spark, folder, tmp_path):
    _, path = folder
    one = spark.read.format("pcap").load(path).select("file_path").first()[0].removeprefix("file://")
    (tmp_path / "cut.pcap").write_bytes(open(one, "rb").read()[:-3])
    (tmp_path / "other.txt").write_text("no capture")
    whole = spark.read.format("pcap").load(path).where(F.col("file_path").endswith(one.rsplit("/", 1)[-1])).count()
    assert spark.read.format("pcap").load(str(tmp_path)).count() == whole - 1
    marked = spark.read.format("pcap").option("onMalformed", "mark").load(str(tmp_path))
    assert marked.count() == whole and marked.where("malformed").count() == 1
    with pytest.raises(Exception, match="no record header"):
        spark.read.format("pcap").option("onMalformed", "raise").load(str(tmp_path)).collect()
    assert spark.read.format("pcap").load(str(tmp_path / "cut.pcap")).count() == whole - 1
    assert spark.read.format("pcap").load(str(tmp_path / "missing")).count() == 0


def test_stream_takes_each_capture_once(spark, folder, tmp_path):
    df, _ = folder
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("pcap").load(path)
        stream.select("timestamp", "src_ip").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(out).awaitTermination()
        return spark.read.parquet(out).count()

    pcap.write_captures(df.where("frame_no < 250").coalesce(1), path)
    assert run() == 250
    pcap.write_captures(df.where("frame_no >= 250").coalesce(1), path)
    assert run() == 600 and run() == 600


def test_overwrite_and_failed_writes(spark, folder, tmp_path):
    df, _ = folder
    path = str(tmp_path / "w")
    pcap.write_captures(df.limit(5), path)
    pcap.write_captures(df.limit(7).coalesce(1), path, "overwrite")
    assert spark.read.format("pcap").load(path).count() == 7
    with pytest.raises(Exception, match="two kinds"):
        pcap.write_captures(df.limit(3).withColumns({"src_ip": F.lit("::1"), "dst_ip": F.lit("10.0.0.1")}), path)
    assert spark.read.format("pcap").load(path).count() == 7


def test_modules_travel_with_a_job_inside_an_open_scope(spark):
    with session.scratch_folder(spark):
        assert session._SCOPES.get()
        data_source, there = cloudpickle.loads(cloudpickle.dumps((pcap.PcapDataSource, session._SCOPES)))
    assert data_source.name() == "pcap" and there.get() == ()


class _Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data

    def size(self):
        return len(self.getbuffer())


def _capture_of(frames, link=1):
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, link) + b"".join(
        struct.pack("<IIII", 1_700_000_000 + i, i, len(x), len(x)) + x for i, x in enumerate(frames)
    )


def test_a_range_is_found_and_walked_by_reading_little_more_than_it():
    f = _Counted(_capture_of([bytes([i % 251]) * 84 for i in range(80_000)]))
    head = capture._Head(f, "x")
    low, high, f.taken = 1 << 20, (1 << 20) + (1 << 17), 0
    found = capture._resume(f, low, head.size, "<", False, head.longest, head.second, 1 << 22, stop=high)
    pieces, end, frames, _ = capture.walk(f, head, found, high, None, 1 << 22)
    assert (found - 24) % 100 == 0 and low <= found < low + 100 and high <= end < high + 100 and frames == (end - found) // 100
    assert pieces == [(found, end, 0, False)] and f.taken < high - low + 10_000


def test_many_ranges_and_pieces_share_tasks(spark, tmp_path):
    (tmp_path / "many.pcap").write_bytes(_capture_of([bytes([i % 251]) * 84 for i in range(60_000)]))
    read = capture.read_captures(spark, str(tmp_path), chunk=1 << 13)
    assert 4 < read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    pcap.write_index(spark, str(tmp_path), str(tmp_path / "index"), chunk=1 << 13)
    pieces = spark.read.parquet(str(tmp_path / "index")).count()
    pcap.register(spark)
    by_index = spark.read.format("pcap").option("index", str(tmp_path / "index")).load(str(tmp_path))
    assert pieces > 2 * pcap._PARTITIONS >= 2 * by_index.rdd.getNumPartitions() > 20
    for df in (read, by_index):
        assert df.agg(F.count("*"), F.count_distinct("frame_no"), F.max("frame_no"), F.count_distinct("timestamp")).first() == (60_000,) * 4


def _frames(rng):
    """Frames of all kinds, whole and cut, with random fields."""
    options = [b"", b"\x01\x01\x08\x0a" + bytes(8), b"\x02\x04\x05\xb4\x01\x03\x03\x07\x04\x02\x00\x00", b"\x02\x04\x05\xb4\x02\x04\x01\x02", b"\x01\x01\x01\x03", b"\x08\x0a\x01\x02", b"\xfe\x00\x00\x00"]
    for i in range(3_000):
        data = rng.bytes(int(rng.integers(0, 40)))
        ports = rng.bytes(4)
        option = options[rng.integers(len(options))]
        tcp = ports + rng.bytes(8) + struct.pack(">H", ((5 + len(option) // 4 if i % 9 else int(rng.integers(16))) << 12) | int(rng.integers(4096))) + rng.bytes(6) + option + data
        proto = int(rng.choice([6, 6, 6, 17, 17, 1, 58, 47, 0, 44, 60]))
        inner = tcp if proto == 6 else ports + rng.bytes(4) + data if proto == 17 else (b"\x08\x00" if i % 2 else b"\x03\x01") + rng.bytes(6) + data
        total = 20 + len(inner) if i % 7 else int(rng.integers(0, 70))
        four = bytes([0x45 if i % 5 else int(rng.integers(256)), 0]) + struct.pack(">HHHBBH", total, 0, 0 if i % 8 else int(rng.integers(1 << 16)), i % 256, proto, 0) + rng.bytes(8) + inner
        six = struct.pack(">IHBB", 0x60000000, len(inner) if i % 7 else int(rng.integers(0, 70)), proto, i % 256) + rng.bytes(32) + inner
        body, kind = (four, 0x0800) if i % 3 else (six, 0x86DD)
        body = body + bytes(int(rng.integers(0, 8))) if i % 4 else body[: int(rng.integers(0, len(body) + 1))]
        yield body, int(rng.choice([kind, kind, kind, kind, kind, 0x0806, 0x8100, 0x88A8, 0x1234]))


@pytest.mark.parametrize("link", [1, 113, 101, 0, 77])
@pytest.mark.parametrize("order, nanos", [("<", False), (">", True)])
def test_frames_decoded_together_equal_frames_decoded_one_by_one(link, order, nanos):
    rng = np.random.default_rng(link)
    lead = {1: lambda kind: bytes(12) + struct.pack(">H", kind), 113: lambda kind: bytes(14) + struct.pack(">H", kind), 0: lambda kind: bytes(4)}.get(link, lambda kind: b"")
    frames = [(lead(kind) + body)[: None if i % 50 else i % 17] for i, (body, kind) in enumerate(_frames(rng))]
    records = [struct.pack(order + "IIII", 1_700_000_000 + i, 999_999, len(x), len(x) + i % 3) + x for i, x in enumerate(frames)]
    starts = np.cumsum([0, *map(len, records)])[:-1]
    piece = SimpleNamespace(path="file:/x.pcap", order=order, nanos=nanos, link=link)
    schema = to_arrow_schema(capture._DECODED)
    expected, broken = [], 0
    for i, x in enumerate(frames):
        row = dict.fromkeys(schema.names) | {"file_path": piece.path, "frame_no": i + 5, "frame_len": len(x) + i % 3, "malformed": False}
        row["timestamp"] = (1_700_000_000 + i) * 1_000_000 + (999 if nanos else 999_999)
        try:
            row.update(capture.decode(x, link))
        except (struct.error, IndexError, ValueError):
            row["malformed"] = True
            broken += 1
        expected.append(row)

    def rows(mode):
        table = capture._table(b"".join(records), starts, np.arange(len(frames)) + 5, piece, mode, schema)
        return table.set_column(table.schema.names.index("timestamp"), "timestamp", table["timestamp"].cast("int64")).to_pylist()

    assert 30 < broken < 2_000
    assert rows("mark") == expected and rows("skip") == [r for r in expected if not r["malformed"]]
    with pytest.raises((struct.error, IndexError, ValueError)):
        rows("raise")


def test_records_made_together_equal_records_made_one_by_one():
    rng = np.random.default_rng(1)
    n = 500
    some = lambda values: [None if rng.random() < 0.1 else v for v in values]
    six = rng.random(n) < 0.3
    address = lambda x: str(ipaddress.IPv6Address(rng.bytes(16)) if x else ipaddress.IPv4Address(rng.bytes(4)))
    whole = lambda most: some(rng.integers(0, most, n, endpoint=True).tolist())
    columns = {
        "timestamp": pa.array(some(rng.integers(0, 4_000_000_000_000_000, n).tolist()), pa.timestamp("us", "UTC")), "frame_len": pa.array(whole(2_000), pa.int32()),
        "src_ip": pa.array([address(x) for x in six]), "dst_ip": pa.array([address(x) for x in six]), "src_port": pa.array(whole(65_535), pa.int32()),
        "dst_port": pa.array(whole(65_535), pa.int32()), "tcp_flags": pa.array(some([None if rng.random() < 0.5 else 0xFFF & i * 7 for i in range(n)]), pa.int32()),
        "tcp_seq": pa.array(whole(2**32 - 1), pa.int64()), "tcp_ack": pa.array(whole(2**32 - 1), pa.int64()), "tcp_window_size": pa.array(whole(65_535), pa.int32()),
        "ip_ttl": pa.array(whole(255), pa.int32()), "payload": pa.array(some([rng.bytes(int(k)).hex() if k % 2 else rng.bytes(int(k)).hex().upper() for k in rng.integers(0, 50, n)])),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    assert pcap._records_of(batch) == b"".join(pcap._record_of(SimpleNamespace(**r)) for r in batch.to_pylist())
    assert pcap._records_of(batch.slice(100, 37)) == b"".join(pcap._record_of(SimpleNamespace(**r)) for r in batch.slice(100, 37).to_pylist())
    # What the fast way does not cover is left to the other one, which makes it or fails as ever.
    for name, odd in (("payload", "0a 0b"), ("payload", "abc"), ("src_ip", "10.0.0.300"), ("src_port", 70_000), ("tcp_seq", -1), ("ip_ttl", 300)):
        column = columns[name].to_pylist()
        assert pcap._records_of(pa.RecordBatch.from_pydict({**columns, name: pa.array([odd, *column[1:]], columns[name].type)})) is None
