"""Raw capture files (classic pcap): header fields of every packet.

Records have no fixed size, so where one starts is only known from the one before. Still no task walks a whole file: each byte range looks
for the first place where a record header makes sense, walks the headers from there and notes where its chain leaves the range. A range
whose start is the end of the range before it was right; the few others are walked again from that end, until all agree. The pieces of
all ranges are decoded by a second job, whatever file they are in, and frames are numbered by running sums over the ranges. A task takes
many ranges or pieces, as their number follows the size of a range and not what a task can do.

Frames are decoded thousands at a time, by gathering the same field of all of them. What that does not cover (VLAN tags, ICMP, extension
headers, headers that do not add up) goes through ``decode`` one by one; both give the same rows.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from types import SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.schema import PACKET_SCHEMA
from packetloom.session import open_file as _open, settled
from packetloom.sources.records import discover, union_records

CHUNK = 64 * 1024 * 1024
#: Rows of an Arrow batch; bytes of a capture that are read and decoded at once, unless a single record is larger.
BATCH = 10_000
_READ = 8 * 1024 * 1024
#: First bytes that are searched for a record header; each further stretch is twice as long.
_SEARCH = 4096

# Captured bytes of one record at most, where the file does not allow more; how far apart the times of neighbouring records may be
# when records are looked for behind damage.
_LONGEST = 262_144
_APART_SECONDS = 366 * 86_400
_DECODED = T.StructType([*PACKET_SCHEMA.fields, T.StructField("malformed", T.BooleanType())])

# File magic -> (byte order, nanosecond clock); link types with the size of their header (fixed values).
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False),
    b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True),
}
_ETHERNET, _RAW, _SLL, _NULL = 1, 101, 113, 0
# IPv6 extension headers: hop-by-hop, routing, fragment, authentication, destination (fixed values).
_EXTENSIONS = {0, 43, 44, 51, 60}
_TRANSPORT = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPV6"}


def _resume(f, at: int, size: int, order: str, nanos: bool, longest: int, second: int | None, block: int, stop: int | None = None) -> int:
    """The next place from ``at`` on where a record header makes sense and is followed by another one or by the end; else the end. Places
    from ``stop`` on are not looked at."""
    stop = size if stop is None else stop

    def fits(pos: int) -> bool:
        f.seek(pos)
        head = f.read(16)
        if len(head) < 16:
            return not head
        _, frac, caught, wire = struct.unpack(order + "IIII", head)
        return caught <= longest and caught <= wire and frac < (10**9 if nanos else 10**6) and pos + 16 + caught <= size

    window = _SEARCH
    while at + 16 <= size and at < stop:
        f.seek(at)
        raw = f.read(min(window, block, size - at, stop - at + 15))
        window *= 2
        data = np.frombuffer(raw, np.uint8)
        n = len(data) - 15
        if n <= 0:
            break
        weights = np.array([1, 1 << 8, 1 << 16, 1 << 24] if order == "<" else [1 << 24, 1 << 16, 1 << 8, 1], np.int64)
        sec, frac, caught, wire = (sum(data[k + i : k + i + n].astype(np.int64) * weights[i] for i in range(4)) for k in (0, 4, 8, 12))
        good = (frac < (10**9 if nanos else 10**6)) & (caught <= longest) & (caught <= wire) & (wire > 0) & (at + np.arange(n) + 16 + caught <= size)
        if second is not None:
            good &= np.abs(sec - second) <= _APART_SECONDS
        for i in np.flatnonzero(good[: max(stop - at, 0)]).tolist():
            if fits(at + i + 16 + int(caught[i])):
                return at + i
        at += n
    return size


class _Head:
    """What the head of a file says about its records."""

    def __init__(self, f, path: str):
        head = f.read(24)
        if len(head) < 24 or head[:4] not in _MAGIC:
            raise ValueError(f"{path} is not a pcap file")
        self.order, self.nanos = _MAGIC[head[:4]]
        self.link = struct.unpack(self.order + "I", head[20:24])[0] & 0x0FFFFFFF
        self.longest = max(struct.unpack(self.order + "I", head[16:20])[0] & 0x7FFFFFFF, _LONGEST)
        self.size = f.size()
        first = f.read(4)
        self.second = struct.unpack(self.order + "I", first)[0] if len(first) == 4 else None


def walk(f, head: _Head, start: int, high: int, second: int | None, block: int) -> tuple[list[tuple[int, int, int, bool]], int, int, int | None]:
    """((start, stop, frames before it, damaged) of the pieces, end, frames, time of the last record) of the records that start in [start, high).

    Where a record header cannot be right, a piece of its own marks the damage up to the next header that makes sense, and counts as
    one frame; a cut-off last record is such a place too.
    """
    pieces: list[tuple[int, int, int, bool]] = []
    size, at, frame = head.size, start, 0
    high = min(high, size)
    begin, first = at, frame
    base, data = at, b""
    header = struct.Struct(head.order + "I4xI").unpack_from
    while at < high:
        if at < base or at + 16 > base + len(data):
            base = at
            f.seek(base)
            # Of the last record only the header is needed.
            data = f.read(min(block, high - base + 16))
        sec, length = header(data, at - base) if at + 16 <= size else (0, size)
        if length > head.longest or at + 16 + length > size:
            if at > begin:
                pieces.append((begin, at, first, False))
            resumed = _resume(f, at + 1, size, head.order, head.nanos, head.longest, second, block)
            pieces.append((at, resumed, frame, True))
            at, frame, data = resumed, frame + 1, b""
            begin, first = at, frame
            continue
        second = sec
        at += 16 + length
        frame += 1
    if at > begin:
        pieces.append((begin, at, first, False))
    return pieces, at, frame, second


_RANGE = (
    "path string, low long, high long, begin long, `end` long, frames long, second long, order string, nanos boolean, link int, "
    "pieces array<struct<start: long, stop: long, before: long, damaged: boolean>>"
)


_RANGES = pa.schema([
    *((name, pa.string() if name in ("path", "order") else pa.bool_() if name == "nanos" else pa.int32() if name == "link" else pa.int64())
      for name in ("path", "low", "high", "begin", "end", "frames", "second", "order", "nanos", "link")),
    ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("before", pa.int64()), ("damaged", pa.bool_())]))),
])


def _walk_ranges(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Ranges (path, low, high, begin, second) walked from ``begin``, or from the first plausible header if that is null."""

    def walked(f, head: _Head, r: dict) -> dict:
        begin, second = r["begin"], r["second"]
        if begin is None and r["low"] == 0:
            begin = 24
        elif begin is None:
            high = min(r["high"], head.size)
            found = _resume(f, r["low"], head.size, head.order, head.nanos, head.longest, head.second, block, stop=high)
            # None in the whole range: the range before decides.
            begin = found if found < high else None
        pieces, end, frames, second = walk(f, head, begin, r["high"], second, block) if begin is not None else ([], r["low"], 0, None)
        named = [dict(zip(("start", "stop", "before", "damaged"), p, strict=True)) for p in pieces]
        return {
            "path": r["path"], "low": r["low"], "high": r["high"], "begin": begin, "end": end, "frames": frames, "second": second,
            "order": head.order, "nanos": head.nanos, "link": head.link, "pieces": named,
        }

    for batch in batches:
        for path, ranges in groupby(batch.to_pylist(), lambda r: r["path"]):
            with _open(path) as f:
                head = _Head(f, path)
                yield pa.RecordBatch.from_pylist([walked(f, head, r) for r in ranges], schema=_RANGES)


def _tasks(spark: SparkSession, parts: int, size: int) -> int:
    """Into how many tasks so many parts of a capture go: one each while they are few, then by their bytes."""
    return max(1, min(parts, max(4 * spark.sparkContext.defaultParallelism, -(-size // CHUNK))))


def index_captures(files: DataFrame, chunk: int = CHUNK, block: int = 4 * 1024 * 1024) -> DataFrame:
    """(path, start, stop, first_frame, order, nanos, link, damaged) of all pieces of the files (path, length), about ``chunk`` bytes each."""
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length"), F.lit(1)) - 1, F.lit(chunk).cast("long"))).alias("low")
    ranges = files.select("path", "length", low)
    nothing = F.lit(None).cast("long")
    ranges = ranges.select("path", "low", F.least(F.col("low") + chunk, "length").alias("high"), nothing.alias("begin"), nothing.alias("second"))
    count, size = files.agg(F.sum(F.ceil(F.greatest(F.col("length"), F.lit(1)) / chunk)), F.sum("length")).first()

    def walked_of(some: DataFrame, parts: int) -> DataFrame:
        # Dealt from one partition, so that all tasks get equally many.
        dealt = some.coalesce(1).repartition(_tasks(files.sparkSession, parts, size or 0)).sortWithinPartitions("path", "low")
        return dealt.mapInArrow(lambda it: _walk_ranges(it, block), _RANGE)

    walked = settled(walked_of(ranges, count or 1))
    of_file = Window.partitionBy("path").orderBy("low")
    while True:
        seen = walked.select("path", "low", "high", "begin", F.lag("end").over(of_file).alias("before"), F.lag("second").over(of_file).alias("second"))
        wrong = settled(seen.where((F.col("low") > 0) & ~F.col("begin").eqNullSafe(F.col("before"))))
        again = wrong.count()
        if not again:
            break
        # Each round settles at least the first wrong range of every file; mostly a walk from the right place ends where the wrong one did.
        repeat = walked_of(wrong.select("path", "low", "high", F.col("before").alias("begin"), "second"), again)
        walked = settled(walked.join(wrong.select("path", "low"), ["path", "low"], "left_anti").unionByName(repeat))
    before = F.coalesce(F.sum("frames").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = walked.withColumn("before", before).select("*", F.explode("pieces").alias("p"))
    return pieces.select(
        "path", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"), (F.col("before") + F.col("p.before") + 1).alias("first_frame"),
        "order", "nanos", "link", F.col("p.damaged").alias("damaged"),
    )


def _records(f, piece: Any) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(bytes, where records start in them, frame number of the first) of one piece, block by block; only whole records count."""
    caught_at = struct.Struct(piece.order + "I").unpack_from
    f.seek(piece.start)
    at, frame, rest = piece.start, piece.first_frame, b""
    while at < piece.stop:
        data = rest + f.read(min(_READ, piece.stop - f.tell()))
        i, starts = 0, []
        while i + 16 <= len(data):
            after = i + 16 + caught_at(data, i + 8)[0]
            if after > len(data):
                break
            starts.append(i)
            i = after
        if starts:
            yield data[:i] if i < len(data) else data, np.array(starts, np.int64), frame
        frame += len(starts)
        at, rest = at + i, data[i:]
        if i == 0 and f.tell() >= piece.stop:
            return


def _network_layer(data: bytes, link: int) -> tuple[int, bytes]:
    """(EtherType, bytes after the link header)."""
    if link == _ETHERNET:
        kind, at = struct.unpack_from(">H", data, 12)[0], 14
        while kind in (0x8100, 0x88A8):
            kind, at = struct.unpack_from(">H", data, at + 2)[0], at + 4
        return kind, data[at:]
    if link == _SLL:
        return struct.unpack_from(">H", data, 14)[0], data[16:]
    body = data[4:] if link == _NULL else data
    return {4: 0x0800, 6: 0x86DD}.get(body[0] >> 4, 0), body


def _tcp(body: bytes) -> dict:
    sport, dport, seq, ack, bits, window, checksum, urgent = struct.unpack_from(">HHIIHHHH", body)
    head = (bits >> 12) * 4
    row = {
        "src_port": sport, "dst_port": dport, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": bits & 0xFFF,
        "tcp_window_size": window, "tcp_checksum": f"0x{checksum:04x}", "tcp_urgent_pointer": urgent,
    }
    at = 20
    while at < head:
        kind = body[at]
        if kind == 0:
            break
        size = 1 if kind == 1 else max(body[at + 1], 2)
        if kind == 2:
            row["tcp_mss"] = str(struct.unpack_from(">H", body, at + 2)[0])
        elif kind == 3:
            row["tcp_window_scale"] = str(body[at + 2])
        elif kind == 4:
            row["tcp_sack_permitted"] = "1"
        elif kind == 8:
            row["tcp_timestamp"] = str(struct.unpack_from(">I", body, at + 2)[0])
        at += size
    row["payload"] = body[head:].hex() or None
    return row


def _after_extensions(proto: int, body: bytes) -> tuple[int, bytes]:
    """The transport protocol behind IPv6 extension headers, and its bytes; a later fragment has none."""
    while proto in _EXTENSIONS:
        if proto == 44 and struct.unpack_from(">H", body, 2)[0] & 0xFFF8:
            return proto, b""
        size = 8 if proto == 44 else (body[1] + 2) * 4 if proto == 51 else (body[1] + 1) * 8
        proto, body = body[0], body[size:]
    return proto, body


def decode(data: bytes, link: int) -> dict:
    """Header fields of one frame. Application layers are left to the dissector."""
    kind, body = _network_layer(data, link)
    row: dict = {"protocol": {0x0806: "ARP", 0x86DD: "IPV6", 0x0800: "IP"}.get(kind, "ETH")}
    if kind == 0x0800:
        head, total = (body[0] & 15) * 4, struct.unpack_from(">H", body, 2)[0]
        proto, offset = body[9], struct.unpack_from(">H", body, 6)[0] & 0x1FFF
        row.update(ip_version=body[0] >> 4, ip_len=total, ip_ttl=body[8],
                   src_ip=str(ipaddress.IPv4Address(body[12:16])), dst_ip=str(ipaddress.IPv4Address(body[16:20])))
        inner = body[head : total or None] if offset == 0 else b""
    elif kind == 0x86DD:
        size = struct.unpack_from(">H", body, 4)[0]
        proto, inner = _after_extensions(body[6], body[40 : 40 + size])
        row.update(ip_version=6, ip_len=40 + size, ip_ttl=body[7], src_ip=str(ipaddress.IPv6Address(body[8:24])), dst_ip=str(ipaddress.IPv6Address(body[24:40])))
    else:
        return row
    if proto not in _TRANSPORT or not inner:
        return row
    row["protocol"] = _TRANSPORT[proto]
    if proto == 6:
        row.update(_tcp(inner))
    elif proto == 17:
        row["src_port"], row["dst_port"] = struct.unpack_from(">HH", inner)
        row["payload"] = inner[8:].hex() or None
    elif proto == 1:
        row.update(icmp_type=inner[0], icmp_code=inner[1], icmp_checksum=f"0x{struct.unpack_from('>H', inner, 2)[0]:04x}")
        if inner[0] in (0, 8):
            number, seq = struct.unpack_from(">HH", inner, 4)
            row.update(icmp_id=str(number), icmp_seq=str(seq))
    return row


def _u16(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (data[at].astype(np.int64) << 8) | data[at + 1]


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (_u16(data, at) << 16) | _u16(data, at + 2)


_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _spread(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """``values`` at ``rows`` of ``n``, NULL elsewhere."""
    place = np.full(n, -1, np.int64)
    place[rows] = np.arange(len(rows))
    return values.take(pa.array(place, mask=place < 0))


def _options(data: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The values of TCP options, below zero where there are none, and which segments have options that do not fit."""
    found = {name: np.full(len(start), -1, np.int64) for name in ("tcp_mss", "tcp_window_scale", "tcp_sack_permitted", "tcp_timestamp")}
    bad, at = np.zeros(len(start), bool), np.full(len(start), 20, np.int64)
    live = np.flatnonzero(head > 20)
    while len(live):
        live = live[at[live] < head[live]]
        short = at[live] >= size[live]
        bad[live[short]] = True
        live = live[~short]
        kind = data[start[live] + at[live]]
        live, kind = live[kind != 0], kind[kind != 0]
        needs = np.select([kind == 1, kind == 2, kind == 3, kind == 8], [1, 4, 3, 6], 2)
        short = at[live] + needs > size[live]
        bad[live[short]] = True
        live, kind = live[~short], kind[~short]
        place = start[live] + at[live]
        for name, number, value in (
            ("tcp_mss", 2, lambda x: _u16(data, x + 2)), ("tcp_window_scale", 3, lambda x: data[x + 2]),
            ("tcp_sack_permitted", 4, lambda x: 1), ("tcp_timestamp", 8, lambda x: _u32(data, x + 2)),
        ):
            here = kind == number
            found[name][live[here]] = value(place[here])
        at[live] += np.where(kind == 1, 1, np.maximum(data[np.where(kind == 1, 0, place + 1)], 2))
    return found, bad


def _table(raw: bytes, starts: np.ndarray, frames: np.ndarray, piece: Any, on_malformed: str, schema: pa.Schema) -> pa.Table:
    """The rows of the records that start at ``starts``. ``piece`` names the file and how it is written."""
    n = len(starts)
    # Gathers of rows that turn out too short stay inside.
    data = np.frombuffer(raw + bytes(64), np.uint8)
    sec, frac, caught, wire = np.ascontiguousarray(data[starts[:, None] + np.arange(16)]).view(piece.order + "u4").astype(np.int64).T
    begin = starts + 16
    end, us = begin + caught, sec * 1_000_000 + (frac // 1000 if piece.nanos else frac)

    if piece.link in (_ETHERNET, _SLL):
        where = 12 if piece.link == _ETHERNET else 14
        alone = caught < where + 2
        kind, body = _u16(data, np.where(alone, 0, begin + where)), begin + where + 2
        if piece.link == _ETHERNET:
            alone |= (kind == 0x8100) | (kind == 0x88A8)
    else:
        body = begin + (4 if piece.link == _NULL else 0)
        alone = body >= end
        version = data[np.where(alone, 0, body)] >> 4
        kind = np.select([version == 4, version == 6], [0x0800, 0x86DD], 0)
    size = end - body
    alone |= (kind == 0x0800) & (size < 20) | (kind == 0x86DD) & (size < 40)
    four, six = (np.flatnonzero((kind == x) & ~alone) for x in (0x0800, 0x86DD))

    ip = {name: np.full(n, -1, np.int64) for name in ("ip_version", "ip_len", "ip_ttl", "proto", "start", "size")}
    b, room = body[four], size[four]
    total = _u16(data, b + 2)
    skip = np.minimum((data[b] & 15).astype(np.int64) * 4, room)
    inner = np.maximum(np.where(total > 0, np.minimum(total, room), room) - skip, 0)
    inner[_u16(data, b + 6) & 0x1FFF != 0] = 0
    for name, value in (("ip_version", data[b] >> 4), ("ip_len", total), ("ip_ttl", data[b + 8]), ("proto", data[b + 9]), ("start", b + skip), ("size", inner)):
        ip[name][four] = value
    b = body[six]
    length = _u16(data, b + 4)
    for name, value in (("ip_version", 6), ("ip_len", 40 + length), ("ip_ttl", data[b + 7]), ("proto", data[b + 6]), ("start", b + 40), ("size", np.minimum(length, size[six] - 40))):
        ip[name][six] = value
    alone[six] |= np.isin(ip["proto"][six], list(_EXTENSIONS))

    known = (ip["size"] > 0) & np.isin(ip["proto"], list(_TRANSPORT))
    # Protocol numbers of the transport, -1 where it is none.
    proto = np.where(known, ip["proto"], -1)
    alone |= (proto == 1) | (proto == 6) & (ip["size"] < 20) | (proto == 17) & (ip["size"] < 4)
    tcp = np.flatnonzero((proto == 6) & ~alone)
    s, room = ip["start"][tcp], ip["size"][tcp]
    bits = _u16(data, s + 12)
    head = (bits >> 12) * 4
    options, bad = _options(data, s, room, head)
    alone[tcp[bad]] = True
    udp = np.flatnonzero((proto == 17) & ~alone)

    def whole(name: str, values: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
        return pa.array(values, mask=None if there is None else ~there).cast(schema.field(name).type)

    def named(codes: np.ndarray, texts: list[str]) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32), mask=codes < 0), pa.array(texts, pa.string())).cast(pa.string())

    columns: dict[str, pa.Array] = {
        "file_path": named(np.zeros(n, np.int32), [piece.path]), "frame_no": whole("frame_no", frames), "timestamp": whole("timestamp", us),
        "frame_len": whole("frame_len", wire), "malformed": pa.array(np.zeros(n, bool)),
    }
    names = ["ARP", "IPV6", "IP", "ETH", *_TRANSPORT.values()]
    columns["protocol"] = named(np.select([proto == x for x in _TRANSPORT], range(4, 8), np.select([kind == 0x0806, kind == 0x86DD, kind == 0x0800], range(3), 3)), names)
    for name in ("ip_version", "ip_len", "ip_ttl"):
        columns[name] = whole(name, ip[name], ip["ip_version"] >= 0)
    for name, at_four, at_six in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        codes = np.full(n, -1, np.int64)
        numbers, codes[four] = np.unique(_u32(data, body[four] + at_four), return_inverse=True)
        texts = [f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}" for x in numbers.tolist()]
        if len(six):
            wide = np.ascontiguousarray(data[(body[six] + at_six)[:, None] + np.arange(16)]).view("V16").ravel()
            distinct, back = np.unique(wide, return_inverse=True)
            codes[six] = back + len(texts)
            texts += [str(ipaddress.IPv6Address(x.tobytes())) for x in distinct]
        columns[name] = named(codes, texts)
    port = np.full(n, 0, np.int64)
    either = np.concatenate([tcp, udp])
    ported = np.zeros(n, bool)
    ported[either] = True
    for name, at in (("src_port", 0), ("dst_port", 2)):
        port[either] = _u16(data, ip["start"][either] + at)
        columns[name] = whole(name, port, ported)
    for name, values in (
        ("tcp_seq", _u32(data, s + 4)), ("tcp_ack", _u32(data, s + 8)), ("tcp_flags", bits & 0xFFF), ("tcp_window_size", _u16(data, s + 14)),
        ("tcp_urgent_pointer", _u16(data, s + 18)),
    ):
        columns[name] = _spread(whole(name, values), tcp, n)
    for name, values in options.items():
        if (values >= 0).any():
            columns[name] = _spread(whole(name, values, values >= 0), tcp, n)
    sums = np.concatenate([np.broadcast_to(np.frombuffer(b"0x", np.uint8), (len(tcp), 2)), _HEX[data[s + 16]], _HEX[data[s + 17]]], axis=1)
    columns["tcp_checksum"] = _spread(_texts(sums, np.arange(len(tcp) + 1) * 6), tcp, n)
    before = np.zeros(n, np.int64)
    before[tcp], before[udp] = np.minimum(head, room), np.minimum(8, ip["size"][udp])
    taken = np.where(ported & ~alone, ip["size"] - before, 0)
    ends = np.cumsum(taken)
    payload = data[np.repeat(ip["start"] + before - (ends - taken), taken) + np.arange(ends[-1] if n else 0)]
    hexed = _texts(_HEX[payload], np.concatenate([[0], ends]) * 2)
    columns["payload"] = hexed.take(pa.array(np.arange(n), mask=taken == 0))
    table = pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    if not alone.any():
        return table

    slow, rows = [], []
    for i in np.flatnonzero(alone).tolist():
        row = {"file_path": piece.path, "frame_no": int(frames[i]), "timestamp": int(us[i]), "frame_len": int(wire[i]), "malformed": False}
        try:
            row.update(decode(raw[begin[i] : end[i]], piece.link))
        except (struct.error, IndexError, ValueError):
            if on_malformed == "raise":
                raise
            if on_malformed == "skip":
                continue
            row["malformed"] = True
        slow.append(i)
        rows.append(row)
    by_one = pa.table([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
    fast = np.flatnonzero(~alone)
    order = np.argsort(np.concatenate([fast, np.array(slow, np.int64)]), kind="stable")
    return pa.concat_tables([table.take(fast), by_one]).take(order)


def decoded(pieces: Iterable[Any], on_malformed: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The frames of pieces of captures. Neighbouring pieces of a file are decoded together while they are small."""

    def alike(p: Any) -> tuple:
        return p.path, p.order, p.nanos, p.link, p.damaged

    def made(held: list[tuple[bytes, np.ndarray, int]], piece: Any) -> Iterator[pa.RecordBatch]:
        raw = b"".join(x[0] for x in held)
        shifts = np.cumsum([0, *(len(x[0]) for x in held)])
        starts = np.concatenate([x[1] + shift for x, shift in zip(held, shifts[:-1], strict=True)])
        frames = np.concatenate([x[2] + np.arange(len(x[1])) for x in held])
        for i in range(0, len(starts), BATCH):
            some = starts[i : i + BATCH]
            low, high = int(some[0]), int(starts[i + BATCH]) if i + BATCH < len(starts) else len(raw)
            yield from _table(raw[low:high], some - low, frames[i : i + BATCH], piece, on_malformed, schema).combine_chunks().to_batches()

    for (path, _, _, _, damaged), group in groupby(pieces, alike):
        if damaged:
            for piece in group:
                if on_malformed == "raise":
                    raise ValueError(f"{path}: no record header between bytes {piece.start} and {piece.stop}")
                if on_malformed == "mark":
                    yield pa.RecordBatch.from_pylist([{"file_path": path, "frame_no": piece.first_frame, "malformed": True}], schema=schema)
            continue
        with _open(path) as f:
            held: list[tuple[bytes, np.ndarray, int]] = []
            for piece in group:
                for block in _records(f, piece):
                    held.append(block)
                    if sum(len(x[1]) for x in held) >= BATCH or sum(len(x[0]) for x in held) >= _READ:
                        yield from made(held, piece)
                        held = []
            if held:
                yield from made(held, piece)


def _decode(batches: Iterator[pa.RecordBatch], on_malformed: str) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_DECODED)
    for batch in batches:
        yield from decoded((SimpleNamespace(**r) for r in batch.to_pylist()), on_malformed, schema)


def read_captures(
    spark: SparkSession, paths: str | Sequence[str], on_malformed: str = "skip", pattern: str = "*.pcap", chunk: int = CHUNK,
) -> DataFrame:
    """Every packet of the captures below ``paths`` in the fixed schema.

    Frames whose headers do not add up are dropped (``skip``), kept with ``malformed`` set (``mark``) or fail
    the job (``raise``). So is damage between records, which costs the records it touches, not those behind it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = union_records([discover(spark, p, pattern) for p in paths])
    if files.isEmpty():
        empty = spark.createDataFrame([], _DECODED)
        return empty if on_malformed == "mark" else empty.drop("malformed")
    index = settled(index_captures(files, chunk))
    pieces, size = index.agg(F.count(F.lit(1)), F.sum(F.col("stop") - F.col("start"))).first()
    # A fixed number of partitions: the list of pieces is tiny, their work is not.
    dealt = index.coalesce(1).repartition(_tasks(spark, pieces, size or 0)).sortWithinPartitions("path", "start")
    frames = dealt.mapInArrow(lambda it: _decode(it, on_malformed), _DECODED)
    return frames if on_malformed == "mark" else frames.where(~F.col("malformed")).drop("malformed")
