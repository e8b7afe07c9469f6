"""Captures as a data source: ``spark.read.format("pcap")``, ``readStream`` and ``write``, once ``register(spark)`` was called.

``load`` takes a file, a folder or a glob of names below it. With the option ``index`` (a table written by ``write_index``) every piece of the
captures is one input partition, so a huge file is read by many tasks; where there are very many, neighbours share one. Without it, a file is
one partition. ``onMalformed`` is ``skip`` (the default), ``mark`` (a column ``malformed``) or ``raise``.

A stream takes new captures by their time of modification, so files are to be moved into the folder whole, and later ones with later times.
``write`` makes one capture per task, of Ethernet frames with the header fields of each row; tasks that fail leave no file. Frames are made
thousands at a time; a batch with a row that this does not cover is made by ``frame_of``, row by row, with the same bytes.
"""

from __future__ import annotations

import fnmatch
import ipaddress
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from packetloom.schema import PACKET_SCHEMA
from packetloom.sources import capture
from packetloom.sources.records import discover

FORMAT = "pcap"
#: Blocks that a file without an index is walked in.
_BLOCK = 4 * 1024 * 1024
#: So many input partitions have one piece each; more pieces are put together.
_PARTITIONS = 256


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def write_index(spark: SparkSession, paths: str | Sequence[str], target: str, pattern: str = "*.pcap", chunk: int = capture.CHUNK) -> None:
    """The pieces of all captures below ``paths`` as a Parquet table, for the option ``index``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for i, path in enumerate(paths):
        capture.index_captures(discover(spark, path, pattern), chunk).write.mode("append" if i else "overwrite").parquet(target)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _named(path: str, like: str) -> str:
    """A path of the listing with the scheme of the one that was asked for."""
    return f"file://{path}" if "://" not in like and not like.startswith("file:") or like.startswith("file:") else f"{like.split('://')[0]}://{path}"


@dataclass
class _File:
    path: str
    changed: int


def _listed(path: str, pattern: str) -> list[_File]:
    system, inner = _system(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    files = [x for x in found if x.type == fs.FileType.File and (x is info or fnmatch.fnmatch(x.base_name, pattern))]
    return sorted((_File(_named(x.path, path), x.mtime_ns or 0) for x in files), key=lambda x: (x.changed, x.path))


@dataclass
class Piece(InputPartition):
    """Records of a file between two offsets, or the whole file if ``stop`` is below zero."""

    path: str
    start: int = 0
    stop: int = -1
    first_frame: int = 1
    order: str = "<"
    nanos: bool = False
    link: int = 1
    damaged: bool = False


@dataclass
class Pieces(InputPartition):
    """Neighbouring pieces of an index."""

    pieces: list[Piece]


def _together(pieces: list[Piece]) -> list[Pieces]:
    """Neighbours share a partition, of about equally many bytes, where there are more than ``_PARTITIONS`` pieces."""
    if len(pieces) <= _PARTITIONS:
        return [Pieces([x]) for x in pieces]
    pieces = sorted(pieces, key=lambda x: (x.path, x.start))
    ends = np.cumsum([x.stop - x.start for x in pieces])
    share = ends[-1] / max(_PARTITIONS, -(-ends[-1] // capture.CHUNK))
    cuts = np.flatnonzero(np.diff((ends - 1) // share, prepend=0)).tolist()
    return [Pieces(pieces[i:j]) for i, j in zip([0, *cuts], [*cuts, len(pieces)], strict=True) if i < j]


class _Decoder:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.mode = options.get("onmalformed", options.get("onMalformed", "skip"))
        self.path = options["path"]
        self.pattern = options.get("pattern", "*.pcap")
        self.index = options.get("index")

    def pieces_of(self, piece: Piece) -> Iterator[Piece]:
        if piece.stop >= 0:
            yield piece
            return
        with capture._open(piece.path) as f:
            head = capture._Head(f, piece.path)
            found, *_ = capture.walk(f, head, 24, head.size, None, _BLOCK)
        for start, stop, before, damaged in found:
            yield Piece(piece.path, start, stop, before + 1, head.order, head.nanos, head.link, damaged)

    def read(self, whole: Piece | Pieces) -> Iterator[pa.RecordBatch]:
        pieces = whole.pieces if isinstance(whole, Pieces) else self.pieces_of(whole)
        return capture.decoded(pieces, self.mode, to_arrow_schema(self.schema))


class PcapReader(DataSourceReader):
    def __init__(self, decoder: _Decoder):
        self.decoder = decoder

    def partitions(self) -> Sequence[InputPartition]:
        d = self.decoder
        if not d.index:
            return [Piece(x.path) for x in _listed(d.path, d.pattern)]
        system, inner = _system(d.index)
        files = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith(".parquet")]
        table = pyarrow.dataset.dataset(files, filesystem=system, format="parquet").to_table()
        return _together([Piece(r["path"], r["start"], r["stop"], r["first_frame"], r["order"], r["nanos"], r["link"], r["damaged"]) for r in table.to_pylist()])

    def read(self, partition: Piece | Pieces | None) -> Iterator[pa.RecordBatch]:
        # Without any file there is one partition of nothing.
        return self.decoder.read(partition) if partition is not None else iter(())


class PcapStreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last capture taken."""

    def __init__(self, decoder: _Decoder):
        self.decoder = decoder

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.decoder.path, self.decoder.pattern)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((x["changed"], x["path"]) for x in (start, end))
        return [Piece(x.path) for x in _listed(self.decoder.path, self.decoder.pattern) if low < (x.changed, x.path) <= high]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.decoder.read(partition)


def _checked(data: bytes) -> int:
    """The Internet checksum."""
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def frame_of(row: Any) -> bytes:
    """An Ethernet frame with the addresses, ports, flags, numbers and payload of a row; what the row does not say is zero."""
    payload = bytes.fromhex(row.payload) if getattr(row, "payload", None) else b""
    value = lambda name: int(getattr(row, name, None) or 0)
    if getattr(row, "tcp_flags", None) is not None:
        proto = 6
        body = struct.pack(">HHIIHHHH", value("src_port"), value("dst_port"), value("tcp_seq"), value("tcp_ack"), 5 << 12 | value("tcp_flags") & 0xFFF, value("tcp_window_size"), 0, 0) + payload
    else:
        proto = 17
        body = struct.pack(">HHHH", value("src_port"), value("dst_port"), 8 + len(payload), 0) + payload
    source, target = (ipaddress.ip_address(x or "0.0.0.0") for x in (row.src_ip, row.dst_ip))
    if source.version != target.version:
        raise ValueError(f"addresses of two kinds: {source} and {target}")
    ttl = value("ip_ttl") or 64
    if source.version == 6:
        return b"\x00" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 0x60000000, len(body), proto, ttl) + source.packed + target.packed + body
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, 0, source.packed, target.packed)
    return b"\x00" * 12 + b"\x08\x00" + head[:10] + struct.pack(">H", _checked(head)) + head[12:] + body


#: What ``frame_of`` and the record header take from a row.
_FIELDS = ("timestamp", "frame_len", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_window_size", "ip_ttl", "payload")
_NIBBLE = np.full(256, 255, np.uint8)
_NIBBLE[list(b"0123456789abcdef")] = range(16)
_NIBBLE[list(b"ABCDEF")] = range(10, 16)


def _record_of(row: Any) -> bytes:
    frame = frame_of(row)
    us = int(row.timestamp.timestamp()) * 1_000_000 + row.timestamp.microsecond if row.timestamp else 0
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), max(len(frame), int(getattr(row, "frame_len", None) or 0))) + frame


def _big(out: np.ndarray, at: int, values: np.ndarray, width: int) -> None:
    """Numbers of ``width`` bytes, highest first, into the columns from ``at`` on."""
    for i in range(width):
        out[:, at + i] = values >> 8 * (width - 1 - i) & 255


def _payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes that hexadecimal texts stand for, and how many each has; none if a text is anything else."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    half = _NIBBLE[raw]
    sizes = np.diff(offsets)
    if (sizes & 1).any() or (half > 15).any():
        return None
    return half[::2] << 4 | half[1::2], sizes // 2


def _records_of(batch: pa.RecordBatch) -> bytes | None:
    """The records of all rows, as ``_record_of`` makes them; none if a row is out of the ordinary."""
    n = batch.num_rows
    if not n:
        return b""
    have = dict(zip(batch.schema.names, batch.columns, strict=True))

    def numbers(name: str, most: int) -> np.ndarray | None:
        values = have.get(name, pa.nulls(n, pa.int64()))
        if not pa.types.is_integer(values.type) and not pa.types.is_null(values.type):
            return None
        values = pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        return values if 0 <= values.min() and values.max() <= most else None

    texts = have.get("payload", pa.nulls(n, pa.string()))
    if not {"timestamp", "src_ip", "dst_ip"} <= have.keys():
        return None
    at = have["timestamp"]
    if not pa.types.is_timestamp(at.type) or at.type.unit != "us" or at.type.tz is None or not all(pa.types.is_string(x.type) for x in (texts, have["src_ip"], have["dst_ip"])):
        return None
    us = pc.fill_null(at.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    payloads = _payloads(texts)
    sport, dport, window = (numbers(name, 0xFFFF) for name in ("src_port", "dst_port", "tcp_window_size"))
    seq, ack, ttl = numbers("tcp_seq", 0xFFFFFFFF), numbers("tcp_ack", 0xFFFFFFFF), numbers("ip_ttl", 0xFF)
    flags, wire = numbers("tcp_flags", 1 << 62), numbers("frame_len", 0xFFFFFFFF)
    if payloads is None or any(x is None for x in (sport, dport, window, seq, ack, ttl, flags, wire)) or us.min() < 0 or us.max() >= 1_000_000 << 32:
        return None
    payload, sizes = payloads
    tcp = ~have["tcp_flags"].is_null().to_numpy(zero_copy_only=False) if "tcp_flags" in have else np.zeros(n, bool)
    six, packed = np.zeros((n, 2), bool), np.zeros((n, 2, 16), np.uint8)
    for side, name in enumerate(("src_ip", "dst_ip")):
        coded = pc.fill_null(have[name], "").dictionary_encode()
        try:
            known = [ipaddress.ip_address(x or "0.0.0.0") for x in coded.dictionary.to_pylist()]
        except ValueError:
            return None
        which = coded.indices.to_numpy()
        six[:, side] = np.array([x.version == 6 for x in known])[which]
        packed[:, side] = np.array([list(x.packed.ljust(16, b"\0")) for x in known], np.uint8)[which]
    body = np.where(tcp, 20, 8) + sizes
    if (six[:, 0] != six[:, 1]).any() or (body + np.where(six[:, 0], 0, 20) > 0xFFFF).any():
        return None

    ttl = np.where(ttl == 0, 64, ttl)
    caught = 14 + np.where(six[:, 0], 40, 20) + body
    ends = np.cumsum(16 + caught)
    starts = ends - 16 - caught
    out = np.zeros(int(ends[-1]), np.uint8)
    for version, proto in ((4, 6), (4, 17), (6, 6), (6, 17)):
        rows = np.flatnonzero((six[:, 0] == (version == 6)) & (tcp == (proto == 6)))
        if not len(rows):
            continue
        ip, at_body = 30, 30 + (40 if version == 6 else 20)
        head = np.zeros((len(rows), at_body + (20 if proto == 6 else 8)), np.uint8)
        head[:, :16] = np.stack([us[rows] // 1_000_000, us[rows] % 1_000_000, caught[rows], np.maximum(caught, wire)[rows]], axis=1).astype("<u4").view(np.uint8)
        if version == 4:
            length = 20 + body[rows]
            _big(head, 28, np.array([0x0800]), 2)
            head[:, ip], head[:, ip + 8], head[:, ip + 9] = 0x45, ttl[rows], proto
            _big(head, ip + 2, length, 2)
            head[:, ip + 12 : ip + 16], head[:, ip + 16 : ip + 20] = packed[rows, 0, :4], packed[rows, 1, :4]
            total = head[:, ip : ip + 20].reshape(len(rows), 10, 2).astype(np.int64) @ np.array([256, 1])
            total = total.sum(axis=1)
            for _ in range(2):
                total = (total & 0xFFFF) + (total >> 16)
            _big(head, ip + 10, ~total & 0xFFFF, 2)
        else:
            _big(head, 28, np.array([0x86DD]), 2)
            head[:, ip], head[:, ip + 6], head[:, ip + 7] = 0x60, proto, ttl[rows]
            _big(head, ip + 4, body[rows], 2)
            head[:, ip + 8 : ip + 24], head[:, ip + 24 : ip + 40] = packed[rows, 0], packed[rows, 1]
        _big(head, at_body, sport[rows], 2)
        _big(head, at_body + 2, dport[rows], 2)
        if proto == 6:
            _big(head, at_body + 4, seq[rows], 4)
            _big(head, at_body + 8, ack[rows], 4)
            _big(head, at_body + 12, 5 << 12 | flags[rows] & 0xFFF, 2)
            _big(head, at_body + 14, window[rows], 2)
        else:
            _big(head, at_body + 4, body[rows], 2)
        out[starts[rows][:, None] + np.arange(head.shape[1])] = head
    out[np.repeat(ends - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(payload))] = payload
    return out.tobytes()


@dataclass
class _Written(WriterCommitMessage):
    part: str
    target: str


class PcapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        if overwrite:
            system, inner = _system(self.path)
            system.create_dir(inner, recursive=True)
            self.old = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith(".pcap")]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        part = f"{inner}/_{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 1))
            for batch in batches:
                made = _records_of(batch)
                out.write(b"".join(_record_of(SimpleNamespace(**r)) for r in batch.to_pylist()) if made is None else made)
        return _Written(part, f"{inner}/part-{uuid.uuid4().hex}.pcap")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _system(self.path)
        for path in self.old if self.overwrite else []:
            system.delete_file(path)
        for m in messages:
            if m is not None:
                system.move(m.part, m.target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.part)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        marked = self.options.get("onMalformed", "skip") == "mark"
        return StructType([*PACKET_SCHEMA.fields, *([StructField("malformed", BooleanType())] if marked else [])])

    def _decoder(self, schema: StructType) -> _Decoder:
        return _Decoder(schema, {k: self.options[k] for k in ("path", "pattern", "index", "onMalformed") if k in self.options})

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcapReader(self._decoder(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PcapStreamReader(self._decoder(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PcapWriter(self.options["path"], overwrite)


def write_captures(df: DataFrame, path: str, mode: str = "append") -> None:
    """The packets as captures below ``path``, one for each partition."""
    register(df.sparkSession)
    # Other columns are not computed for it.
    df = df.select(*[c for c in df.columns if c in _FIELDS])
    df.write.format(FORMAT).mode(mode).save(path)
