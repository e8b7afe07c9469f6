"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with a sidecar index, read by offset.

* ``record_kinds`` finds equal payloads: of those large enough, the one with the smallest key is the response, the others revisit it.
* ``write_monolithic`` writes WARC records with Spark's text writer: the end of a record is the writer's line separator, and each
  file is one gzip stream. It commits like any other table, so a lost executor leaves no half file.
* ``normalise`` inflates each stream once, in pieces, and rewrites every record as a member of its own. Beside each archive it writes
  its index, and it returns the index as rows. Files get their final name only when they are whole.
* ``read_records`` fetches single members by their offsets.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.session import scratch_path, settled

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Records of one file at most; files also end with the partition.
RECORDS_PER_FILE = 20_000
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_PIECE = 1 << 16
#: Gzip level of the rewritten members.
LEVEL = 6

INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string"
RECORD_SCHEMA = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def record_kinds(pages: DataFrame, key: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """All columns with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (the response's key).

    Null payloads are empty. Rows without a key are responses that nobody refers to; of rows with equal key and payload all are the
    response. Only digests that occur twice or more are joined back, so the usual page meets a small table.
    """
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    own = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in own],
        F.octet_length(text).cast("bigint").alias("payload_bytes"), F.sha2(text.cast("binary"), 256).alias("payload_digest"),
    )
    large = rows.where((F.col("payload_bytes") >= least_bytes) & F.col(f"`{key}`").isNotNull())
    first = large.groupBy("payload_digest").agg(F.min(F.col(f"`{key}`")).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    # Written, so that Spark knows its size: only a small one is broadcast, and then no payload is shuffled.
    joined = rows.join(settled(first.select("payload_digest", "_first")), "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col(f"`{key}`") != F.col("_first"))
    revisit = F.coalesce(revisit, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line ends in a value would end the header, so they are written as in addresses."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit("\r\n")), F.lit(""))


def _identifier(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def as_records(kinds: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """One column ``value``: the WARC record of each row, without the two line ends that close it."""
    text = F.when(F.col("record_type") == "response", F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))).otherwise(F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    length = F.octet_length(http) + F.octet_length(text)
    head = [
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.coalesce(_identifier(F.col(f"`{key}`")), F.lit("<urn:page:>"))),
        _header("WARC-Date", F.lit(DATE)), _header("WARC-Target-URI", F.col(f"`{url}`").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", _identifier(F.col("refers_to"))),
        _header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", length.cast("string")), F.lit("\r\n"),
    ]
    return kinds.select(F.concat(*head, http, text).alias("value"))


def write_monolithic(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Files of WARC records below ``path``, each one gzip stream."""
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Bytes of a gzip file of one or more members, inflated piece by piece."""

    def __init__(self, content: memoryview, name: str):
        self.content, self.name, self.at = content, name, 0
        self.inflate = zlib.decompressobj(31)
        self.buffer = bytearray()

    def more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            if not rest and self.at >= len(self.content):
                return False
            self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(rest)
            return True
        if self.at >= len(self.content):
            if self.at == 0:
                return False
            raise ValueError(f"{self.name}: the gzip stream ends early")
        self.buffer += self.inflate.decompress(self.content[self.at : self.at + _PIECE])
        self.at += _PIECE
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the next ``mark``, with it; None at the end of the stream."""
        start = 0
        while (found := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError(f"{self.name}: a record has no end of headers")
                return None
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError(f"{self.name}: a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def headers(head: bytes) -> dict[str, str]:
    """Names are lower-cased; the first line is left out."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def split_records(content: memoryview, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record with its end) of each record of a gzip file."""
    stream = _Stream(content, name)
    while (head := stream.until(_END)) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: a record does not begin with a version")
        fields = headers(head)
        body = stream.take(int(fields["content-length"]) + len(_END))
        if not body.endswith(_END):
            raise ValueError(f"{name}: a record does not end with two line ends")
        yield fields, head + body


def _member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """(archive, offset, length, record_id, record_type) of every record, in order of the files.

    Reads the gzip files below ``source`` (one stream or many members) and writes below ``target`` an archive of the same name with
    one member per record, and beside it ``.idx``: a line of offset, length and record id per record. A damaged file raises an error
    that names it. The rows are written once, so the rewriting happens once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                name = path.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"
                final, trial = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
                rows, at = [], 0
                with store.open_output_stream(trial, compression=None) as out:
                    for fields, record in split_records(content, path):
                        member = _member(record, level)
                        out.write(member)
                        rows.append((name, at, len(member), fields.get("warc-record-id"), fields.get("warc-type")))
                        at += len(member)
                with store.open_output_stream(f"{trial}.idx", compression=None) as out:
                    for _, offset, length, record_id, _ in rows:
                        out.write(f"{offset} {length} {record_id}\n".encode())
                store.move(f"{trial}.idx", f"{final}.idx")
                store.move(trial, final)
                columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["archive", "offset", "length", "record_id", "record_type"])

    return settled(files.mapInArrow(rewrite, INDEX_SCHEMA))


def _key_of(identifier: str | None) -> str | None:
    return identifier.removeprefix("<urn:page:").removesuffix(">") or None if identifier else None


def read_records(index: DataFrame, target: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed record, each fetched by its offset.

    The digest of a response is taken from the payload read and must be the one its header names; a revisit has that of its header.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = pyarrow.fs.FileSystem.from_uri(target)
        for batch in batches:
            rows = []
            for archive, group in batch.groupby("archive", sort=False):
                with store.open_input_file(f"{folder}/{archive}") as file:
                    for offset, length in zip(group["offset"], group["length"], strict=True):
                        record = zlib.decompress(file.read_at(int(length), int(offset)), 31)
                        head, _, rest = record.partition(_END)
                        fields = headers(head)
                        http, _, payload = rest[: int(fields["content-length"])].partition(_END)
                        size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response":
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{archive} at {offset}: the payload is not what the headers say")
                        rows.append((_key_of(fields["warc-record-id"]), size, digest, fields["warc-type"], _key_of(fields.get("warc-refers-to"))))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "offset", "length").mapInPandas(fetch, RECORD_SCHEMA)


def op6_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the normalised archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    whole, members = scratch_path(spark, "whole"), scratch_path(spark, "members")
    write_monolithic(as_records(record_kinds(pages, "page_id", "html"), "page_id", "url", "html"), whole)
    kind = pages.schema["page_id"].dataType
    back = read_records(normalise(spark, whole, members), members)
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
