"""Dissected packet records: discovery, reading, one schema, quarantine of broken rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from packetloom.schema import COLUMN_ALIASES, PACKET_SCHEMA

CORRUPT = "_corrupt_record"


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of all files below ``path`` whose name fits; empty when there is no such folder.

    Only the listing is read: the content column is pruned.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        return files.select("path", "length")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, length long")


def canonical(df: DataFrame) -> DataFrame:
    """The fixed packet schema: known aliases renamed, absent layers NULL, unfit values NULL, file path from the reader."""
    have = {COLUMN_ALIASES.get(c, c): c for c in df.columns}
    have.update({c: c for c in df.columns if c in PACKET_SCHEMA.fieldNames()})

    def field(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        column = F.col(have[f.name])
        if isinstance(f.dataType, T.TimestampType):
            kind = df.schema[have[f.name]].dataType
            if isinstance(kind, T.StringType):
                return F.try_to_timestamp(column).alias(f.name)
            if isinstance(kind, T.NumericType):
                return F.timestamp_micros((column * 1_000_000).cast("long")).alias(f.name)
            return column.cast("timestamp").alias(f.name)
        return (column.try_cast(f.dataType) if f.dataType != df.schema[have[f.name]].dataType else column).alias(f.name)

    return df.select(*[field(f) for f in PACKET_SCHEMA.fields])


def _reader(spark: SparkSession, fmt: str, on_malformed: str):
    reader = spark.read.option("recursiveFileLookup", "true")
    if fmt in ("json", "csv"):
        schema = T.StructType([*PACKET_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
        mode = "FAILFAST" if on_malformed == "raise" else "PERMISSIVE"
        reader = reader.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "csv":
            reader = reader.option("header", "true").option("enforceSchema", "false")
    return reader.format(fmt)


def read_records(spark: SparkSession, paths: str | Sequence[str], fmt: str, on_malformed: str = "skip") -> DataFrame:
    """Packet records of one format as the fixed schema.

    Rows a text reader cannot parse are dropped (``skip``), kept with their text in ``_corrupt_record``
    (``mark``) or fail the job (``raise``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = _reader(spark, fmt, on_malformed).load(paths).withColumn("__path", F.col("_metadata.file_path"))
    known = raw.withColumn("file_path", F.coalesce("file_path", "__path") if "file_path" in raw.columns else F.col("__path"))
    if CORRUPT not in raw.columns:
        return canonical(known)
    if on_malformed == "raise":
        return canonical(known)
    # Always true, but it names every field: a row must not count as sound because a query left its bad field out.
    whole = F.xxhash64(*PACKET_SCHEMA.fieldNames()) >= F.lit(-(2**63))
    good = canonical(known.where(F.col(CORRUPT).isNull() & whole))
    if on_malformed == "skip":
        return good
    bad = known.where(F.col(CORRUPT).isNotNull() & whole).select("file_path", CORRUPT)
    return good.withColumn(CORRUPT, F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def union_records(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several inputs; a column some lack is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _captures(spark: SparkSession, paths: Sequence[str], on_malformed: str) -> DataFrame:
    from packetloom.sources.capture import read_captures

    return read_captures(spark, list(paths), on_malformed)


# File extension -> reader. ``register_source`` adds to it.
_SOURCES: dict[str, Callable[[SparkSession, Sequence[str], str], DataFrame]] = {
    **{fmt: (lambda f: lambda spark, paths, mode: read_records(spark, paths, f, mode))(fmt) for fmt in ("parquet", "orc", "json", "csv")},
    "pcap": _captures,
}


def register_source(extension: str, read: Callable[[SparkSession, Sequence[str], str], DataFrame]) -> None:
    """Make files with this extension readable through ``read_packets``."""
    _SOURCES[extension.lstrip(".").lower()] = read


def read_packets(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, on_malformed: str = "skip") -> DataFrame:
    """Packets from any mix of files; the format comes from each file's extension unless given."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[str, list[str]] = {}
    for path in paths:
        kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind not in _SOURCES:
            raise ValueError(f"no reader for {path!r}; known: {sorted(_SOURCES)}")
        groups.setdefault(kind, []).append(path)
    return union_records([_SOURCES[kind](spark, group, on_malformed) for kind, group in groups.items()])


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    """Numeric columns of a CSV with header; gaps become 0."""
    from packetloom.operators.clean import fill_zero, numeric_only

    return fill_zero(numeric_only(spark.read.option("header", "true").option("inferSchema", "true").csv(path)))
