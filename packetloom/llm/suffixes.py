"""Removal of long repeated byte strings by prefix-free parsing.

A string of ``span`` bytes that starts in two places has the same trigger at the same distance in both, as triggers depend on content only.
So starts are gathered into phrases: neighbouring starts of one text with the same trigger. A phrase is known by the hash of the bytes every
one of its spans has after the trigger (``context``), and by the hash of all its bytes (``phrase``).

1. Parse: contexts of all phrases are counted. A context that occurs once has no repeated span.
2. Dictionary: the other phrases, with their numbers of copies. All spans of a phrase with copies are repeated; highly repetitive text is
   done here, whatever its copies.
3. Suffix order: contexts with several phrases, of which some occur once, need single spans. The suffixes of these phrases are sorted by
   their first ``span`` bytes within the context, and neighbours that agree are repeated. Suffixes of very many phrases (a common
   passage with different surroundings) are dealt out by a hash of those bytes instead, and counted.
4. Corpus: the runs of repeated spans go back to all places of their phrases, and from there to the texts.

Texts are read three times and never shuffled, but for those that lose bytes. Bitmaps of fixed size spare rows in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from packetloom.llm import textbytes
from packetloom.llm.bitmap import bitmap, known
from packetloom.llm.groups import together, whole_groups
from packetloom.llm.parsing import REACH, phrases, pieces
from packetloom.session import settled

SPAN = 200
#: Phrases of a context that are sorted in one task; beyond, their suffixes are dealt out.
LARGE = 4096
#: Bytes of text that are parsed at a time. A byte costs some hundred bytes of memory meanwhile.
PARSED_BYTES = 1 << 18
#: Phrases a worker remembers to have sent the bytes of. Forgetting costs bytes, not results.
_SENT = 200_000


def _parsed(column: pa.Array, span: int) -> Iterator[tuple]:
    """(texts, bytes, first, last, context, phrase) of every piece; ``texts`` and ``starts`` say where each phrase stands."""
    for row, data, offsets in textbytes.slices(column, PARSED_BYTES):
        for at, part, starts in pieces(data, offsets, span, PARSED_BYTES):
            first, last, trigger = phrases(part, starts, span)
            if not len(first):
                continue
            context = textbytes.span_hashes(part, trigger, trigger + (span + 1 - REACH), 1)
            phrase = textbytes.span_hashes(part, first, last + span, 2)
            text = np.searchsorted(offsets, first + at, "right") - 1
            yield row + text, part, first, last, first + at - offsets[text], context, phrase


def _contexts(source: DataFrame, span: int) -> DataFrame:
    """(context, several) of the contexts that occur twice or more; ``several`` if with different phrases."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, context, phrase in _parsed(batch.column(0), span):
                yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(phrase.view(np.int64))], ["context", "phrase"])

    seen = source.select("body").mapInArrow(emit, "context bigint, phrase bigint")
    counted = seen.groupBy("context").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    return counted.where("n > 1").select("context", (F.col("low") != F.col("high")).alias("several"))


_PLACES = "context bigint, phrase bigint, key bigint, tag bigint, low bigint, spans int, bytes binary"


def _places(source: DataFrame, span: int, repeated, several) -> DataFrame:
    """Where phrases with a repeated context stand; with their bytes if the context may have several phrases, mostly once per worker."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for text, part, first, last, low, context, phrase in _parsed(batch.column(2), span):
                mine = np.flatnonzero(known(repeated.value, context))
                if not len(mine):
                    continue
                text, first, last, low, context, phrase = (x[mine] for x in (text, first, last, low, context, phrase))
                with_bytes = known(several.value, context)
                content: list[bytes | None] = [None] * len(mine)
                if len(sent) > _SENT:
                    sent.clear()
                for i in np.flatnonzero(with_bytes).tolist():
                    name = int(phrase[i])
                    if name not in sent:
                        sent.add(name)
                        content[i] = part[first[i] : last[i] + span].tobytes()
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(context.view(np.int64)), pa.array(phrase.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array(low.astype(np.int64)), pa.array((last - first + 1).astype(np.int32)), pa.array(content, pa.binary()),
                    ],
                    ["context", "phrase", "key", "tag", "low", "spans", "bytes"],
                )

    return source.select("key", "tag", "body").mapInArrow(emit, _PLACES)


_RUNS = "context bigint, phrase bigint, low int, high int"


def _sorted_suffixes(entries: DataFrame, span: int) -> DataFrame:
    """Runs of repeated spans of phrases that occur once, from the suffix order within each context."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["context"], 2048):
            offsets = np.concatenate([[0], np.cumsum(table.column("spans").to_numpy().astype(np.int64) + span - 1)])
            data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            copies, spans = table.column("copies").to_numpy(), table.column("spans").to_numpy().astype(np.int64)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            entry = np.repeat(np.arange(len(spans)), spans)
            step = np.arange(len(entry)) - np.repeat(np.cumsum(spans) - spans, spans)
            suffix = np.empty((len(entry), span + 4), np.uint8)
            suffix[:, :4] = group[entry].astype(">u4").view(np.uint8).reshape(-1, 4)
            suffix[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, span)[offsets[entry] + step]
            order = np.argsort(suffix.view(f"S{span + 4}").ravel(), kind="stable")
            ranked = suffix[order]
            same = (ranked[1:] == ranked[:-1]).all(1)
            repeated = np.zeros(len(entry), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            repeated &= (copies == 1)[entry]
            yield _runs(table, entry, step, repeated)

    wanted = entries.select("context", "phrase", "copies", "spans", "bytes")
    return together(wanted, ["context"]).mapInArrow(search, _RUNS)


def _runs(table: pa.Table, entry: np.ndarray, step: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(repeated)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (entry[at[1:]] != entry[at[:-1]]) | (step[at[1:]] != step[at[:-1]] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    rows = pa.array(entry[at[first]])
    arrays = [table.column(c).combine_chunks().take(rows) for c in ("context", "phrase")]
    arrays += [pa.array(step[at[first]].astype(np.int32)), pa.array(step[at[last]].astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["context", "phrase", "low", "high"])


def _dealt_suffixes(entries: DataFrame, span: int) -> DataFrame:
    """The same runs, span by span, for contexts of any number of phrases: suffixes are dealt by 128 bits of hash and counted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["context", "phrase", "copies", "step", "w1", "w2"]
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = batch.slice(row, 1024)
                spans = part.column(3).to_numpy().astype(np.int64)
                data = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
                offsets = np.cumsum(spans + span - 1) - (spans + span - 1)
                entry = np.repeat(np.arange(len(spans)), spans)
                step = np.arange(len(entry)) - np.repeat(np.cumsum(spans) - spans, spans)
                start = offsets[entry] + step
                hashes = [textbytes.span_hashes(data, start, start + span, seed).view(np.int64) for seed in (3, 4)]
                rows = pa.array(entry)
                arrays = [part.column(k).take(rows) for k in range(3)] + [pa.array(step.astype(np.int32)), *map(pa.array, hashes)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = entries.select("context", "phrase", "copies", "spans", "bytes")
    dealt = settled(wanted.mapInArrow(emit, "context bigint, phrase bigint, copies bigint, step int, w1 bigint, w2 bigint"))
    often = dealt.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2")
    return dealt.where("copies = 1").join(often, ["w1", "w2"], "left_semi").select("context", "phrase", F.col("step").alias("low"), F.col("step").alias("high"))


def _marks(source: DataFrame, span: int) -> DataFrame:
    """(key, tag, begins, stops): for each text with repeated spans, where they are; they may overlap. Rows equal in key and tag share theirs."""
    context = source.sparkSession.sparkContext
    found = settled(_contexts(source, span))
    repeated = context.broadcast(bitmap(found, "context"))
    several = context.broadcast(bitmap(found.where("several"), "context"))
    places = settled(_places(source, span, repeated, several).withColumn("place", F.monotonically_increasing_id()))
    entries = places.groupBy("context", "phrase").agg(
        F.count("*").alias("copies"), F.min(F.when(F.col("bytes").isNotNull(), F.col("place"))).alias("place")
    )
    entries = settled(entries)
    mixed = entries.groupBy("context").agg(F.count("*").alias("phrases"), F.min("copies").alias("least")).where("phrases > 1 AND least = 1")
    chosen = entries.join(mixed.select("context", "phrases"), "context").select("place", "copies", "phrases")
    texts = settled(places.where(F.col("bytes").isNotNull()).select("place", "context", "phrase", "spans", "bytes").join(chosen, "place"))
    runs = _sorted_suffixes(texts.where(F.col("phrases") <= LARGE), span).union(_dealt_suffixes(texts.where(F.col("phrases") > LARGE), span))
    whole = entries.where("copies > 1").select("context", "phrase", F.lit(0).alias("low"), F.lit(-1).alias("high"))
    result = whole.union(runs).withColumnsRenamed({"low": "from", "high": "to"})
    marked = places.select("context", "phrase", "key", "tag", "low", "spans").join(result, ["context", "phrase"])
    begin = F.col("low") + F.col("from")
    stop = F.col("low") + F.when(F.col("to") < 0, F.col("spans") - 1).otherwise(F.col("to")) + span
    listed = marked.select("key", "tag", begin.alias("begin"), stop.alias("stop")).groupBy("key", "tag").agg(F.collect_set(F.struct("begin", "stop")).alias("marks"))
    return listed.select("key", "tag", F.col("marks.begin").alias("begins"), F.col("marks.stop").alias("stops"))


def without_spans(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes outside all spans, and the number of maximal runs removed."""
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.subtract.at(depth, stops, 1)
    covered = np.cumsum(depth[:-1]) > 0
    runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(data) else 0
    return data[~covered], runs


def remove_repeats(docs: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``doc`` holds the columns named in ``carry``.

    Removed is every byte covered by a string of ``span`` bytes that also starts anywhere else in the table, judged on the
    input. ``kept`` is null unless ``with_text``; characters that lost some of their bytes are left out of it, while the digest is of the
    bytes. Null and empty texts have no bytes. Rows are told apart by their integer key (null included) and a hash of the text; rows
    equal in both repeat each other and lose the same bytes, as do copies under other keys. An empty table stays empty.
    """
    textbytes.bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.col(f"`{key}`").cast("bigint")
    source = docs.select(
        F.coalesce(number, F.lit(0)).alias("key"), F.xxhash64(body, number.isNull()).alias("tag"), body.alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
    )
    marks = settled(_marks(source, span))
    scrambled = F.xxhash64("key", "tag")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(marks.select(scrambled.alias("hash"))))
    names = ["doc", "key", "tag", "n_bytes", "sha", "body"]

    def finish_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loses = known(bits.value, batch.column(4).to_numpy().view(np.uint64))
            bodies = batch.column(3)
            for row, data, offsets in textbytes.slices(bodies):
                n = len(offsets) - 1
                mine = loses[row : row + n]
                parts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sha = [None if m else hashlib.sha256(p).hexdigest() for p, m in zip(parts, mine, strict=True)]
                content = [p.tobytes() if m or with_text else None for p, m in zip(parts, mine, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n), batch.column(1).slice(row, n), batch.column(2).slice(row, n),
                        pa.array(np.diff(offsets).astype(np.int64)), pa.array(sha, pa.string()), pa.array(content, pa.binary()),
                    ],
                    names,
                )

    kept_doc = source.schema["doc"]
    first = StructType([
        kept_doc, StructField("key", LongType()), StructField("tag", LongType()), StructField("n_bytes", LongType()), StructField("sha", StringType()),
        StructField("body", BinaryType()),
    ])
    rows = source.select("doc", "key", "tag", "body", scrambled.alias("hash")).mapInArrow(finish_clean, first)
    joined = rows.join(marks, ["key", "tag"], "left").select("doc", "n_bytes", "sha", "body", "begins", "stops")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas, kept = [], [], [], []
            size, sha = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                # A text without its own digest is one that may lose bytes.
                data = np.frombuffer(batch.column(3)[i].as_buffer() or b"", np.uint8) if batch.column(3)[i].is_valid else np.zeros(0, np.uint8)
                runs, digest = 0, sha[i]
                if digest is None:
                    if batch.column(4)[i].is_valid:
                        begins, stops = (np.asarray(batch.column(k)[i].values) for k in (4, 5))
                        data, runs = without_spans(data, begins, stops)
                    digest = hashlib.sha256(data).hexdigest()
                    removed.append(size[i] - len(data))
                else:
                    removed.append(0)
                spans.append(runs)
                shas.append(digest)
                kept.append(data.tobytes().decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    last = StructType([
        kept_doc, StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
        StructField("kept", StringType()),
    ])
    return joined.mapInArrow(finish, last)


def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same in DuckDB over hexadecimal text: every string of SPAN bytes by its digest, their merged places, the rest put together.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, n, s, substr(h, 2 * s + 1, {4 * SPAN}) AS part FROM (SELECT doc_id, n, h, unnest(range(0, n - {SPAN - 1}, {SPAN})) AS s FROM d)),
w AS (SELECT doc_id, s + o AS i, md5(substr(part, 2 * o + 1, {2 * SPAN})) AS k
  FROM (SELECT doc_id, s, part, unnest(range(0, least({SPAN}, n - {SPAN - 1} - s))) AS o FROM blocks)),
repeated AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
fresh AS (SELECT doc_id, i, coalesce(i > lag(i) OVER p + {SPAN}, true)::INT AS f FROM repeated WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {SPAN} AS b FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM fresh) GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER p, 0) AS before FROM spans WINDOW p AS (PARTITION BY doc_id ORDER BY a)),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
