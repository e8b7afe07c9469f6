"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of an item (all words of a shorter item). Its tokens are its word shingles, ordered by how
rare they are in all documents. A document that holds the whole window holds all its shingles, so the necessary prefix of that
order is one token: the rarest. Only occurrences of such tokens in documents are joined; the place of the token in the window
bounds where the window would start, the document's length bounds where it would end, and what is left is compared word by word.

Documents are read twice: once to count the benchmark's shingles, once to find the rarest of each window. Both passes look
words up in a bitmap of fixed size, made from the benchmark; it only spares rows that cannot join, so a benchmark too large for it
costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from packetloom.llm import textbytes
from packetloom.session import settled

WINDOW = 13
SHINGLE = 3
#: The bitmap of shingle hashes: 2 MB, whatever the benchmark.
BITS = 24
_BLOCK = 1 << 13


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, first word of each text, word hashes."""
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.word_bounds(low, offsets, textbytes.ALPHANUMERIC)
    return low, starts, ends, first, textbytes.span_hashes(low, starts, ends)


def _runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of its first word, hash) of every run of exactly ``n`` words within a text."""
    made, bounds = textbytes.shingles(hashes, first, n)
    long = np.repeat(np.diff(first) >= n, np.diff(bounds))
    text = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    at = first[text] + np.arange(len(made)) - bounds[text]
    return at[long], made[long]


def _spot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(words, length, item, tokens) of every distinct window of every item; tokens are (place, n, hash) of its shingles."""
    schema = "item string, words string, length int, tokens array<struct<place:int, n:int, hash:bigint>>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, value in zip(batch[key], batch[text], strict=True):
                for row, data, offsets in textbytes.slices(pa.array([value], pa.string())):
                    low, starts, ends, first, hashes = _words(data, offsets)
                    if not len(starts):
                        continue
                    length = min(window, len(starts))
                    n = min(SHINGLE, length)
                    _, made = _runs(hashes, first, n)
                    signed = made.view(np.int64).tolist()
                    words = [low[s:e].tobytes().decode("utf-8") for s, e in zip(starts, ends, strict=True)]
                    for i in range(len(words) - length + 1):
                        tokens = [(k, n, signed[i + k]) for k in range(length - n + 1)]
                        rows.append((item, " ".join(words[i : i + length]), length, tokens))
            yield pd.DataFrame(rows, columns=["item", "words", "length", "tokens"])

    named = items.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{text}`").alias(text)).where(F.col(key).isNotNull())
    return named.mapInPandas(cut, schema).dropDuplicates(["item", "words"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of all values of the column ``hash``; at most 2**BITS bits reach the driver, in blocks."""
    spot = F.shiftrightunsigned(F.col("hash"), 64 - BITS)
    blocks = hashes.select(spot.alias("spot")).distinct().select(F.floor(F.col("spot") / _BLOCK).cast("int").alias("block"), "spot")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_BLOCK, bool)
        bits[group["spot"].to_numpy() % _BLOCK] = True
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << BITS, bool)
    for row in blocks.groupBy("block").applyInPandas(fill, "block int, bits binary").toLocalIterator():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return np.packbits(out)


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = _spot(hashes)
    return (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


def _token_counts(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(hash, seen): how often each shingle that the bitmap knows stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in textbytes.slices(batch.column(0)):
                _, _, _, first, hashes = _words(data, offsets)
                for n in sizes:
                    _, made = _runs(hashes, first, n)
                    values, seen = np.unique(made[_known(bits.value, made)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(seen.astype(np.int64))], ["hash", "seen"])

    found = docs.select("body").mapInArrow(count, "hash bigint, seen bigint")
    return found.groupBy("hash").agg(F.sum("seen").alias("seen"))


def _occurrences(docs: DataFrame, window: int, sizes: list[int], bits) -> DataFrame:
    """One row with ``n_words`` and the carried columns per document, and one with the words around it per occurrence of a known shingle."""
    schema = f"row_id bigint, n_words bigint, at bigint, n int, hash bigint, low bigint, around string, doc {docs.schema['doc'].dataType.simpleString()}"
    names = ["row_id", "n_words", "at", "n", "hash", "low", "around", "doc"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, carried = batch.column(0), batch.column(2)
            for row, data, offsets in textbytes.slices(batch.column(1)):
                low, starts, ends, first, hashes = _words(data, offsets)
                count = np.diff(first)
                texts = len(count)
                none = pa.nulls(texts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, texts), pa.array(count.astype(np.int64)), none, pa.nulls(texts, pa.int32()), none, none, pa.nulls(texts, pa.string()), carried.slice(row, texts)],
                    names,
                )
                for n in sizes:
                    at, made = _runs(hashes, first, n)
                    known = _known(bits.value, made)
                    at, made = at[known], made[known]
                    for i in range(0, len(at), 4096):
                        part = at[i : i + 4096]
                        owner = np.searchsorted(first, part, "right") - 1
                        begin = np.maximum(part - (window - n), first[owner])
                        stop = np.minimum(part + window, first[owner + 1])
                        around = [
                            b" ".join([low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                            for a, b in zip(begin.tolist(), stop.tolist(), strict=True)
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(owner + row)), pa.array(count[owner].astype(np.int64)), pa.array((part - first[owner]).astype(np.int64)),
                                pa.array(np.full(len(part), n, np.int32)), pa.array(made[i : i + 4096].view(np.int64)),
                                pa.array((begin - first[owner]).astype(np.int64)), pa.array(around, pa.binary()).cast(pa.string()), pa.nulls(len(part), carried.type),
                            ],
                            names,
                        )

    return docs.select("row_id", "body", "doc").mapInArrow(find, schema)


def find_contamination(
    docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(row_id, doc, n_words, n_hit, items): for every row of ``docs`` its words, the words inside any occurrence of an item's
    window, and the sorted texts of the keys of those items. ``doc`` holds the columns named in ``carry``.

    Null and empty texts have no words; items without words or key match nothing; repeated documents are judged one by one, also
    under one key; repeated items count once per key; an empty table of either kind gives no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    textbytes.bounded_batches(spark)
    docs = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(f"`{text}`").alias("body"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")
    )
    windows = settled(item_windows(items, item_key, item_text, window))
    tokens = windows.select(F.explode("tokens").alias("t")).select("t.n", "t.hash")
    sizes = sorted(r["n"] for r in tokens.select("n").distinct().collect())
    counts = _token_counts(docs, sizes, spark.sparkContext.broadcast(_bitmap(tokens)))
    # The rarest shingle of each window, ties by place.
    distinct = windows.groupBy("words", "length").agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("tokens").alias("tokens"))
    ranked = distinct.select("words", "length", "items", F.explode("tokens").alias("t")).select("words", "length", "items", "t.*")
    ranked = ranked.join(counts, "hash", "left").groupBy("words").agg(
        F.first("length").alias("length"), F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "n", "hash")).alias("rarest"),
    )
    keyed = settled(ranked.select("words", "length", "items", "rarest.place", "rarest.n", "rarest.hash"))
    found = settled(_occurrences(docs, window, sizes, spark.sparkContext.broadcast(_bitmap(keyed.select("hash")))))

    places = found.where(F.col("hash").isNotNull())
    begin = F.col("at") - F.col("place")
    joined = places.join(keyed, ["hash", "n"]).where((begin >= F.col("low")) & (begin + F.col("length") <= F.col("n_words")))
    part = F.slice(F.split("around", " "), (begin - F.col("low") + 1).cast("int"), F.col("length"))
    occurs = joined.where(F.array_join(part, " ") == F.col("words")).select("row_id", begin.alias("begin"), (begin + F.col("length")).alias("stop"), "items")
    spans = occurs.groupBy("row_id", "begin").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("row_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    hit = spans.select("row_id", F.greatest(F.lit(0), F.col("stop") - F.greatest("begin", reached)).alias("hit"))
    hit = hit.groupBy("row_id").agg(F.sum("hit").alias("n_hit"))
    named = occurs.select("row_id", F.explode("items").alias("item")).groupBy("row_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    all_rows = found.where(F.col("hash").isNull()).select("row_id", "doc", "n_words")
    return all_rows.join(hit.join(named, "row_id"), "row_id", "left").select(
        "row_id", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated() -> F.Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op2_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_contamination(docs, items, carry=["doc_id"]).select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM wins))),
occurs AS (SELECT doc_id, p, n, item_id FROM places JOIN wins USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occurs) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurs) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
