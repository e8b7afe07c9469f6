"""Near duplicates by MinHash with sequential Bayesian verification, and their components.

1. One pass turns each whole text into its set of word shingles, a fingerprint of the set, MinHash bands and a sketch (one byte per
   permutation). Equal sets become one representative, its smallest key.
2. In each band's bucket, members are paired with the smallest one only. Of a candidate pair, sketches are compared batch by batch; it is dropped
   as soon as the posterior probability that the similarity reaches the threshold falls below ``MISS``. Survivors are verified on their
   full sets.
3. The links' components are found. In buckets that still hold several, the most central member is paired with the others as well, which
   settles groups made from one text. What then still holds several components is searched exhaustively between them, in chunks, so no
   link that shares a bucket is lost and groups of copies never become all pairs.

Bands are as many as a pair at the threshold needs to share one with probability ``1 - MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm import textbytes
from packetloom.llm.bitmap import bitmap, known
from packetloom.llm.components import connected_components
from packetloom.llm.groups import fixed_width, paired_chunks, pairs_within, together, whole_groups
from packetloom.session import settled

#: Shingles of words, similarity in hundredths: what stages use unless a contract says otherwise.
WORDS = 5
SIMILARITY = 80
ROWS = 5
MISS = 1e-6
#: Sketch bytes compared at a time.
BATCH = 24


def bands_for(similarity: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that a pair at the threshold shares none of with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (similarity / 100) ** rows))


#: What was computed once. A cache of functools would send the name of its function to the executors, which need not know this package.
_LEAST: dict[tuple[int, int, float], list[tuple[int, int]]] = {}


def least_matches(permutations: int, similarity: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(bytes compared, matches needed) after each batch. The prior of the similarity is uniform; a byte also matches by chance."""
    if (permutations, similarity, miss) in _LEAST:
        return _LEAST[permutations, similarity, miss]
    grid = np.linspace(0, 1, 2001)[1:-1]
    match = grid + (1 - grid) / 256
    high = grid >= similarity / 100
    out = []
    for n in sorted({*range(BATCH, permutations, BATCH), permutations}):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= miss * weight.sum():
                out.append((n, m))
                break
    _LEAST[permutations, similarity, miss] = out
    return out


def plausible(left: np.ndarray, right: np.ndarray, similarity: int) -> np.ndarray:
    """Which rows of two sketch matrices stay above the posterior bound through all batches."""
    alive = np.arange(len(left))
    seen = np.zeros(len(left), np.int64)
    at = 0
    for n, needed in least_matches(left.shape[1], similarity):
        seen = seen + (left[alive, at:n] == right[alive, at:n]).sum(1)
        keep = seen >= needed
        alive, seen, at = alive[keep], seen[keep], n
    return alive


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.word_bounds(low, offsets, textbytes.BLANK_SEPARATED)
    made, bounds = textbytes.shingles(textbytes.span_hashes(low, starts, ends), first, words)
    parts = [np.unique(made[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)])


_SIGNATURE = "key bigint, n bigint, f1 bigint, f2 bigint, sketch binary, bands array<bigint>"


def signatures(docs: DataFrame, key: str, text: str, words: int, similarity: int) -> DataFrame:
    """(key, n, f1, f2, sketch, bands) of every row; texts without words have no sketch and no bands."""
    bands = bands_for(similarity)
    count = bands * ROWS
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in textbytes.slices(batch.column(1)):
                made, bounds = _sets(data, offsets, words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                least = np.zeros((len(full), count), np.uint32)
                if len(full):
                    at = bounds[full]
                    f1[full] = np.add.reduceat(textbytes.mix(made + np.uint64(11)), at)
                    f2[full] = np.bitwise_xor.reduceat(textbytes.mix(made ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(count):
                        value = ((made * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32)
                        least[:, k] = np.minimum.reduceat(value, at)
                codes = np.empty((len(full), bands), np.uint64)
                for b in range(bands):
                    total = np.full(len(full), np.uint64((b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        total = textbytes.mix(total + least[:, k].astype(np.uint64))
                    codes[:, b] = total
                flat = (least & np.uint32(255)).astype(np.uint8)
                has = sizes > 0
                rank = np.cumsum(has) - 1
                sketch = [flat[r].tobytes() if h else None for r, h in zip(rank, has, strict=True)]
                ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                        pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel().view(np.int64))),
                    ],
                    ["key", "n", "f1", "f2", "sketch", "bands"],
                )

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(sign, _SIGNATURE)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave the threshold possible."""
    side = lambda name: sketches.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(2)[0].as_py())
            left, right = (fixed_width(batch.column(k), np.uint8, width) for k in (2, 3))
            alive = pa.array(plausible(left, right, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], ["a", "b"])

    return met.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a bigint, b bigint")


def _full_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the documents named in ``wanted``; a bitmap keeps most others from being turned into sets."""
    scrambled = F.xxhash64("key")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(scrambled.alias("hash"))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.flatnonzero(known(bits.value, batch.column(2).to_numpy().view(np.uint64)))
            chosen = batch.take(pa.array(mine))
            for row, data, offsets in textbytes.slices(chosen.column(1)):
                made, bounds = _sets(data, offsets, words)
                rows = [made[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(row, len(rows)), pa.array(rows, pa.binary())], ["key", "shingles"])

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL")
    made = source.select("key", "text", scrambled.alias("hash")).mapInArrow(make, "key bigint, shingles binary")
    return made.join(wanted, "key", "left_semi").dropDuplicates(["key", "shingles"])


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, similarity: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity on their full sets."""
    pairs = settled(pairs)
    wanted = settled(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    sets = settled(_full_sets(docs, key, text, words, wanted))
    met = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                place = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                shared = int((x[place] == y).sum()) if len(x) else 0
                if 100 * shared >= similarity * (len(x) + len(y) - shared):
                    good.append(i)
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    return settled(met.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))


def _cross_pairs(table: pa.Table, bounds: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of a bucket with different components and plausible sketches, in the first bucket that the two share."""
    width = bands_for(similarity)
    bucket, component, n, side, left, right = (table.column(c).to_numpy() for c in ("bucket", "component", "n", "side", "left", "right"))
    sketch = fixed_width(table.column("sketch"), np.uint8, width * ROWS)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, width)
    for i, j in pairs_within(bounds, limit=1 << 16):
        keep = (component[i] != component[j]) & ((left[i] == right[i]) | (side[i] != side[j]))
        keep &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * similarity
        i, j = i[keep], j[keep]
        alive = plausible(sketch[i], sketch[j], similarity)
        i, j = i[alive], j[alive]
        first = bands[i, (bands[i] == bands[j]).argmax(1)] == bucket[i]
        yield i[first], j[first]


_CHUNK_KEYS = ["bucket", "left", "right"]


def _by_key(members: DataFrame) -> DataFrame:
    """(key, component, buckets): of each member, its buckets that hold several components. ``members``: bucket, pivot, key, component."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("_n"))
    mixed = mixed.where("low <> high AND _n > 2").select("bucket")
    # Pairs with the pivot are known already.
    rows = members.where("key <> pivot").join(mixed, "bucket", "left_semi")
    return rows.groupBy("key", "component").agg(F.collect_set("bucket").alias("buckets"))


def _central_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's most central member with its members in other components.

    Central is who stands in the most buckets of several components: the text that a group's copies were made from shares bands with
    all of them, while each copy has bands of its own.
    """
    rows = settled(_by_key(members).select("key", "component", F.size("buckets").alias("weight"), F.explode("buckets").alias("bucket")))
    central = rows.groupBy("bucket").agg(F.max(F.struct("weight", F.bitwise_not("key").alias("flipped"), F.col("component").alias("own"))).alias("c"))
    met = rows.join(central, "bucket").where("component <> c.own")
    center = F.bitwise_not("c.flipped")
    return met.select(F.least("key", center).alias("a"), F.greatest("key", center).alias("b")).distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, component) with further links between nodes; only components are linked anew."""
    for end in ("a", "b"):
        links = links.join(found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    edges = links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = settled(connected_components(edges))
    moved = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("_over")), "component", "left")
    moved = moved.select("node", F.coalesce("_over", "component").alias("component"))
    return moved.union(over.join(found, "node", "left_anti").select("node", "component"))


def _mixed_members(members: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """Members of buckets of several components that have a plausible partner in another one. ``members``: bucket, pivot, key, component."""
    # Sketches meet each key once, not once a bucket.
    rows = _by_key(members).join(sketches, "key").withColumn("bucket", F.explode("buckets")).drop("buckets")
    chunks = together(paired_chunks(rows, ["bucket"], "key", apart="component"), _CHUNK_KEYS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _CHUNK_KEYS, 4096):
            wanted = np.zeros(table.num_rows, bool)
            for i, j in _cross_pairs(table, bounds, similarity):
                wanted[i] = wanted[j] = True
            at = pa.array(np.flatnonzero(wanted))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(at) for c in ("bucket", "key", "component")], ["bucket", "key", "component"])

    return chunks.mapInArrow(search, "bucket bigint, key bigint, component bigint").distinct()


def _cross_links(mixed: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between components, verified on full sets where the members meet; one per pair of components and chunk."""
    by_key = mixed.groupBy("key", "component").agg(F.collect_set("bucket").alias("buckets"))
    rows = by_key.join(sketches, "key").join(sets, "key").withColumn("bucket", F.explode("buckets")).drop("buckets")
    # Full sets are wide, so their chunks are small.
    chunks = together(paired_chunks(rows, ["bucket"], "key", 256, apart="component"), _CHUNK_KEYS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _CHUNK_KEYS, 256):
            key, component = table.column("key").to_numpy(), table.column("component").to_numpy()
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            names, number = np.unique(np.concatenate(parts), return_inverse=True)
            ends = np.cumsum(sizes)
            mine = np.zeros(len(names), np.int64)
            linked: dict[tuple[int, int], tuple[int, int]] = {}
            for left, right in _cross_pairs(table, bounds, similarity):
                for i in np.unique(left).tolist():
                    js = right[left == i]
                    mine[number[ends[i] - sizes[i] : ends[i]]] = 1
                    for j in js.tolist():
                        pair = (min(component[i], component[j]), max(component[i], component[j]))
                        if pair not in linked:
                            shared = int(mine[number[ends[j] - sizes[j] : ends[j]]].sum())
                            if 100 * shared >= similarity * (sizes[i] + sizes[j] - shared):
                                linked[pair] = (key[i], key[j])
                    mine[number[ends[i] - sizes[i] : ends[i]]] = 0
            pairs = np.array(list(linked.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    return chunks.mapInArrow(search, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component, kept) of every row of ``docs``, under the integer column ``key``.

    ``component`` is the smallest key reachable by links, ``kept`` whether that is the row's own. Null and empty texts, and texts
    of blanks, have no shingles, link with nothing and are kept. Rows without a key link with nothing, have no component and are
    kept. Rows that share a key are one node of the graph. Texts of fewer words than a shingle are one shingle. An
    empty table stays empty; other columns are not read.
    """
    textbytes.bounded_batches(docs.sparkSession)
    signed = settled(signatures(docs, key, text, words, similarity))
    named = signed.where("n > 0 AND key IS NOT NULL")
    sets = settled(named.groupBy("f1", "f2", "n").agg(F.min("key").alias("leader")))
    # Repeated rows of a key count once; different texts under one key stay.
    led = named.join(sets.select(F.col("leader").alias("key")).distinct(), "key", "left_semi").groupBy("key", "f1", "f2", "n")
    leaders = settled(led.agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")).select("key", "n", "sketch", "bands"))

    spread = leaders.select("key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).where("pivot <> last")
    members = settled(spread.join(shared.select("bucket", "pivot"), "bucket"))
    stars = members.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(_likely(stars, leaders, similarity), docs, key, text, words, similarity)
    found = settled(connected_components(links))

    def placed() -> DataFrame:
        return members.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))

    central = _verified(_likely(_central_pairs(placed()), leaders, similarity), docs, key, text, words, similarity)
    found = settled(_merged(found, central))
    mixed = settled(_mixed_members(placed(), leaders, similarity))
    if not mixed.isEmpty():
        sets_of = settled(_full_sets(docs, key, text, words, settled(mixed.select("key").distinct())))
        more = settled(_cross_links(mixed, leaders, sets_of, similarity))
        found = settled(_merged(found, more))
    class_of = sets.join(found.withColumnRenamed("node", "leader"), "leader", "left").select("f1", "f2", "n", F.coalesce("component", "leader").alias("component"))
    out = signed.select("key", "n", "f1", "f2").join(class_of, ["f1", "f2", "n"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select("key", F.col("n").alias("n_shingles"), component.alias("component"), (F.col("key").isNull() | (component == F.col("key"))).alias("kept"))


def op7_sequential_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: three words, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=3, similarity=85).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
