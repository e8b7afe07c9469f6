"""Divergence of sources from each other and from their language, term by term, with strings joined late.

1. One pass counts the terms of each task's texts by (language, source) and writes them with their strings to the shared folder. Nothing is
   shuffled there.
2. Of that table, only fixed-width columns are read and shuffled: ids of language and source, a 64-bit digest of the term, its counts.
   They say which digests are kept.
3. For kept digests the smallest and the largest string are taken. Where these differ, two terms collided; such digests are split by their
   strings and counted again. A collision can only raise a count, so no term is lost before.
4. All numbers are worked out on digests. Terms get their string back where it is the smallest and the largest one, and only those whose
   value can be among the first ranks.

Pairs of sources: terms that only one of two sources has differ from the other's least share, which is the same for all of them, so
they are counted by their number of occurrences, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.llm import textbytes
from packetloom.llm.bitmap import bitmap, known
from packetloom.session import settled

#: Documents of a language that a kept term needs, and ranks of terms that are returned.
LEAST = 3
TOP = 200
#: (source, term) entries that a task holds before it writes them.
HELD = 1_500_000
#: Letters a-z (after lower-casing) and bytes from 0x80 up.
_TERM = np.zeros(256, bool)
_TERM[97:123] = _TERM[128:] = True

_COUNTED = "flush bigint, lid bigint, gid bigint, digest bigint, n bigint, df bigint, term string"


class _Entries:
    """Counts of terms by source, summed up over some slices of one task; strings are known by their place in a dictionary."""

    def __init__(self) -> None:
        self.names: list[pa.Array] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, lids: np.ndarray, gids: np.ndarray) -> None:
        low = textbytes.LOWER[data]
        starts, ends, first = textbytes.word_bounds(low, offsets, _TERM)
        if not len(starts):
            return
        # The bytes of the terms, one after another, are an Arrow column already.
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        names = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[_TERM[low]])).dictionary_encode()
        size = len(names.dictionary)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        pair, n = np.unique(text * size + names.indices.to_numpy(), return_counts=True)
        text, code = pair // size, pair % size
        self.names.append(names.dictionary)
        self.parts.append(np.stack([lids[text], gids[text], code, n, np.ones(len(n), np.int64)]))
        self.size += len(n)

    def rows(self, flush: int, bits: int) -> Iterator[pa.RecordBatch]:
        """(flush, lid, gid, digest, n, df, term) of each source and term; the string is there once per language, or always if its digest is
        that of another one too."""
        if not self.parts:
            return
        # Equal strings of several slices get one place.
        whole = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(np.arange(len(x))), x) for x in self.names]).unify_dictionaries()
        names = whole.chunk(0).dictionary
        codes = [chunk.indices.to_numpy().astype(np.int64)[part[2]] for chunk, part in zip(whole.chunks, self.parts, strict=True)]
        lid, gid, _, n, df = np.concatenate(self.parts, 1)
        groups, group = np.unique(gid, return_inverse=True)
        of = np.zeros(len(groups), np.int64)
        of[group] = lid
        key, inverse = np.unique(np.concatenate(codes) * len(groups) + group, return_inverse=True)
        code, group = key // len(groups), key % len(groups)
        n, df = (np.bincount(inverse, x).astype(np.int64) for x in (n, df))
        lid = of[group]
        digests = _digests(names, bits)
        _, place, seen = np.unique(digests, return_inverse=True, return_counts=True)
        digest, shared = digests[code], (seen[place] > 1)[code]
        # Rows come by term; the first of each language carries it.
        order = np.lexsort((lid, code))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (lid[order][1:] != lid[order][:-1])
        fresh |= shared[order]
        for i in range(0, len(order), 1 << 15):
            at = order[i : i + (1 << 15)]
            term = names.take(pa.array(code[at], mask=~fresh[i : i + (1 << 15)])).cast(pa.string())
            columns = [pa.array(x[at]) for x in (np.full(len(lid), flush), lid, groups[group], digest, n, df)]
            yield pa.RecordBatch.from_arrays([*columns, term], ["flush", "lid", "gid", "digest", "n", "df", "term"])


def _digests(terms: pa.Array, bits: int) -> np.ndarray:
    terms = terms.cast(pa.large_binary())
    at = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    found = textbytes.span_hashes(np.frombuffer(terms.buffers()[2], np.uint8), at[:-1], at[1:])
    return (found >> np.uint64(64 - bits)).view(np.int64)


def counted_terms(docs: DataFrame, bits: int = 64, held: int = HELD) -> DataFrame:
    """(flush, lid, gid, digest, n, df, term) of ``docs`` (body, lid, gid): occurrences and documents, summed up within each task, about
    ``held`` entries at a time; ``term`` is null where another row with the same flush, lid and digest has the only string."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 32
        entries = _Entries()
        for batch in batches:
            lids, gids = (batch.column(k).to_numpy() for k in (1, 2))
            for row, data, offsets in textbytes.slices(batch.column(0)):
                entries.add(data, offsets, lids[row:], gids[row:])
                if entries.size > held:
                    yield from entries.rows(flush, bits)
                    flush += 1
                    entries = _Entries()
        yield from entries.rows(flush, bits)

    return docs.select("body", "lid", "gid").mapInArrow(count, _COUNTED)


def _groups(read: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(lang, source, lid, gid) of all sources, and the ids as columns: hashes with a seed under which no two of them collide."""
    named = settled(read.select("lang", "source").distinct())
    for seed in range(100):
        lid, gid = F.xxhash64("lang", F.lit(seed)), F.xxhash64("lang", "source", F.lit(seed))
        sizes = named.agg(F.count("*"), F.countDistinct(gid), F.countDistinct("lang"), F.countDistinct(lid)).first()
        if sizes[0] == sizes[1] and sizes[2] == sizes[3]:
            return named.select("lang", "source", lid.alias("lid"), gid.alias("gid")), lid, gid
    raise RuntimeError("no seed keeps the sources apart")


_KEPT = ["lid", "gid", "digest", "split", "n", "all_n", "leads"]


def _enough(rows: DataFrame, term: list[str], least: int) -> DataFrame:
    """Rows (term, gid, n, df) of terms in ``least`` documents or more, with the term's occurrences; one row of each leads it."""
    same = Window.partitionBy(*term)
    found = rows.withColumns({"all_n": F.sum("n").over(same), "all_df": F.sum("df").over(same), "leads": (F.col("gid") == F.min("gid").over(same)).cast("int")})
    return found.where(F.col("all_df") >= least).drop("df", "all_df")


def kept_terms(written: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lid, gid, digest, split, n, all_n, leads) of kept terms, (lid, digest, lo) strings of digests that have one only).

    ``split`` is null, or the term itself where its digest is shared.
    """
    term = ["lid", "digest"]
    # Tasks have summed up their terms, so no term has more rows than there are sources and tasks.
    summed = written.select("lid", "gid", "digest", "n", "df").repartition(*term).groupBy("lid", "gid", "digest").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = settled(_enough(summed, term, least))
    likely = counts.where("leads = 1").select(F.xxhash64(*term).alias("hash"))
    bits = written.sparkSession.sparkContext.broadcast(bitmap(likely))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.flatnonzero(known(bits.value, batch.column(3).to_numpy().view(np.uint64)))
            yield batch.select([0, 1, 2]).take(pa.array(mine))

    # The bitmap keeps most strings of rare terms out of the shuffle; the few others do no harm.
    strings = written.where("term IS NOT NULL").select(*term, "term", F.xxhash64(*term).alias("hash"))
    strings = strings.mapInArrow(wanted, "lid bigint, digest bigint, term string")
    bounds = settled(strings.groupBy(*term).agg(F.min("term").alias("lo"), F.max("term").alias("hi")))
    clash = bounds.where("lo <> hi").select(*term)
    single = bounds.where("lo = hi").select(*term, "lo")
    alone = counts.withColumn("split", F.lit(None).cast("string")).select(*_KEPT)
    if clash.isEmpty():
        return alone, single
    return alone.join(clash, term, "left_anti").select(*_KEPT).union(_split(written, clash, least)), single


def _split(written: DataFrame, clash: DataFrame, least: int) -> DataFrame:
    """The kept terms among those that share their digest with another one, counted by their strings."""
    place = ["flush", "lid", "digest"]
    rows = written.join(clash, ["lid", "digest"], "left_semi")
    with_string = rows.where("term IS NOT NULL").select(*place, "gid", "n", "df", "term")
    others = rows.where("term IS NULL").select(*place, "gid", "n", "df").join(with_string.select(*place, "term"), place)
    again = with_string.union(others.select(*place, "gid", "n", "df", "term"))
    again = again.groupBy("lid", "gid", "digest", F.col("term").alias("split")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return _enough(again, ["lid", "split"], least).select(*_KEPT)


def _share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + terms)), exact at any size."""
    up = (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    whole = F.call_function("div", up.cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)"), (F.col(total) + F.col(terms)).cast("decimal(20,0)"))
    return F.when(F.col(terms) > 0, whole + 1)


def _excess(p: str, q: str) -> Column:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, bits: int = 64
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part ``pair`` has a row for each other source of the language; part ``term`` has the terms that the source uses more than its language,
    up to rank ``top``. Null texts, languages and sources are empty; each row is a document, so repeated rows count each time. Ties
    are broken by the UTF-8 bytes of the item. A language without kept terms has pairs of value 0 and no terms; one source has no
    pairs; an empty table stays empty. Other columns are not read. ``bits`` of the digests are used; fewer only make collisions likely.
    """
    textbytes.bounded_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    read = docs.select(blank(text).alias("body"), blank(lang).alias("lang"), blank(source).alias("source"))
    named, lid, gid = _groups(read)
    written = settled(counted_terms(read.select("body", lid.alias("lid"), gid.alias("gid")), bits))
    kept, single = kept_terms(written, least)
    term = ["lid", "digest", "split"]

    of_group = settled(kept.groupBy("lid", "gid").agg(F.count("*").alias("terms"), F.sum("n").alias("size"), F.sum("leads").alias("leads")))
    of_lang = of_group.groupBy("lid").agg(F.sum("leads").alias("v"), F.sum("size").alias("total"))
    groups = named.join(of_lang, "lid", "left").join(of_group.drop("lid", "leads"), "gid", "left").fillna(0, ["v", "total", "terms", "size"])
    groups = settled(groups.withColumn("p0", _share(F.lit(0), "size", "v")))

    shares = kept.join(groups.select("gid", "v", "size", "total", "p0"), "gid").withColumns({"p": _share("n", "size", "v"), "q": _share("all_n", "total", "v")})
    shares = settled(shares.select(*term, "gid", "n", "p", "p0", "q"))

    # Terms: the first ranks and all that tie with the last of them, before any string is there.
    ahead = shares.where("p > q").select("lid", "digest", "split", "gid", _excess("p", "q").alias("value"))
    ahead = ahead.withColumn("place", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("place") <= top)
    texts = ahead.join(single, ["lid", "digest"], "left").select("gid", F.coalesce("split", "lo").alias("item"), "value")
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    terms = texts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    terms = terms.join(named, "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # Pairs: what both have, one by one; what only one has, by the number of occurrences.
    side = lambda x: groups.select("lid", *[F.col(c).alias(f"{c}_{x}") for c in ("gid", "source", "p0", "terms", "v")])
    pairs = settled(side("a").join(side("b").drop("v_b"), "lid").where("gid_a <> gid_b"))
    spread = settled(shares.groupBy("gid", "n", "p").agg(F.count("*").alias("m")))
    mine = pairs.select("gid_a", "gid_b", "p0_b").join(spread.select(F.col("gid").alias("gid_a"), "p", "m"), "gid_a")
    mine = mine.select("gid_a", "gid_b", (F.col("m") * _excess("p", "p0_b")).alias("part"))
    other = pairs.select("gid_a", "gid_b", "p0_a").join(spread.select(F.col("gid").alias("gid_b"), "p", "m"), "gid_b")
    other = other.select("gid_a", "gid_b", (F.col("m") * _excess("p0_a", "p")).alias("part"))
    x = shares.select(*term, *[F.col(c).alias(f"{c}_a") for c in ("gid", "p", "p0")])
    y = shares.select(*[F.col(c).alias(f"{c}_y") for c in term], *[F.col(c).alias(f"{c}_b") for c in ("gid", "p", "p0")])
    same = (F.col("lid") == F.col("lid_y")) & (F.col("digest") == F.col("digest_y")) & F.col("split").eqNullSafe(F.col("split_y"))
    both = x.join(y, same & (F.col("gid_a") != F.col("gid_b"))).select(
        "gid_a", "gid_b", (_excess("p_a", "p_b") - _excess("p_a", "p0_b") - _excess("p0_a", "p_b") + _excess("p0_a", "p0_b")).alias("part")
    )
    summed = mine.union(other).union(both).groupBy("gid_a", "gid_b").agg(F.sum("part").alias("part"))
    rest = (F.col("v_a") - F.col("terms_a") - F.col("terms_b")) * _excess("p0_a", "p0_b")
    valued = pairs.join(summed, ["gid_a", "gid_b"], "left").select(
        F.col("gid_a").alias("gid"), F.col("source_b").alias("item"), (F.coalesce("part", F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value")
    )
    pair = valued.withColumn("rank", F.row_number().over(order)).join(named, "gid").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pair.union(terms)


def op13_late_string_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of all sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    return source_divergence(docs)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.size, 0) + l.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
parts AS (SELECT *, 'term' AS part FROM terms UNION ALL SELECT *, 'pair' AS part FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
