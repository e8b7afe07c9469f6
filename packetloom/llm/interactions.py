"""Audit of how filters interact: what each one removes in every order, and its Shapley share, by counting paths forward and backward.

The states are the subsets of filters that have been applied; an edge adds one filter. A document that fails the filters of ``mask`` is removed
on the edge (S, f) if f is in the mask and nothing of S is. So documents are only counted by (part, mask), each edge is weighed once,
and all orders are read from the same edges: an order is a path, its k-th step the edge that it takes there. Of all orders,
``forward[S] * backward[S + f]`` take an edge: the paths that reach S times the paths that leave S + f.

One pass reads the texts and keeps their digests; what is shuffled is as wide as a digest and a few numbers. Copies are counted before the
shuffle, so a text with very many copies is a few rows wherever it goes.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.session import settled

#: White space between words.
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
LETTERS = "ABCDE"
#: More filters than that have too many orders to list.
MOST = 7


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For every subset (by its bits) of so many filters: the paths from the empty set to it, and from it to the full set."""
    full = (1 << filters) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(filters) if state >> f & 1)
    for state in reversed(range(full)):
        backward[state] = sum(backward[state | 1 << f] for f in range(filters) if not state >> f & 1)
    return forward, backward


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions A to D on a text that is not null."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(5) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, bit 0 for A to bit 4 for E, and those labelled good or toxic.

    Null texts and parts are empty. A row fails E if a row with a smaller key has the same text (its SHA-256); a null key is greater than any
    other, and rows of one key are not smaller than each other, so repeated rows fail E together or not at all. A key that is labelled
    twice is good or toxic if any of its labels says so; rows without a key have no label.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("body"))
    failed = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("body")).values())]
    rows = read.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), sum(failed[1:], failed[0]).alias("mask"))
    # Rows without a key match no label, so they may go anywhere.
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")))
    flags = [F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.select(F.col(f"`{key}`").cast("bigint").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(*flags)
    named = rows.join(marked.withColumn("salt", F.lit(0).cast("bigint")), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    kinds = ["digest", "mask", "part", "good", "toxic"]
    each = named.groupBy("id", "salt", *kinds).agg(F.count("*").alias("n"))
    # Rows of a null key are several where they differ in nothing but the salt's digest, which is a kind.
    group = each.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least"))
    first = F.min(F.struct("least.none", "least.id")).over(Window.partitionBy("digest"))
    fresh = F.when(F.struct("least.none", "least.id").eqNullSafe(F.col("first")), F.col("least.n")).otherwise(F.lit(0))
    split = group.withColumn("first", first).withColumn("fresh", fresh)
    copied = F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), copied)).alias("as"))
    return both.groupBy("part", "as.mask").agg(
        F.sum("as.n").alias("n"), F.sum(F.col("as.n") * F.col("good")).alias("good"), F.sum(F.col("as.n") * F.col("toxic")).alias("toxic")
    )


def interactions(counts: DataFrame, letters: Iterable[str] = LETTERS) -> DataFrame:
    """Every step of every order for each part of ``counts`` (part, mask, n, good, toxic), with zeros. No rows make none.

    ``letters`` names the filter of each bit, at most MOST of them: an order is a row for each step, so their number bounds the output.
    """
    letters = list(letters)
    if len(letters) > MOST:
        raise ValueError(f"at most {MOST} filters, as all their orders are listed")
    forward, backward = path_counts(len(letters))
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << len(letters)) for f in range(len(letters)) if not s >> f & 1]
    listed = F.expr("array(" + ", ".join(f"named_struct('state', {s}, 'filter', {f}, 'orders', {w}L)" for s, f, w in edges) + ")")
    row = counts.select("part", "mask", "n", "good", "toxic", F.explode(listed).alias("edge")).select("*", "edge.*")
    early = F.expr("mask & state") != 0
    fails = F.expr("shiftright(mask, filter) & 1") == 1
    here = ~early & fails
    total = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0)))
    weighed = row.groupBy("part", "state", "filter", "orders").agg(
        total(~early & ~fails).alias("kept"), total(here).alias("removed"), total(early & fails).alias("redundant"),
        total(F.col("mask") == F.expr("shiftleft(1, filter)")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    weighed = weighed.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))
    steps = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(letters[i] for i in order), step, state, f))
            state |= 1 << f
    steps = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    # There are as many steps as orders have, whatever the data.
    return weighed.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of the 120 orders of five filters, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(settled(failure_counts(docs, labels)))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
m AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, doc_id > first AS e FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
k AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n,
  coalesce(sum(good), 0) AS good, coalesce(sum(l.toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(step)),
out AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM k, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM out
"""
