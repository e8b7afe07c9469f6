"""Placement of rows on shards by a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own order of preference over the slots of a prime-sized table: ``(offset + j * skip) mod size``. Shards take
turns; each turn claims the shard's next free slot, until no slot is free. A row's key is hashed to a slot, and the table, whose
size is a parameter and does not depend on the data, is broadcast: placing a row is one look-up, without a shuffle, and a hot key
costs nothing extra. Taking a shard away moves its own slots and only few others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = 32
TABLE_SIZE = 4099
#: Rows of a table that may be broadcast.
LARGEST_TABLE = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its index in ``shards``) of each slot. ``size`` must be prime and not below the number of shards."""
    if size > LARGEST_TABLE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table size must be a prime up to {LARGEST_TABLE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    offset = [_number(f"offset {name}") % size for name in shards]
    skip = [_number(f"skip {name}") % (size - 1) + 1 for name in shards]
    turn, table, filled = [0] * len(shards), [-1] * size, 0
    while True:
        for shard in range(len(shards)):
            slot = (offset[shard] + turn[shard] * skip[shard]) % size
            while table[slot] >= 0:
                turn[shard] += 1
                slot = (offset[shard] + turn[shard] * skip[shard]) % size
            table[slot] = shard
            turn[shard] += 1
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key, from the first 60 bits of the MD5 of its text. Null is keyed like the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(size))


def _slots(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    filled = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("_slot", "_shard")).select(
        F.col("_slot").cast("bigint").alias("_slot"), F.col("_shard").cast("int").alias("_shard")
    )


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Every row with its ``slot`` (long) and ``shard`` (int, the index in ``shards``).

    Null keys share the slot of the empty text; equal keys share theirs; an empty table stays empty. Further columns are kept;
    those named like the two results are replaced.
    """
    hashed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (slot, shard)], slot_of(F.col(f"`{key}`"), size).alias("_slot_of_key"))
    table = F.broadcast(_slots(df.sparkSession, shards, size))
    return hashed.join(table, hashed["_slot_of_key"] == table["_slot"], "left").select(
        *[hashed[f"`{c}`"] for c in hashed.columns[:-1]], F.col("_slot_of_key").alias(slot), F.col("_shard").alias(shard)
    )


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard. A shard is dealt to several writers by a salt, so that a hot shard is not one task's work."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files_per_shard))
    placed.withColumn("_salt", salt).repartition(F.col(shard), F.col("_salt")).drop("_salt").write.partitionBy(shard).parquet(path)


#: The same placement in DuckDB: one recursion step per claimed slot.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5('offset shard-' || i), 1, 15) AS BIGINT) % {TABLE_SIZE} AS o,
    CAST('0x' || substr(md5('skip shard-' || i), 1, 15) AS BIGINT) % {TABLE_SIZE - 1} + 1 AS s
  FROM range({SHARDS}) AS r(i)
), orders AS (
  SELECT i, [(o + j * s) % {TABLE_SIZE} FOR j IN range({TABLE_SIZE})] AS prefs FROM shards
), claims(step, shard, slot, free) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), [true FOR k IN range({TABLE_SIZE})]
  UNION ALL
  SELECT step, i, slot, list_concat(list_concat(free[1:slot], [false]), free[slot + 2:]) FROM (
    SELECT c.step + 1 AS step, o.i AS i, c.free AS free, list_filter(o.prefs, lambda p: c.free[p + 1])[1] AS slot
    FROM claims c JOIN orders o ON o.i = (c.step + 1) % {SHARDS} WHERE c.step + 1 < {TABLE_SIZE})
)
SELECT doc_id, h AS slot, CAST(c.shard AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS h FROM documents) d
JOIN (SELECT shard, slot FROM claims WHERE step >= 0) c ON c.slot = d.h
"""


def op4_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot long, shard int: every document placed on 32 shards through a table of 4 099 slots."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(documents, "doc_id", [f"shard-{i}" for i in range(SHARDS)])
