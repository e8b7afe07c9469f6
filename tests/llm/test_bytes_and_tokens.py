"""Helpers and operators that need no join: words, tokens, sharding."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import parsing, sharding, textbytes, tokencount

TEXTS = ["Ab c", None, "", "  \n", "über x y", "a" * 50, "One, two; THREE 4", "x\ty\rz"]


def test_words_and_hashes_equal_the_plain_way():
    for _, data, offsets in textbytes.slices(pa.array(TEXTS, pa.string()), limit=20):
        low = textbytes.LOWER[data]
        starts, ends, first = textbytes.word_bounds(low, offsets, textbytes.BLANK_SEPARATED)
        got = [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        plain = [low[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [w for t in plain for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
        assert np.diff(first).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in plain]


def test_span_hashes_depend_on_content_only():
    data = np.frombuffer(b"abc abd abc" * 3, np.uint8)
    starts = np.array([0, 4, 8, 11, 15])
    hashes = textbytes.span_hashes(data, starts, starts + 3)
    assert hashes[0] == hashes[2] == hashes[3] and hashes[1] == hashes[4] != hashes[0]


def test_triggers_are_the_same_in_equal_spans():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 4, 260, dtype=np.uint8)
    found = []
    for lead in (0, 17, 333):
        data = np.concatenate([rng.integers(0, 4, lead, dtype=np.uint8), common, rng.integers(0, 4, 50, dtype=np.uint8)])
        first, last, trigger = parsing.phrases(data, np.arange(len(data) - 199), 200)
        at = {s: t - s for f, e, t in zip(first, last, trigger, strict=True) for s in range(f, e + 1)}
        found.append([at[lead + k] for k in range(61)])
    assert found[0] == found[1] == found[2]


def test_token_counts_equal_the_library():
    rng = random.Random(3)
    texts = ["Σίσυφος ΟΔΟΣ İstanbul ½ ① 東京 <|endoftext|>abc<|startoftext|> it's I'LL aaaa áé \x1c 4٣", "🙂🙂 é́́ ​", "!?" * 500, "x" * 900, "", "<|endoftext|", None]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x900, 0x3000), 10, 32, 9])) for _ in range(120)) for _ in range(80)]
    path = public_tokenizers.path(tokencount.VOCABULARY)
    library = Tokenizer.from_file(path)
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokencount.count_texts(texts, tokencount.Merges(path), {}) == expected


def test_token_count_edges(spark):
    rows = [(1, "the the", 5), (None, None, 6), (1, "the the", 5), (2, "", 7), (3, "word " * 3000, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = tokencount.with_token_counts(df, limit=2048).orderBy("n_bytes").collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got][:2] in ([(None, 0, 0, False), (2, 0, 0, False)], [(2, 0, 0, False), (None, 0, 0, False)])
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got][2:] == [(7, 2, False), (7, 2, False), (15000, 3000, True)]
    assert tokencount.with_token_counts(df.limit(0)).collect() == []


def test_shards_are_even_and_stay_when_one_leaves():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 1009
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 1009 * 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_placement_edges(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z"), (7, None)], "doc_id bigint, slot string")
    placed = sharding.place(df, "doc_id", ["a", "b", "c"], 31)
    rows = placed.collect()
    assert placed.columns == ["doc_id", "slot", "shard"] and len(rows) == 4
    table = sharding.lookup_table(["a", "b", "c"], 31)
    assert all(r.shard == table[r.slot] for r in rows)
    assert len({(r.slot, r.shard) for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(df.limit(0), "doc_id", ["a"], 31).collect() == []
    plan = sharding.place(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b"], 31)
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "BroadcastHashJoin" in text


def test_written_shards_hold_all_rows(spark, tmp_path):
    placed = sharding.place(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b", "c"], 31)
    sharding.write_shards(placed, str(tmp_path / "s"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and back.agg(F.countDistinct("shard")).first()[0] == 3
