"""Vectors against brute force, packing by exact round trip, the pipeline on awkward rows, queries against SQL."""

import collections
import pathlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom import session
from packetloom.llm import embeddings, groups, packing, queries

SMALL = "/root/testdata/sf0.001"


def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 32))
    x[50:90] = x[50] + rng.normal(size=(40, 32)) * 0.15
    x[120:125] = x[120]
    for i in range(200, 260):
        # A chain: each is just within reach of the one before.
        step = rng.normal(size=32)
        step -= step @ x[i - 1] / (x[i - 1] @ x[i - 1]) * x[i - 1]
        x[i] = x[i - 1] + step / np.linalg.norm(step) * np.linalg.norm(x[i - 1]) * 0.44
    return x


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(embeddings, "paired_chunks", lambda df, keys, row: groups.paired_chunks(df, keys, row, chunk))
    x = vectors()
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [float("inf")] + [1.0] * 31), (905, [None] * 32), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-300] * 32), (909, [1e300] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = {r.key: (r.n_links, r.component, r.kept) for r in embeddings.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    component = np.arange(300)
    while True:
        after = np.where(linked, component[None, :], 1000).min(1)
        if (after == component).all():
            break
        component = after
    want = {i: (int(linked[i].sum()) - 1, int(component[i]), bool(component[i] == i)) for i in range(300)}
    want |= {k: (0, k, True) for k in range(900, 906)}
    want |= {906: (1, 906, True), 907: (1, 906, False), 908: (1, 908, True), 909: (1, 908, False)}
    assert got == want


def test_vector_edges(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(((r.key, r.n_links, r.component, r.kept) for r in embeddings.near_vectors(df).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, True), (5, 0, 5, True)], key=str)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_plans_grow_slowly():
    small, large = embeddings.planned(10_000), embeddings.planned(10_000_000)
    assert small.lines < large.lines < small.lines * 10**0.75 * 2 and large.signs > small.signs
    assert 0.5 * large.lines < large.collisions < large.lines


def check_packing(rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = collections.Counter(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in docs)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc.place].append(r)
        by_sequence[r.sequence_id].append(r)
    got = collections.Counter()
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0 for r in pieces)
        whole = np.frombuffer(b"".join(r.ids for r in pieces), "<u4")
        assert len(whole) == pieces[0].doc_tokens
        got[tuple(whole.tolist())] += 1
    assert got == ids
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        size = sum(r.length for r in pieces)
        assert size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
    assert padding == 0


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (1, ""), (1, ""), (7, "word " * 30_000), (8, "same text"), (8, "same text")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "place int, doc_id bigint, text string")
    check_packing(packing.pack(df, ["place", "doc_id"], with_ids=True).collect(), docs)
    assert packing.pack(df.limit(0), ["doc_id"]).collect() == []


def test_many_short_texts_are_scored_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "SCORED_ROWS", 64)
    docs = [(i, f"word{i % 7}" if i % 3 else "") for i in range(900)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "place int, doc_id bigint, text string").coalesce(1)
    rows = packing.token_ids(df, ["doc_id"], "doc_id", "text", packing.VOCABULARY, packing.END)
    corpus = spark.sparkContext.broadcast(packing.counted(rows))
    sizes = [len(r.doc_names) // 8 for r in packing._blocks(rows, ["key"], corpus, "doc").collect()]
    assert sum(sizes) == 900 and max(sizes) <= 64
    check_packing(packing.pack(df, ["place", "doc_id"], with_ids=True).collect(), docs)


def test_an_encoder_forgets_long_stretches():
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    texts = ["short words", "漢字" * 200, "a" * 300 + " short", "漢字" * 200 + " again"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder.memory)) <= packing.LONGEST and max(map(len, encoder.pieces)) <= packing.LONGEST


@pytest.mark.parametrize("remembered", [10, packing.wordids.REMEMBERED])
def test_ids_over_bytes_are_those_of_the_library(remembered):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    memory = packing.word_ids(public_tokenizers.path(packing.VOCABULARY))
    memory.remembered = remembered
    rng = np.random.default_rng(4)
    parts = [*"abstmdlrveLAé×÷ßÉÞÿÀ'.!<|>09 \n\t\r\x0b\x00\x85", "'ll", "'re", "'VE", "It's", " the", " word", "naïve", "ÉTÉ", "漢字", "e\u0301", "<|endoftext|>", "a" * 40, "'" * 20, "\u0130", "x" * 16, "y" * 17, "…", "Éa" * 5]
    texts = ["", " ", "'", "é", "\xc3", "'s", "s'l", *("".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000))]
    # More new pre-tokens than the first table has room for.
    texts += [" ".join(f"{''.join(rng.choice([*'abcdefgh'], 6))}." for _ in range(400)) for _ in range(300)]
    for _ in range(2):
        for i in range(0, len(texts), 97):
            some = texts[i : i + 97]
            ids, sizes = memory.ids_of([t.encode("utf-8") for t in some], 2)
            want = [library.encode(t, add_special_tokens=False).ids + [2] for t in some]
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert len(memory.one) > 1 << 16 or remembered == 10


def test_only_terms_that_many_documents_hold_are_multiplied(spark, monkeypatch):
    sizes = []
    dense = packing._Block.dense

    def watched(self, column, *rest):
        sizes.append(int(column.max()) + 1)
        return dense(self, column, *rest)

    monkeypatch.setattr(packing._Block, "dense", watched)
    ids = [np.array([2, *range(10 * i + 10, 10 * i + 20)], "<u2") for i in range(100)]
    corpus = packing.Corpus(100, 11.0, np.bincount(np.concatenate(ids), minlength=1 << 16))
    column = np.full(1 << 16, -1, np.int64)
    often = packing.common_terms(corpus)
    column[often] = np.arange(len(often))
    assert often.tolist() == [2]
    doc, term, weight = packing.weighted(ids, corpus)
    made = lambda names: packing.pa.RecordBatch.from_arrays(
        [packing.pa.array([x.tobytes()]) for x in (np.arange(100 * names).reshape(100, names), np.bincount(doc), term.astype("<u2"), weight.astype("<f4"))], list("abcd")
    )
    seeds, docs = packing._Seeds(made(3), 0, 0, column), packing._Block(made(2), 0, 0, 2)
    found, score, _ = seeds.best(docs, 0, 100)
    index = packing.Index(ids, corpus)
    for i in range(100):
        scores = index.scores(ids[i])
        assert np.isinf(score[i]) or abs(scores[found[i]] - score[i]) < 1e-4 and score[i] >= scores.max() - 1e-4
    assert sizes and set(sizes) == {1}


def test_neighbours_share_terms():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * k, 100 * k + 100, (6, 80)) for k in range(5)]
    index = packing.Index([row for topic in topics for row in topic])
    unused = np.ones(30, bool)
    for seed in range(30):
        unused[:] = True
        unused[seed] = False
        assert (index.neighbours(seed, unused)[:4] // 6 == seed // 6).all()


@pytest.mark.parametrize("common", [2048, 5])
def test_seeds_are_searched_in_the_whole_table(spark, monkeypatch, common):
    monkeypatch.setattr(packing, "SCORED_TOKENS", 20_000)
    monkeypatch.setattr(packing, "COMMON", common)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = packing.token_ids(docs, ["doc_id"], "doc_id", "text", packing.VOCABULARY, packing.END).orderBy("key").collect()
    table = spark.createDataFrame([(i, r.key, r.lex1, r.lex2, r.n, r.ids) for i, r in enumerate(rows)], "number bigint, key bigint, lex1 bigint, lex2 bigint, n bigint, ids binary")
    corpus = packing.counted(table)
    ids = [np.frombuffer(r.ids, "<u2") for r in rows]
    assert corpus.documents == len(rows) and abs(corpus.mean - np.mean([len(x) for x in ids])) < 1e-9
    assert (corpus.held == np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1 << 16)).all()
    found = {r.number: r for r in packing.retrieved(table, 4096, corpus).collect()}
    assert sorted(found) == list(range(len(rows)))
    place = {r.key: i for i, r in enumerate(rows)}
    seeds = sorted({place[r.seed] for r in found.values()})
    assert len(seeds) > 10 and sum(map(len, ids)) > 5 * packing.SCORED_TOKENS
    index = packing.Index(ids)
    for i, r in found.items():
        scores, mine = index.scores(np.unique(ids[i])), place[r.seed]
        assert (r.lex1, r.lex2) == (rows[mine].lex1, rows[mine].lex2)
        if i in seeds:
            assert mine == i and r.close == np.inf
        else:
            assert scores[mine] >= scores[seeds].max() * (1 - 1e-5)
            assert abs(index.scores(np.unique(ids[mine]))[i] - r.close) < 1e-3


def test_named_queries_are_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SCORED_TOKENS", 20_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    made = packing.token_ids(docs, ["doc_id"], "doc_id", "text", packing.VOCABULARY, packing.END).collect()
    table = spark.createDataFrame([(r.doc.doc_id, r.key, r.lex1, r.lex2, r.n, r.ids) for r in made], "number bigint, key bigint, lex1 bigint, lex2 bigint, n bigint, ids binary")
    corpus = packing.counted(table)
    ids = [np.frombuffer(r.ids, "<u2") for r in made]
    index, place = packing.Index(ids), {r.key: i for i, r in enumerate(made)}
    seeds = [i for i, r in enumerate(made) if r.doc.doc_id % 7 == 0]
    of = {r.doc.doc_id: i for i, r in enumerate(made)}
    found = packing.retrieved(table, 4096, corpus, "number % 7 = 0").collect()
    assert len(found) == len(made) and {place[r.seed] for r in found} == set(seeds)
    for r in found:
        scores = index.scores(np.unique(ids[of[r.number]]))
        assert of[r.number] in seeds or scores[place[r.seed]] >= scores[seeds].max() * (1 - 1e-5)
    # None, or more than sequences: as without a condition.
    plain = sorted(r.key for r in packing.seeds_of(table, 4096, corpus).collect())
    assert all(sorted(r.key for r in packing.seeds_of(table, 4096, corpus, q).collect()) == plain for q in ("number < 0", "number >= 0", "number IS NULL"))


def test_blocks_are_removed_after_the_search(spark):
    rows = [(i, i, 0, 0, 3, np.array([i % 5, 7, 2], "<u2").tobytes()) for i in range(40)]
    table = spark.createDataFrame(rows, "number bigint, key bigint, lex1 bigint, lex2 bigint, n bigint, ids binary")
    with session.scratch_folder(spark) as folder:
        found = packing.retrieved(table, 12, packing.counted(table), "number % 8 = 0")
    assert len({f.parent for f in pathlib.Path(folder).rglob("*.parquet")}) == 1
    assert sorted(r.number for r in found.collect()) == list(range(40))
    session.remove_folder(spark, folder)


def test_pre_tokens_of_many_stretches_are_those_of_each():
    rules = packing.tokencount.loaded(public_tokenizers.path(packing.VOCABULARY))
    stretches = ["", "Word", "it's", "a\tb\r", "\x0bx", "漢字kana", "\u0130STANBUL", "e\u0301te", "1,234.5!?", "", "'s", "x'", "été", "\u2028", "\x85y"]
    for some in ([], stretches, stretches[:5], stretches[::-1], ["", ""], ["'", "s"]):
        assert rules.pre_tokens_of(some) == [rules.pre_tokens(s) for s in some]


def test_relatives_far_apart_in_lexical_order_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 2_000)
    rng = np.random.default_rng(5)
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    words = {w for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() for w in (r.text or "").split() if w.isalpha()}
    first = {w: packing._ranks(1)[library.encode(w, add_special_tokens=False).ids].min() for w in sorted(words)}
    words = sorted(first, key=first.get)
    # The words that come first in lexical order say nothing about the topic.
    noise, others = words[: len(words) // 10], words[len(words) // 10 :]
    topics = [rng.choice(others, 60, replace=False) for _ in range(20)]
    docs = [(i, " ".join([*rng.choice(topics[i % 20], 200), *rng.choice(noise, 10)])) for i in range(400)]
    by_sequence = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), ["doc_id"], sequence=1024).collect():
        by_sequence[r.sequence_id] += [r.doc.doc_id % 20] * r.length
    # The share of a sequence that its main topic has.
    assert sum(max(collections.Counter(x).values()) for x in by_sequence.values()) > 0.75 * sum(map(len, by_sequence.values()))


def test_pipeline_on_awkward_rows(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = given.first().text
    extra = spark.createDataFrame(
        [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (0, text, "en", "s", 1)], given.schema
    )
    docs = given.union(extra).selectExpr("*", "1 AS score", "2 AS kept", "'x' AS doc", "3 AS row_id", "4 AS n", "5 AS key", "6 AS _key", "7 AS _number", "8 AS _row", "9 AS absent", "'y' AS _null_text", "0.1 AS _quality_score", "7 AS count")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert after.dtypes == docs.dtypes
            assert after.count() <= docs.count()
            if number == 1:
                assert after.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
            docs = after
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = spark.read.parquet(str(tmp_path / "4"))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    assert len(kept) > 100
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), SMALL).collect() == []


def test_near_copies_are_judged_by_text_where_doc_ids_repeat(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(rng.choice([f"w{i}" for i in range(2000)], 200)) for _ in range(4))
    rows = [(3, b), (5, a), (5, b + " more"), (7, c), (7, c + " more"), (8, d), (8, d), (None, d + " more"), (9, None), (9, "")]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()
    got = [(r.doc_id, r.text or "") for r in got]
    assert sorted(x for x in got if x[0] != 7) == [(3, b), (5, a), (8, d), (9, "")]
    assert len([x for x in got if x[0] == 7]) == 1


def test_long_vectors_are_linked(spark):
    x = np.random.default_rng(9).normal(size=(3, 5000))
    x[2] = x[0] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.key: (r.n_links, r.component, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {0: (1, 0, True), 1: (0, 1, True), 2: (1, 0, False)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
