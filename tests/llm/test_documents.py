"""Operators over pairs of documents against brute force, with rows that go wrong easily."""

import hashlib
import os
import pathlib
import random
import re
import subprocess
import sys

import numpy as np
import pyspark
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from packetloom.llm import bitmap, decontaminate, groups, minhash, quality, suffixes
from packetloom.llm.components import connected_components

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def blake(data):
    return hashlib.blake2b(data, digest_size=12).digest()


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(120), prose(60)
    out = [base] * 5 + [edited(base, 0.02) for _ in range(40)] + [edited(base, 0.06) for _ in range(10)]
    out += [prose(rng.randrange(1, 200)) for _ in range(30)] + [prose(20) + " " + passage + " " + prose(20) for _ in range(12)]
    out += [None, "", "   ", "one", "two words", "one", "ab" * 700, "ab" * 650, prose(4000), "é" * 400 + base]
    return out


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (130, 131), (131, 130), (130, 131)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 130: 130, 131: 130}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_every_pair_of_a_large_group_meets_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(3)], "g bigint, row bigint")
    seen = {}
    for _, rows in df.sparkSession.createDataFrame(groups.paired_chunks(df, ["g"], "row", 8).toPandas()).toPandas().groupby(["g", "left", "right"]):
        assert len(rows) <= 30
        for a in rows.itertuples():
            for b in rows.itertuples():
                if a.row < b.row and (a.left == a.right or a.side != b.side):
                    seen[a.g, a.row, b.row] = seen.get((a.g, a.row, b.row), 0) + 1
    assert set(seen.values()) == {1} and len(seen) == 40 * 39 // 2 + 3


def test_rows_of_one_component_meet_only_the_others(spark):
    rows = [(1, i, 5 if i < 90 else i) for i in range(100)] + [(2, i, 7) for i in range(20)] + [(3, i, i) for i in range(4)]
    made = groups.paired_chunks(spark.createDataFrame(rows, "g bigint, row bigint, part bigint"), ["g"], "row", 10, apart="part").toPandas()
    seen = {}
    for _, met in made.groupby(["g", "left", "right"]):
        for a in met.itertuples():
            for b in met.itertuples():
                if a.row < b.row and a.part != b.part and (a.left == a.right or a.side != b.side):
                    seen[a.g, a.row, b.row] = seen.get((a.g, a.row, b.row), 0) + 1
    wanted = {(g, a, b) for g, a, x in rows for h, b, y in rows if g == h and a < b and x != y}
    assert set(seen) == wanted and set(seen.values()) == {1}
    # In proportion to the group, not to its square.
    assert len(made) < 3 * len(rows)


def near_truth(texts, words, similarity):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("words", "similarity"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, texts, words, similarity):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.key: (r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(df, words=words, similarity=similarity).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(near_truth(texts, words, similarity))}


def test_copies_of_one_text_that_are_far_from_each_other(spark):
    """Each copy reaches the threshold with its origin alone, which has neither the smallest nor the largest key."""
    base = prose(80).split()
    texts = []
    for n in range(300):
        words = list(base)
        for at in (3 + n % 30, 40 + n // 30):
            words[at] = f"w{n}x{at}"
        texts.append(" ".join(words))
    texts.insert(123, " ".join(base))
    texts += [" ".join([*base[:60], *prose(30).split()]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.key: (r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(df, words=3, similarity=85).collect()}
    truth = near_truth(texts, 3, 85)
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(truth)}
    assert sum(c == 0 for _, c in truth) == 301


def test_near_duplicate_edges(spark):
    text = prose(50)
    df = spark.createDataFrame([(4, text, 1), (4, text, 2), (None, text, 3), (9, text, 4), (7, None, 5)], "doc_id bigint, text string, component int")
    got = sorted(((r.key, r.component, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, None, True), (9, 4, False), (7, 7, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_a_bitmap_is_made_by_few_jobs(spark):
    """One job for each shuffle partition took half of the time on tables dealt over many."""
    spots = sorted({rng.randrange(1 << bitmap.BITS) for _ in range(3000)} | {0, (1 << bitmap.BITS) - 1})
    shift = 64 - bitmap.BITS
    hashes = np.array(spots, np.uint64) << np.uint64(shift)
    df = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)] * 2, "hash bigint")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    next_job = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        first = next_job()
        made = bitmap.bitmap(df)
        jobs = next_job() - first
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert np.flatnonzero(np.unpackbits(made)).tolist() == spots and len(made) == (1 << bitmap.BITS) // 8
    assert jobs <= 5
    assert bitmap.known(made, hashes).all() and not bitmap.known(made, hashes + np.uint64(1 << shift)).all()
    assert not bitmap.bitmap(df.limit(0)).any()


def test_pruning_travels_without_the_package(tmp_path):
    """Executors need not have this package, so no name in what is sent may be looked up there."""
    load = "import pickle, sys; pickle.load(sys.stdin.buffer)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(pathlib.Path(pyspark.__file__).parent.parent)}
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(minhash.plausible), cwd=tmp_path, env=env, check=True)


def test_sketches_prune_far_pairs_only():
    generator = np.random.default_rng(2)
    left = generator.integers(0, 256, (400, 120), dtype=np.uint8)
    near, far = left.copy(), left.copy()
    near[generator.random(left.shape) < 0.12] += 1
    far[generator.random(left.shape) < 0.6] += 1
    assert len(minhash.plausible(left, near, 85)) == 400
    assert len(minhash.plausible(left, far, 85)) < 4


def repeats_truth(texts, span):
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - span + 1):
            name = blake(b[i : i + span])
            seen[name] = seen.get(name, 0) + 1
    out = []
    for b in bodies:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[blake(b[i : i + span])] > 1:
                covered[i : i + span] = True
        runs = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("large", [4096, 2])
def test_repeats_equal_brute_force(spark, texts, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, tag int")
    rows = suffixes.remove_repeats(df, ["doc_id", "tag"], with_text=True).collect()
    assert {r.doc.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(repeats_truth(texts, 200)))
    assert all(r.doc.tag == r.doc.doc_id for r in rows)
    assert all(r.kept == (texts[r.doc.doc_id] or "") for r in rows if not r.n_removed)


def test_repeats_in_long_texts_cut_into_pieces(spark, monkeypatch):
    long = prose(900)
    texts = [long + prose(200), prose(300) + long[1000:2500], prose(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(suffixes.textbytes, "SLICE_BYTES", 700)
    source = [(i, t) for i, t in enumerate(texts)]
    found = []
    for _, t in source:
        import pyarrow as pa

        for text, part, first, last, low, context, phrase in suffixes._parsed(pa.array([t]), 200):
            for f, e, at in zip(first, last, low, strict=True):
                found += [t.encode()[at + k : at + k + 200] == part[f + k : f + k + 200].tobytes() for k in range(e - f + 1)]
    assert all(found) and len(found) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.undo()
    rows = suffixes.remove_repeats(df, ["doc_id"]).collect()
    assert {r.doc.doc_id: r.n_removed for r in rows} == {i: t[1] for i, t in enumerate(repeats_truth(texts, 200))}


def test_repeat_edges(spark):
    text = prose(80)
    df = spark.createDataFrame([(1, text), (1, text), (None, "x" + text), (2, None), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df, ["doc_id"]).collect())
    n = len(text)
    assert got == [(0, 0, 0), (0, n + 1, n), (1, n, n), (1, n, n), (2, 0, 0)]
    many = suffixes._marks(spark.createDataFrame([(1, 5, text)] * 50, "key bigint, tag bigint, body string"), suffixes.SPAN).collect()
    assert len(many) == 1 and len(many[0].begins) < 5
    assert suffixes.remove_repeats(df.limit(0), ["doc_id"]).collect() == []


def words_of(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def test_contamination_equals_brute_force(spark):
    long, short = prose(40), "Zebra-crossing é"
    items = [(1, long), (2, short), (3, None), (4, "..."), (5, long), (10, "unique"), (None, prose(20)), (6, " ".join(["echo"] * 15))]
    inside = long.split(" ")
    docs = [
        (1, prose(30) + " " + " ".join(inside[3:25]) + " " + prose(30)), (2, " ".join(inside[:12])), (3, "a ZEBRA crossing É. zebra crossing é!"), (4, None), (5, ""),
        (6, "unique"), (7, " ".join(["echo"] * 40)), (7, long.upper()), (None, long), (8, prose(3000) + " unique"),
    ]
    want = []
    for key, text in docs:
        w = words_of(text)
        hit, named = set(), set()
        for item, value in items:
            iw = words_of(value)
            n = min(13, len(iw))
            for i in range(len(iw) - n + 1) if n and item is not None else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[i : i + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(item))
        want.append((key, len(w), len(hit), ",".join(sorted(named))))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.find_contamination(a, b, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.find_contamination(a.limit(0), b, ["doc_id"]).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(a, b.limit(0), ["doc_id"]).collect())


def test_factorisation_machine_learns_an_interaction():
    # Label 1 if exactly one of two words is there: no linear machine can tell.
    generator = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(2000):
        a, b = generator.integers(0, 2, 2)
        ids = np.array([10 + a, 20 + b])
        rows.append((ids, np.array([0.7, 0.7])))
        labels.append(float(a != b))
    machine = quality.train(rows, np.zeros((2000, 1)), np.array(labels))
    bounds = np.arange(0, 4001, 2)
    score = machine.score(bounds, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.zeros((2000, 1)))
    assert ((score > 0.5) == np.array(labels)).mean() > 0.99


def test_scores_equal_the_sum_over_all_pairs():
    generator = np.random.default_rng(7)
    machine = quality.Machine(
        0.3, generator.normal(size=quality.BUCKETS + 4), generator.normal(0, 0.3, (quality.BUCKETS + 4, quality.RANK)), generator.normal(size=4), np.ones(4)
    )
    bounds = np.array([0, 3, 3, 10])
    ids, weight, values = generator.integers(0, quality.BUCKETS, 10), generator.random(10), generator.normal(size=(3, 4))
    want = []
    for i in range(3):
        part = slice(bounds[i], bounds[i + 1])
        at = np.concatenate([ids[part], quality.BUCKETS + np.arange(4)])
        x = np.concatenate([weight[part], machine.dense(values)[i]])
        total = machine.bias + machine.linear[at] @ x
        total += sum(machine.factors[at[a]] @ machine.factors[at[b]] * x[a] * x[b] for a in range(len(at)) for b in range(a))
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(machine.score(bounds, ids, weight, values), want)


def test_copies_of_a_key_are_learned_from_once(spark):
    texts = [prose(30) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    copies = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    one, many = quality.fit(docs, labels), quality.fit(copies, labels)
    assert (one.linear == many.linear).all() and (one.factors == many.factors).all()


def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = quality.with_score(docs, quality.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    rows = scored.collect()
    assert len(rows) > 40
    assert sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (None, "", 0, 1), (2, prose(5), 30, 2), (2, prose(5), None, 3)], "doc_id bigint, text string, n_chars bigint, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    rows = quality.with_score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 4 and all(0 < r.score < 1 for r in rows)
    machine = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.with_score(docs, machine).collect()} == {0.5}
    assert quality.with_score(docs.limit(0), machine).collect() == []
