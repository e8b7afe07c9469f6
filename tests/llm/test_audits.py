"""Filter interactions, decision lists and source divergence against brute force, with rows that go wrong easily."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import divergence, interactions, rules

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Filter interactions.


def masks(rows):
    out = []
    for key, text, _ in rows:
        t = text or ""
        w = words_of(t)
        failed = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]
        same = [k for k, other, _ in rows if (other or "") == t]
        failed.append(any(k is not None and (key is None or k < key) for k in same))
        out.append({letter for letter, f in zip("ABCDE", failed, strict=True) if f})
    return out


def interaction_truth(rows, labels):
    found = masks(rows)
    flag = lambda key, at: any(x[0] == key and key is not None and x[at] == 1 for x in labels)
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(m, r[0]) for m, r in zip(found, rows, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [k for m, k in mine if letter in m and not m & before]
                out[part, "".join(order), step] = (
                    sum(not m & (before | {letter}) for m, _ in mine), len(removed), sum(letter in m and bool(m & before) for m, _ in mine),
                    sum(m == {letter} for m, _ in mine), sum(flag(k, 1) for k in removed), sum(flag(k, 2) for k in removed),
                )
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions_equal_brute_force(spark):
    rich, shout = " ".join(f"w{i}" for i in range(80)), "LOUD " * 70
    texts = [rich, rich, rich, shout, None, "", " \t\n", "a|b", rich + " #", "é\x0bü" * 30, prose(3000), "same " * 60, "same " * 60, rich.upper()]
    rows = [(i, t, ["web", "books", None, ""][i % 4]) for i, t in enumerate(texts)] + [(None, rich, "web"), (None, rich, "web"), (None, "alone", "books"), (3, shout, "web")]
    rows += [(100 + i, "copy of one text", "web") for i in range(60)]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (101, 1, 0), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, part string, mask int")
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interactions.interactions(interactions.failure_counts(docs, marked)).collect()}
    assert got == interaction_truth(rows, labels)
    empty = interactions.interactions(interactions.failure_counts(docs.limit(0), marked))
    assert empty.collect() == [] and empty.columns[:3] == ["part", "filter_order", "step"]
    unlabelled = interactions.interactions(interactions.failure_counts(docs, marked.limit(0)))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_paths_of_all_orders():
    forward, backward = interactions.path_counts(4)
    assert forward[0b1111] == backward[0] == 24
    assert [f * b for f, b in zip(forward, backward, strict=True)] == [[24, 6, 4, 6, 24][bin(s).count("1")] for s in range(16)]
    with pytest.raises(ValueError, match="at most"):
        interactions.interactions(None, "ABCDEFGH")


# Decision lists.


def base(text):
    w = words_of(text)
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            repeated += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, repeated, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_counts_equal_brute_force(spark):
    line, passage = prose(6), prose(9)
    texts = [None, "", " \n\t", "é" * 30, "a b", f"{line}\n{line}\n{line} \n\n\n{line}", f"{passage} x {passage} y {passage}", "again " * 50, prose(8) * 2]
    texts += ["\n".join([prose(5), "  ", line, line]) for _ in range(3)] + [prose(20_000), "x#y | <b> 5% & *", "ü ö\x0bä\x0c", "word" * 5000]
    rows = [(i % 12, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n_words int, body string")
    got = rules.judged(docs, [], ["doc_id", "n_words", "body", "text"]).select("doc.doc_id", "doc.text", *rules._COUNTS[:5], "base_failed", "rule", "kept").collect()
    assert sorted(tuple(r) for r in got if r.text is not None) == sorted((k, t, *base(t), 0, not base(t)[-1]) for k, t, _ in rows if t is not None)
    assert [tuple(r)[2:] for r in got if r.text is None] == [(0, 0, 0, 0, 0, True, 0, False)]
    assert rules.judged(docs.limit(0), [], ["doc_id"]).collect() == []


def test_rules_are_found_and_ordered():
    generator = np.random.default_rng(1)
    values = generator.random((900, 4))
    names = list(rules.STATISTICS)[:4]
    bad = (values[:, 1] > 0.8) & (values[:, 2] < 0.5) | (values[:, 3] < 0.1)
    found = rules.learned(values, bad, names)
    covered = np.zeros(900, bool)
    for rule in found:
        covered |= rules._covered(rule, values, names)
    assert (covered == bad).mean() > 0.97 and {c.statistic for rule in found for c in rule} <= set(names[1:])
    assert rules.learned(values, np.zeros(900, bool), names) == [] == rules.learned(values[:0], bad[:0], names)
    noise = rules.learned(values, generator.random(900) < 0.3, names)
    assert not noise
    sql = rules.expression(found)
    assert sql.startswith("CASE WHEN ") and sql.count("WHEN") == len(found) and rules.expression([]) == "0"


def test_pruning_takes_the_end_off():
    values = np.array([[1.0, k / 10] for k in range(10)] + [[0.0, k / 10] for k in range(10)])
    bad = values[:, 0] == 1
    long = (rules.Condition("words", True, 0.5), rules.Condition("word_length", True, 0.75))
    assert rules.pruned(long, values, bad, ["words", "word_length"]) == long[:1]


def test_learned_list_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = rules.op12_learned_decision_list(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    judged = rows.where(~F.col("base_failed") & rules.held_out(F.col("doc_id"))).select("quality", "kept").collect()
    assert len(judged) > 50 and sum(r.kept == (r.quality == 1) for r in judged) / len(judged) > 0.97
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert rules.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels) == []
    # A key that very many rows share is one example.
    docs = spark.createDataFrame([(1, prose(40))] * 300 + [(2, prose(40) + " ### $$$")] * 300, "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 0)], "doc_id bigint, quality int")
    assert rules.fit(docs, marks) == []


# Source divergence.


def divergence_truth(rows, least=3, top=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: [w.translate(fold) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, groups, total = {}, {d[1]: {} for d in mine}, {}
        for _, source, ts in mine:
            for t in set(ts):
                df[t] = df.get(t, 0) + 1
            for t in ts:
                groups[source][t] = groups[source].get(t, 0) + 1
                total[t] = total.get(t, 0) + 1
        kept = [t for t in df if df[t] >= least]

        def shares(counts):
            n = sum(counts.get(t, 0) for t in kept)
            return {t: 1 + 10**9 * (counts.get(t, 0) + 1) // (n + len(kept)) for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in groups.items()}
        for s, counts in groups.items():
            parts = {
                "pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s],
                "term": [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts.get(t, 0) > 0 and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= top}
    return out


@pytest.fixture(scope="module")
def spoken():
    vocabulary = WORDS + ["Ärger", "ärger", "Straße", "naïve", "don't", "x1y2", "日本語"] * 4
    out = [(" ".join(rng.choice(vocabulary).title() for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""])) for _ in range(150)]
    out += [(None, "en", "a"), ("", "fr", "only"), ("123 456", "xx", "p"), ("rare once", "xx", "q"), ("one two one", "yy", "p")]
    out += [("same words here", "zz", "hot")] * 40 + [("same words there", "zz", "cold")] * 2 + [(prose(8000), "en", "long")]
    return out


@pytest.mark.parametrize(("bits", "top"), [(64, 200), (6, 200), (3, 10), (64, 3)])
def test_divergence_equals_brute_force(spark, spoken, bits, top):
    docs = spark.createDataFrame([(*r, "x", 1) for r in spoken], "text string, lang string, source string, term string, gid int")
    got = {tuple(r) for r in divergence.source_divergence(docs, bits=bits, top=top).collect()}
    assert got == divergence_truth(spoken, top=top)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).collect() == []
    silent = spark.createDataFrame([(None, "en", "a"), ("...", "en", "b")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.source_divergence(silent).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "c bigint, total bigint, v bigint")
    assert row.select(divergence._share("c", "total", "v").alias("p")).first().p == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)


def test_entries_are_summed_before_they_are_written(spark):
    docs = spark.createDataFrame([(prose(40), 1, i % 2) for i in range(50)], "body string, lid bigint, gid bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = divergence.counted_terms(docs, held=50).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.n for r in rows) == 2000 and len({r.flush for r in rows}) > 10
    # Within a flush, each digest has its string once, and one row for each source.
    places = [(r.flush, r.lid, r.digest) for r in rows if r.term is not None]
    assert len(places) == len(set(places)) and {(r.flush, r.lid, r.digest) for r in rows} == set(places)
    assert len({(r.flush, r.gid, r.digest) for r in rows}) == len(rows)
