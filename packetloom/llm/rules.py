"""Quality rules as a learned decision list.

1. Statistics of whole texts: how they repeat themselves, what they are made of, how their lines look.
2. Sequential covering on labelled rows. A rule is a conjunction of thresholds on these statistics. It grows, one condition at a time, by the
   gain of information on two thirds of the rows that no rule covers yet, is pruned from its end on the other third, and is kept
   if enough of what it covers was labelled as bad. Its rows leave, and the next rule is sought.
3. The list is emitted as one ordered Spark conditional: the first rule that holds gives the verdict, by its number.

Rules are learned in one task from a bounded sample of labelled rows (``SAMPLE``); all rows are judged by the expression, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packetloom.llm import textbytes
from packetloom.session import settled

#: Labelled rows that rules are learned from, at most.
SAMPLE = 20_000
#: Words of a window whose repetition counts.
WINDOW = 8
#: Words of a block within which distinct words are counted, so that long texts are not taken for monotonous ones.
BLOCK = 50
#: Rules of a list, conditions of a rule, rows of the sample that a rule covers at least, and the share of them that must be labelled bad.
RULES, CONDITIONS, COVERED, PRECISION = 24, 4, 4, 0.9
SYMBOLS = "#*$%&|<>"

_COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines", "n_varied_words", "n_echoes", "n_capitals", "n_shouted",
    "n_digits", "n_marks", "n_lone_symbols",
)
#: What rules may ask about, from the counts. Shares do not depend on the length of a text.
STATISTICS = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "lone_symbol_share": "n_lone_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
    "varied_share": "n_varied_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "shouted_share": "n_shouted / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _class_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_IS_SYMBOL = _class_of(SYMBOLS)
_IS_CAPITAL = _class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IS_DIGIT = _class_of("0123456789")
_IS_MARK = _class_of("!?.,;:-_=+~^@/\\()[]{}'\"`")
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts named in _COUNTS, a row for each text."""
    texts = len(offsets) - 1
    out = np.zeros((texts, len(_COUNTS)), np.int64)
    at = {name: i for i, name in enumerate(_COUNTS)}

    def bytes_of(which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which[data])])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, first = textbytes.word_bounds(data, offsets, textbytes.BLANK_SEPARATED)
    words = np.diff(first)
    owner = np.repeat(np.arange(texts), words)
    per_text = lambda flags: np.bincount(owner[flags], minlength=texts)
    out[:, at["n_words"]] = words
    out[:, at["word_chars"]] = bytes_of(textbytes.BLANK_SEPARATED & _BEGINS)
    out[:, at["n_chars_all"]] = bytes_of(_BEGINS)
    for name, which in (("n_symbols", _IS_SYMBOL), ("n_capitals", _IS_CAPITAL), ("n_digits", _IS_DIGIT), ("n_marks", _IS_MARK)):
        out[:, at[name]] = bytes_of(which)

    if len(starts):
        hashes = textbytes.span_hashes(data, starts, ends)
        tinted = lambda values, text: textbytes.mix(values + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        block = (np.arange(len(owner)) - first[owner]) // BLOCK
        _, some = np.unique(tinted(tinted(hashes, block), owner), return_index=True)
        out[:, at["n_varied_words"]] = np.bincount(owner[some], minlength=texts)
        echo = np.zeros(len(hashes), bool)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out[:, at["n_echoes"]] = per_text(echo)
        head, second = data[starts], data[np.minimum(starts + 1, ends - 1)]
        out[:, at["n_shouted"]] = per_text(_IS_CAPITAL[head] & _IS_CAPITAL[second] & (ends - starts > 1))
        out[:, at["n_lone_symbols"]] = per_text(_IS_SYMBOL[head] & (ends - starts == 1))
        runs, bounds = textbytes.shingles(hashes, first, WINDOW)
        text = np.repeat(np.arange(texts), np.diff(bounds))
        _, inverse, seen = np.unique(tinted(runs, text), return_inverse=True, return_counts=True)
        again = np.flatnonzero(seen[inverse] > 1)
        # Only texts of a window's length and more have equal windows.
        begin = first[text[again]] + again - bounds[text[again]]
        depth = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(begin + WINDOW, minlength=len(starts) + 1)
        out[:, at["n_repeat_words"]] = per_text(np.cumsum(depth[: len(starts)]) > 0)

        begins, stops, line = textbytes.word_bounds(data, offsets, _NOT_NEWLINE)
        inside = np.concatenate([[0], np.cumsum(textbytes.BLANK_SEPARATED[data])])
        of = np.repeat(np.arange(texts), np.diff(line))
        with_word = inside[stops] > inside[begins]
        begins, stops, of = begins[with_word], stops[with_word], of[with_word]
        _, some = np.unique(tinted(textbytes.span_hashes(data, begins, stops), of), return_index=True)
        out[:, at["n_lines"]] = np.bincount(of, minlength=texts)
        out[:, at["n_dup_lines"]] = out[:, at["n_lines"]] - np.bincount(of[some], minlength=texts)
    return out


def with_counts(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """(doc, counts…) of every row; ``doc`` holds the columns named in ``carry``. Null texts are counted like empty ones."""
    textbytes.bounded_batches(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{text}`").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in textbytes.slices(batch.column(1)):
                found = counts(data, offsets)
                columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(_COUNTS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), *columns], ["doc", *_COUNTS])

    return source.mapInArrow(run, StructType([source.schema["doc"], *[StructField(c, LongType()) for c in _COUNTS]]))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"{STATISTICS[self.statistic]} {'>=' if self.at_least else '<='} cast('{self.threshold!r}' as double)"

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        column = values[:, names.index(self.statistic)]
        return column >= self.threshold if self.at_least else column <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, values: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(values), bool)
    for condition in rule:
        out &= condition.holds(values, names)
    return out


def _best_condition(values: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition] | None:
    """The threshold of largest information gain over all statistics, halfway between two values; ties go to the first statistic."""
    p, n = int(bad.sum()), int((~bad).sum())
    base = np.log2(p / (p + n))
    best: tuple[float, Condition] | None = None
    for k, name in enumerate(names):
        order = np.argsort(values[:, k], kind="stable")
        value, mark = values[order, k], bad[order].astype(np.int64)
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        below_p, below_n = np.cumsum(mark)[cut], np.cumsum(1 - mark)[cut]
        for at_least, pos, neg in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / (pos + neg)) - base), 0.0)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-9):
                middle = float(value[cut[i]] + (value[cut[i] + 1] - value[cut[i]]) / 2)
                # Two neighbours among the floats have no middle.
                middle = float(value[cut[i] + 1]) if at_least and middle <= value[cut[i]] else middle
                best = float(gain[i]), Condition(name, at_least, middle)
    return best


def grown(values: np.ndarray, bad: np.ndarray, names: list[str], conditions: int = CONDITIONS) -> Rule:
    """A conjunction that covers bad rows, and as long as gain is left, fewer and fewer others."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < conditions and bad[inside].any() and not bad[inside].all():
        found = _best_condition(values[inside], bad[inside], names)
        if not found:
            break
        rule = (*rule, found[1])
        inside &= found[1].holds(values, names)
    return rule


def pruned(rule: Rule, values: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The beginning of the rule that is worth most on other rows, by (bad - good) / covered; the shortest of equal ones."""
    best, worth = rule, -2.0
    for size in range(1, len(rule) + 1):
        inside = _covered(rule[:size], values, names)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        here = (p - n) / (p + n) if p + n else -1.0
        if here > worth + 1e-12:
            best, worth = rule[:size], here
    return best


def learned(values: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 3) -> list[Rule]:
    """Rules for bad rows, in order, by sequential covering. Without bad or without good rows there are none."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < RULES and bad[left].any() and not bad[left].all():
        at = rng.permutation(np.flatnonzero(left))
        # Both parts have their share of bad rows.
        at = np.concatenate([at[bad[at]], at[~bad[at]]])
        grow, prune = at[np.arange(len(at)) % 3 > 0], at[np.arange(len(at)) % 3 == 0]
        rule = pruned(grown(values[grow], bad[grow], names), values[prune], bad[prune], names) if bad[grow].any() else ()
        inside = left & _covered(rule, values, names)
        if not rule or inside.sum() < COVERED or bad[inside].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of them in windows of eight words that occur twice or more in the text."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules learned from at most ``sample`` labelled keys, those with the smallest hashes; a fifth of all keys is never learned from.

    Rows without a key or label are not used; of rows or labels that share a key one is used. Label 0 is bad. Rows that the base rejects
    teach nothing, as the list never sees them.
    """
    usable = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label"))
    usable = usable.where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_key"))).groupBy("_key").agg(F.min("_label").alias("_label"))
    # The sample is bounded, so its keys may be broadcast.
    chosen = settled(usable.orderBy(F.xxhash64("_key"), "_key").limit(sample))
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
    statistics = [F.expr(sql).alias(name) for name, sql in STATISTICS.items()]
    found = with_counts(texts, ["_key", "_label"], "_text").where(~base_failed()).select("doc._key", "doc._label", F.struct(*statistics).alias("stats"))
    one = found.groupBy("_key", "_label").agg(F.min("stats").alias("stats")).select(F.col("_key").cast("string").alias("key"), "_label", "stats.*")
    names = list(STATISTICS)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        rules = learned(group[names].to_numpy(float), group["_label"].to_numpy() == 0, names)
        rows = [(i, c.statistic, c.at_least, c.threshold) for i, rule in enumerate(rules) for c in rule]
        return pd.DataFrame(rows, columns=["rule", "statistic", "at_least", "threshold"])

    # At most RULES * CONDITIONS rows come back.
    rows = one.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "rule int, statistic string, at_least boolean, threshold double").collect()
    rules: list[list[Condition]] = [[] for _ in range(max([r.rule for r in rows], default=-1) + 1)]
    for r in rows:
        rules[r.rule].append(Condition(r.statistic, r.at_least, r.threshold))
    return [tuple(rule) for rule in rules]


def expression(rules: list[Rule]) -> str:
    """The list as SQL over the counts: the number of the first rule that holds, from 1, or 0."""
    cases = [f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)]
    return f"CASE {' '.join(cases)} ELSE 0 END" if cases else "0"


def held_out(key: Column) -> Column:
    """Rows never learned from: a fifth, by the checksum of the key's text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def judged(docs: DataFrame, rules: list[Rule], carry: list[str], text: str = "text") -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept) of every row.

    ``rule`` is the number of the learned rule that rejects the row, 0 if none; ``kept`` if neither does. Null and empty texts have
    no words and fail. Rows are independent: repeated rows get equal verdicts, an empty table stays empty, texts of any length are
    read whole, and columns of any name may be carried.
    """
    rows = with_counts(docs, carry, text).withColumn("base_failed", base_failed()).withColumn("rule", F.expr(expression(rules)))
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return rows.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", kept.alias("kept"))


def op12_learned_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = judged(docs, rules, ["doc_id"])
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
