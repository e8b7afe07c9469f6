"""Token counts by rank-synchronous merging over ragged numpy arrays.

A batch of distinct pre-tokens is one array of symbols with bounds. In each round every sequence finds the lowest rank among its
neighbouring pairs and merges all its occurrences from the left, all sequences at once; rounds end when no pair of any sequence
has a rank. What counts is the number of symbols that survive. Equal words are counted once: texts are cut at blanks, and each
distinct blank-separated stretch of a slice is split, merged and remembered. The memory is emptied when it is full, which costs time,
never counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from tokenizers import Tokenizer

from packetloom.llm import textbytes

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct stretches a worker remembers between slices.
REMEMBERED = 400_000


#: Anything but printable ASCII, Latin letters and common punctuation: these need no normalisation but lower case.
_RARE = regex.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u02ff\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """Merge rules of a byte-level vocabulary with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        self.end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + self.end, -1) for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        #: Ranks of pairs of bytes; the second index counts bytes within a sequence, then bytes that end it.
        every = np.arange(256)
        second = np.concatenate([self.inner, self.final])
        self.first = self.rank_of(np.repeat(self.inner[every], 512), np.tile(second, 256)).reshape(256, 512)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.library = Tokenizer.from_str(text)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

    def merged(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) that survive in each (non-empty) sequence of bytes, one sequence after another."""
        return self.merged_bytes(np.frombuffer(b"".join(sequences), np.uint8), np.fromiter(map(len, sequences), np.int64, len(sequences)))

    def merged_bytes(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merged``, of sequences that stand one after another."""
        n = len(lengths)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.inner[data]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[data[last]]
        owner = np.repeat(np.arange(n), lengths)
        # rank[i] belongs to the pair (i, i + 1); the last symbol of a sequence has none.
        inside = np.ones(len(ids), bool)
        inside[last] = False
        rank = np.full(len(ids), self.none, np.int64)
        pair = np.flatnonzero(inside)
        rank[pair] = self.first[data[pair], data[pair + 1] + 256 * (~inside[pair + 1]).astype(np.int64)]
        starts = last + 1 - lengths
        out = np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            lowest = np.minimum.reduceat(rank, starts)
            # Sequences without a mergeable pair are done: count them and go on with the others.
            sizes = np.diff(starts, append=len(ids))
            done = lowest == self.none
            out[owner[starts[done]]] = sizes[done]
            keep = np.repeat(~done, sizes)
            kept.append((owner[~keep], ids[~keep]))
            if done.all():
                order = np.argsort(np.concatenate([o for o, _ in kept]), kind="stable")
                return np.concatenate([i for _, i in kept])[order], out
            ids, owner, rank, inside = ids[keep], owner[keep], rank[keep], inside[keep]
            sizes, lowest = sizes[~done], lowest[~done]
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of overlapping occurrences (a run of one symbol) every second one counts, from the left.
            close = np.flatnonzero(np.diff(at) == 1) + 1
            if len(close):
                fresh = np.ones(len(at), bool)
                fresh[close] = False
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.made[rank[at]]
            inside[at] = inside[at + 1]
            # Only the pairs beside a merged symbol have new ranks.
            renew = np.zeros(len(ids), bool)
            renew[at] = True
            before = at[at > 0] - 1
            renew[before] = True
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            # A symbol that was merged away hands the renewal to the one before it.
            gone = before[~stay[before]]
            renew[gone - 1] = True
            ids, owner, rank, inside, renew = ids[stay], owner[stay], rank[stay], inside[stay], renew[stay]
            rank[renew & ~inside] = self.none
            pair = np.flatnonzero(renew & inside)
            rank[pair] = self.rank_of(ids[pair], ids[pair + 1])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], self.none)

    def pre_tokens(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch of text without special tokens."""
        if stretch.isascii() and stretch.isalpha():
            return [stretch.lower()]
        if _RARE.search(stretch):
            # Character tables differ between versions of Unicode; the library's own decide beyond the common characters.
            plain = self.library.normalizer.normalize_str(stretch)
            return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return self.pattern.findall(stretch.lower())

    def pre_tokens_of(self, stretches: list[str]) -> list[list[str]]:
        """The pre-tokens of each of many stretches without special tokens and line feeds, searched as one text of a stretch a line."""
        lines = "\n".join(stretches)
        if _RARE.search(lines):
            common = [s for s in stretches if s.isascii() and s.isprintable() or not _RARE.search(s)]
            made = dict(zip(common, self.pre_tokens_of(common), strict=True))
            return [made[s] if s in made else self.pre_tokens(s) for s in stretches]
        tokens = self.lines.findall(lines.lower())
        ends = [*(i for i, token in enumerate(tokens) if token == "\n"), len(tokens)]
        return [tokens[a:b] for a, b in zip([0, *(i + 1 for i in ends[:-1])], ends, strict=True)] if stretches else []

    def stretch_counts(self, stretches: list[str]) -> list[int]:
        """The number of tokens of each stretch. A special token's string counts as one token, as the library does by default."""
        index: dict[str, int] = {}
        owner: list[int] = []
        numbers: list[int] = []
        specials = np.zeros(len(stretches), np.int64)
        for i, stretch in enumerate(stretches):
            if "<|" in stretch:
                specials[i] = len(self.special.findall(stretch))
                found = [t for piece in self.special.split(stretch) for t in self.pre_tokens(piece)]
            else:
                found = self.pre_tokens(stretch)
            for token in found:
                numbers.append(index.setdefault(token, len(index)))
                owner.append(i)
        _, counts = self.merged([t.encode("utf-8") for t in index])
        total = np.bincount(owner, counts[numbers], len(stretches)) if numbers else np.zeros(len(stretches))
        return (specials + total.astype(np.int64)).tolist()


_LOADED: dict[str, Merges] = {}


def loaded(path: str) -> Merges:
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def count_texts(texts: list[str | None], merges: Merges, memory: dict[str, int]) -> list[int]:
    """Tokens of each whole text; null is empty. New stretches of all texts are merged together."""
    split = [(text or "").replace("\n", " ").split(" ") for text in texts]
    new = set().union(*split).difference(memory)
    if len(memory) + len(new) > REMEMBERED:
        memory.clear()
        new = set().union(*split)
    new = list(new)
    memory.update(zip(new, merges.stretch_counts(new), strict=True))
    return [sum(map(memory.__getitem__, words)) for words in split]


def with_token_counts(
    df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, keep: list[str] | None = None
) -> DataFrame:
    """All columns (or those in ``keep``) with ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (boolean).

    Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and ties change nothing, an empty table stays
    empty, and columns of the input named like a result are replaced. Texts are counted whole, in slices of bounded size.
    """
    textbytes.bounded_batches(df.sparkSession)
    path = public_tokenizers.path(vocabulary)
    made = ("n_bytes", "n_tokens", "over_limit")
    carried = [c for c in (df.columns if keep is None else keep) if c not in made]
    kept = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, text])])
    schema = StructType(
        [*[kept.schema[c] for c in carried], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memory = loaded(path), {}
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            sizes, tokens = [], []
            for row, _, offsets in textbytes.slices(column):
                part = column.slice(row, len(offsets) - 1).to_pylist()
                sizes.extend(np.diff(offsets).tolist())
                tokens.extend(count_texts(part, merges, memory))
            arrays = [batch.column(batch.schema.names.index(c)) for c in carried]
            arrays += [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *made])

    return kept.mapInArrow(count, schema)


def op5_rank_synchronous_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_token_counts(documents, keep=["doc_id"])
