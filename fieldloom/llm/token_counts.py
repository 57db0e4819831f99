"""Token counts of a word-level byte-pair vocabulary, by rank-synchronous array merging.

A text is cut into pre-tokens as the vocabulary's library does. The distinct pre-tokens of a
batch are held as one ragged array of symbols with offsets; in each step every pre-token finds
the lowest rank among its adjacent pairs and merges all places of that pair at once, and
pre-tokens without a pair leave the array. The symbols that survive are counted. Merging all
places of the lowest pair at once is what merging them one by one gives, for a pair that holds
a merged symbol always has a higher rank than the merge that made it.

Everything happens inside the scan: no shuffle, and memory is bounded by a batch and a memory
of counts by word that is emptied when it is full.

Defined results: a null or empty text has no bytes and no tokens; special strings inside a text
are one token each; repeated rows are counted each; a very
long text is counted whole; merges of equal rank go from left to right; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import stored

#: Words whose counts a task remembers.
REMEMBERED = 1_000_000

#: Fixed values of the vocabulary's pre-tokenizer (white space is Unicode's property).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeTable:
    """Initial symbols and merges of a vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, end = whole["model"], whole["model"]["end_of_word_suffix"] or ""
        vocabulary, symbols = model["vocab"], byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + end] for s in symbols], np.int64)
        self.width = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.special = [t["content"] for t in whole["added_tokens"]]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, or the number of merges where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token (not empty) ends with."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        counts, live = sizes.copy(), np.arange(len(words))
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        while len(live):
            ends = np.cumsum(sizes)
            rank = np.full(len(symbols), len(self.keys))
            rank[:-1] = self.lookup(symbols[:-1] * self.width + symbols[1:])
            rank[ends - 1] = len(self.keys)  # no pair reaches into the next pre-token
            low = np.minimum.reduceat(rank, ends - sizes)
            counts[live] = sizes
            going = low < len(self.keys)
            keep = np.repeat(going, sizes)
            symbols, rank, low, sizes, live = symbols[keep], rank[keep], low[going], sizes[going], live[going]
            if not len(live):
                break
            chosen = rank == np.repeat(low, sizes)
            # of overlapping places (a a a) every other one merges, from the left
            place = np.arange(len(symbols))
            first = np.maximum.accumulate(np.where(chosen & ~np.r_[False, chosen[:-1]], place, 0))
            chosen &= (place - first) % 2 == 0
            word = np.repeat(np.arange(len(live)), sizes)
            symbols[chosen] = self.made[low[word[chosen]]]
            gone = np.r_[False, chosen[:-1]]
            sizes = sizes - np.bincount(word[gone], minlength=len(live))
            symbols = symbols[~gone]
        return counts


class Counter:
    """Counts the tokens of texts; words that came before are remembered."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(r"\p{White_Space}+")

    def split(self, text: str) -> list[str]:
        """Normalise and cut at white space, which no pre-token crosses."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w for w in self.space.split(text) if w] if self.odd.search(text) else text.split()

    def learn(self, words: set[str]) -> None:
        """Count the tokens of new words, all their distinct pre-tokens in one array."""
        parts = {w: [p.encode() for p in self.pattern.findall(w)] for w in words}
        distinct = list({p for ps in parts.values() for p in ps})
        counts = dict(zip(distinct, self.table.count(distinct).tolist())) if distinct else {}
        self.known.update((w, sum(counts[p] for p in ps)) for w, ps in parts.items())

    def __call__(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        rows = []
        for text in texts:
            text = text or ""
            pieces = self.special.split(text) if self.special else [text]
            rows.append((len(pieces) - 1, [w for p in pieces for w in self.split(p)] if len(pieces) > 1 else self.split(text)))
        self.learn({w for _, words in rows for w in words}.difference(self.known))
        return [special + sum(map(self.known.__getitem__, words)) for special, words in rows]


def _count(table, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value)
        for batch in batches:
            n = counter(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit and the carried columns.

    `path` is the vocabulary's file; the driver reads it and ships its tables (about 2 MB)."""
    table = docs.sparkSession.sparkContext.broadcast(MergeTable(path))
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("body"))
    out = base.drop("body").withColumn("n_tokens", F.lit(0).cast("long"))
    counted = stored(base.mapInArrow(_count(table, to_arrow_schema(out.schema)), out.schema), "token-counts")
    counted = counted.withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.withColumnsRenamed({f"carry_{c}": c for c in carry})
