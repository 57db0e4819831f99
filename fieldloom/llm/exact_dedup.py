"""Exact deduplication with counting quotient filters.

Every partition condenses the fingerprints of its rows into a counting quotient filter: the
high bits of a fingerprint (the quotient) say which run it is in, the low bits (the remainder)
are kept sorted within the run, and a count says how often it came. Two filters merge without
loss by merging the sorted remainders of each run and adding counts, so all copies of a text
are one entry before anything is shuffled. A fingerprint whose merged count is one is a unique
row; the others go to byte verification, where each text is compared with one text of its
fingerprint, so that even a collision of fingerprints separates different texts.

Defined results: a null text counts as empty; empty texts are copies of each other; a null
doc_id is a document whose id sorts after all others; rows that repeat a doc_id are separate
rows, and of full ties the row of the least row key (file and position) stays; very long texts are
compared whole; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, SPACE, stored, with_row

#: Fingerprints that one merge task is meant to hold, when the number of runs is chosen.
PER_MERGE = 1 << 20
#: Rows of one fingerprint that one task is meant to compare.
PER_SALT = 512


class CountingQuotientFilter:
    """A set of 64-bit fingerprints with counts, in runs of sorted remainders.

    `ends[q]` is where the run of quotient q ends in `remainders` and `counts`.
    """

    def __init__(self, bits: int, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.ends, self.remainders, self.counts = bits, ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From uint64 fingerprints; `bits` of them are the quotient."""
        order = np.argsort(fingerprints, kind="stable")
        sorted_ = fingerprints[order]
        starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
        weights = np.ones(len(sorted_), np.int64) if counts is None else counts[order]
        sums = np.add.reduceat(weights, starts) if len(starts) else np.zeros(0, np.int64)
        return cls._of_sorted(sorted_[starts], bits, sums)

    @classmethod
    def _of_sorted(cls, distinct: np.ndarray, bits: int, counts: np.ndarray) -> CountingQuotientFilter:
        quotients = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        ends = np.cumsum(np.bincount(quotients, minlength=1 << bits))
        return cls(bits, ends, distinct & np.uint64((1 << (64 - bits)) - 1), counts)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, sorted: the filter loses nothing."""
        runs = np.diff(np.r_[0, self.ends])
        return (np.repeat(np.arange(len(runs), dtype=np.uint64), runs) << np.uint64(64 - self.bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Remainders of the other filter go to their places in the sorted runs of this one; counts of
        equals add up. Nothing is sorted again."""
        own, more = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(own, more)
        hit = own[np.minimum(at, len(own) - 1)] == more if len(own) else np.zeros(len(more), bool)
        counts = self.counts.copy()
        counts[at[hit]] += other.counts[hit]
        new = ~hit
        return self._of_sorted(np.insert(own, at[new], more[new]), self.bits, np.insert(counts, at[new], other.counts[new]))

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(quotient, remainders, counts) of every run that is not empty."""
        start = 0
        for q in np.flatnonzero(np.diff(np.r_[0, self.ends])):
            end = int(self.ends[q])
            yield int(q), self.remainders[start:end].tobytes(), self.counts[start:end].tobytes()
            start = end


def merge_all(parts: Iterator[CountingQuotientFilter]) -> CountingQuotientFilter | None:
    """All filters in one. A filter is merged with those of about its size, so that a fingerprint is
    moved as often as the logarithm of their number."""
    held: list[CountingQuotientFilter] = []
    for part in parts:
        held.append(part)
        while len(held) > 1 and len(held[-2].counts) < 2 * len(held[-1].counts):
            last = held.pop()
            held[-1] = held[-1].merge(last)
    while len(held) > 1:
        last = held.pop()
        held[-1] = held[-1].merge(last)
    return held[0] if held else None


def _build(bits: int):
    def build(batches):
        """One filter per partition: batches are condensed first, then merged."""
        whole = merge_all(CountingQuotientFilter.build(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits) for b in batches)
        runs = list(whole.runs()) if whole is not None else []
        for at in range(0, len(runs), 1024):
            q, r, c = zip(*runs[at : at + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], names=["q", "remainders", "counts"])

    return build


def _merge(bits: int):
    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merge all runs of one quotient, a batch at a time; memory holds the distinct ones."""

        def parts():
            for frame in frames:
                counts = np.frombuffer(b"".join(frame.counts), np.int64)
                yield CountingQuotientFilter.build(np.frombuffer(b"".join(frame.remainders), np.uint64), 1, counts)

        q, whole = int(key[0]), merge_all(parts())
        several = whole.counts > 1
        fingerprints, counts = whole.fingerprints()[several], whole.counts[several]
        full = (fingerprints | np.uint64((q << (64 - bits)) & (2**64 - 1))).view(np.int64)
        yield pd.DataFrame({"fp": full, "n": counts})

    return merge


def repeated_fingerprints(slim: DataFrame, rows: int, column: str = "fp") -> DataFrame:
    """(fp, n) of every fingerprint that more than one row has, by merged filters."""
    bits = min(20, max(6, (rows // PER_MERGE).bit_length() + 6))
    runs = slim.select(column).mapInArrow(_build(bits), "q int, remainders binary, counts binary")
    return runs.groupBy("q").applyInPandas(_merge(bits), "fp bigint, n bigint")


def normalised(text):
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the carried columns.

    Texts are equal when they are identical without white space. Of equal texts the row with
    the most code points stays, then the smallest id.
    """
    base = with_row(docs).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.col(ROW).alias("rid"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    base = base.withColumn("norm", normalised(F.col("body"))).withColumn("fp", F.xxhash64("norm"))
    carried = [f"carry_{c}" for c in carry]
    slim = stored(
        base.select("doc_id", "rid", "fp", F.char_length("body").alias("n"), F.sha2("norm", 256).alias("sha"), *carried), "dedup-slim"
    )
    repeated = stored(repeated_fingerprints(slim, slim.count()), "dedup-repeated")
    # the rows of a frequent fingerprint are dealt out by salts, and each salt gets the text to compare with
    salts = F.ceil(F.col("n") / PER_SALT)
    suspects = base.select("rid", "fp", "norm").join(repeated.select("fp", salts.alias("salts")), "fp")
    suspects = suspects.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")))
    first = suspects.groupBy("fp", "salt", "salts").agg(F.min_by(F.col("norm"), F.col("rid")).alias("first"), F.min("rid").alias("rid"))
    first = first.groupBy("fp", "salts").agg(F.min_by("first", "rid").alias("first"))
    first = first.select("fp", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    # a text that differs from the first of its fingerprint is a class of its own bytes
    checked = stored(
        suspects.join(first, ["fp", "salt"]).select("rid", "fp", F.when(F.col("norm") != F.col("first"), F.col("norm")).alias("other")), "dedup-checked"
    )
    rows = stored(checked.join(slim.drop("fp"), "rid"), "dedup-rows")
    best = rows.groupBy("fp", "other").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best"),
    )
    best = best.select(F.col("fp").alias("b_fp"), F.col("other").alias("b_other"), "group_size", "best")
    several = rows.join(best, (F.col("fp") == F.col("b_fp")) & F.col("other").eqNullSafe(F.col("b_other")))
    several = several.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"), *carried
    )
    single = slim.join(repeated.select("fp"), "fp", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), *carried
    )
    return several.unionByName(single).withColumnsRenamed({f"carry_{c}": c for c in carry})
