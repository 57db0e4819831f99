"""SimHash near-deduplication with pigeonhole blocks.

A fingerprint is cut into m blocks of bits. Two fingerprints that differ in at most d bits
agree on at least m - d whole blocks, so joining on every choice of m - d blocks misses no
pair; the join is one shuffle of (mask, masked value) keys, and within a key the Hamming
distance is verified. m follows the number of distinct fingerprints, so that a key is shared
by about one of them by chance; every m finds the same links.

Equal fingerprints are one node from the start, so exact copies never meet in pairs. A key
that still holds more than `LIMIT` fingerprints is split again: all its members agree on the
mask, hence two that are close agree on at least one of d + 1 parts of the other bits, and the
key is replaced by d + 1 longer keys for each member. That is exact and ends at the latest
where the mask covers all bits. From one key only spanning links come out, never all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero, one
with fewer than three words has one shingle, the whole sequence; a null id never is the
smallest unless all are null; repeated rows are rows of the same component; very long
texts are hashed whole, in parts; fingerprints at the same distance are all linked; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, stored
from ._components import components

#: Fingerprints that one key may hold before it is split; at most this many are compared pairwise.
LIMIT = 2048
SEED = 42


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles of a UTF-8 text, repeats included."""
    words = text.lower().split()  # on bytes, both are for ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (np.r_[0, ends[:-1]][: len(words) - width + 1]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _fingerprints(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            found = np.fromiter((simhash(shingle_hashes(t.as_py() or b"", width)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, rid, carried columns, fp): the fingerprint of every row as a signed long."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("rid"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
        F.col(text_col).cast("string").alias("body"),
    )
    out = base.drop("body").withColumn("fp", F.lit(0).cast("long"))
    from pyspark.sql.pandas.types import to_arrow_schema

    return base.mapInArrow(_fingerprints(width, to_arrow_schema(out.schema)), out.schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` groups of the given bits; groups may be empty where bits are few."""
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def block_masks(nodes: int, distance: int) -> list[int]:
    """Masks of all choices of m - distance blocks; m grows until keys are rarely shared by chance."""
    for m in range(distance + 1, 17):
        masks = [sum(c) for c in combinations(_cut(list(range(64)), m), m - distance)]
        if len(masks) * nodes <= 2 * 2 ** (64 * (m - distance) // m):
            break
    return masks


def split_masks(mask: int, distance: int) -> list[int]:
    """Longer masks, one of which any two close members of a key of this mask still share."""
    free = [b for b in range(64) if not mask >> b & 1]
    return sorted({mask | part for part in _cut(free, distance + 1)} - {mask}) or [mask]


def _links(distance: int):
    def link(values: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spanning links of the fingerprints of one key."""
        left = np.ones(len(values), bool)
        while left.any():
            front = np.flatnonzero(left)[:1]
            left[front] = False
            while len(front):
                reached = []
                for f in front:
                    near = np.flatnonzero(left & (np.bitwise_count(values ^ values[f]) <= distance))
                    left[near] = False
                    reached.append(near)
                    for x in near:
                        yield int(f), int(x)
                front = np.concatenate(reached)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a key that a batch cuts is carried into the next."""
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            masks, keys, values = (frame[c].to_numpy() for c in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])])
            rest = frame.iloc[starts[-1] :]
            yield from groups(starts, values.view(np.uint64), int(starts[-1]))
        if rest is not None:
            values = rest["fp"].to_numpy().view(np.uint64)
            yield from groups(np.array([0, len(values)]), values, len(values))

    def groups(starts: np.ndarray, values: np.ndarray, end: int) -> Iterator[pd.DataFrame]:
        sizes = np.diff(np.r_[starts, end]) if starts[-1] != end else np.diff(starts)
        a, b = [], []
        pairs = starts[: len(sizes)][sizes == 2]
        near = pairs[np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= distance]
        a.append(values[near])
        b.append(values[near + 1])
        for s, n in zip(starts[: len(sizes)][sizes > 2], sizes[sizes > 2]):
            own = values[s : s + n]
            found = np.array(list(link(own)), np.int64).reshape(-1, 2)
            a.append(own[found[:, 0]])
            b.append(own[found[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def close_links(nodes: DataFrame, count: int, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that span all pairs within the distance."""
    spark = nodes.sparkSession
    masks = sorted(set(block_masks(count, distance)))
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    links = None
    while True:
        crowded = stored(keyed.groupBy("mask", "key").count().where(F.col("count") > LIMIT).drop("count"), "simhash-crowded")
        here = sorted(r[0] & (2**64 - 1) for r in crowded.select("mask").distinct().collect())  # masks, at most a few hundred
        small = keyed.join(crowded, ["mask", "key"], "left_anti") if here else keyed
        placed = small.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")
        found = placed.mapInPandas(_links(distance), "a bigint, b bigint")
        links = found if links is None else links.union(found)
        if not here:
            return links
        longer = spark.createDataFrame([(_signed(m), [_signed(x) for x in split_masks(m, distance)]) for m in here], "mask bigint, longer array<bigint>")
        keyed = keyed.join(crowded, ["mask", "key"], "left_semi").join(F.broadcast(longer), "mask")
        keyed = keyed.select("fp", F.explode("longer").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = stored(keyed.distinct(), "simhash-split")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id, the
    first flag `is_first` (one row of each component has it) and the carried columns."""
    slim = stored(fingerprints(docs, id_col, text_col, width, carry), "simhash-rows")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("low")
    nodes = stored(slim.groupBy("fp").agg(lowest), "simhash-nodes")
    roots = components(close_links(nodes.select("fp"), nodes.count(), distance), "a", "b")
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = stored(nodes, "simhash-labelled")
    least = nodes.groupBy("root").agg(F.min("low").alias("least"))
    nodes = nodes.join(least, "root").select("fp", "least")
    out = slim.join(nodes, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        (F.col("rid") == F.col("least.rid")).alias("is_first"),
        *[f"carry_{c}" for c in carry],
    )
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})
