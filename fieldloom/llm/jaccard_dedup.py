"""Near copies by the Jaccard similarity of word shingles, found by MinHash and verified exactly.

Rows with the same set of shingles are one node from the start. A node has `BANDS` keys, each the
hash of `DEPTH` minima of its shingles, and nodes that share a key are a crowd: two of similarity
s share none with a chance of (1 - s^DEPTH)^BANDS, which is 5e-8 at 0.8. The first of a crowd is
compared with all others; what is left of a crowd of at most `FRONT` others is compared in pairs.
Larger crowds that are not yet connected may be edits of one text that are close to few others, so
they never meet in pairs. Their shingles are told apart: those of more than `RARE` such nodes are
common. Two nodes that are linked either share a rare shingle, and then they meet by it, or their
sizes alone say in how many common shingles they may differ at most (`_slack`). Nodes with the same
common shingles need one of them, the smallest, as the others are linked to less; those that are
left are cut into one part of the common shingles more than may differ, and two linked ones agree
on a whole part. Within a part a few are compared with all others first, then 64 times as many in
each round, only those that are not yet connected. Every link is verified on the sets.

Defined results: a null text counts as empty; texts without words are copies of each other; a text
with fewer words than a shingle has one shingle, the whole sequence; a null id never is the
smallest unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW, stored
from ._components import components
from .simhash import shingle_hashes

BANDS, DEPTH = 32, 4
#: A crowd with at most so many nodes beside its first is compared in pairs; of a part so many are compared with all others first.
FRONT = 8
#: Open nodes that may hold a rare shingle.
RARE = 16
_FACTORS = np.random.default_rng(42).integers(0, 2**64, BANDS * DEPTH, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), width))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles as signed longs; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _FACTORS).min(axis=0))
    least = least.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; one of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = [band_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rid", "doc_id", "same", "keys"]
            )

    return run


def _verify(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            close = pa.array([similarity(shingle_set(s, width), shingle_set(t, width)) >= least - 1e-9 for s, t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(close)

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "size", "shingles"])

    return run


def _slack(size, common, least: float):
    """Two nodes without a shared rare shingle are linked if and only if the common shingles that one
    of them lacks are no more than the sum of their slacks."""
    return common - 2 * least / (1 + least) * size


def _parts(least: float):
    """For each number of differing common shingles (a power of two) that a link of the node may have, a key
    of each part of one part more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, levels, keys = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, (size, shared) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = np.array(shared, np.int64).view(np.uint64)
                mixed = (own ^ (own >> np.uint64(29))) * _FACTORS[0]
                # a partner has at most size / least shingles, all of them common
                most = int(_slack(size, len(own), least) + _slack(size / least, size / least, least) + 1e-6)
                level, many = 1, 0
                while level < 2 * most:
                    part = np.zeros(level + 1, np.uint64)
                    np.add.at(part, own % np.uint64(level + 1), mixed)
                    keys.append((part ^ (np.arange(level + 1, dtype=np.uint64) * _FACTORS[1])) * _FACTORS[2])
                    levels.append(np.full(level + 1, level))
                    level, many = 2 * level, many + level + 1
                at.append(np.full(many, k))
            at = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
            counts = pa.array([len(s) for s in batch.column(3).to_pylist()], pa.int64())
            columns = [c.take(at) for c in (batch.column(0), batch.column(1), batch.column(2), counts)]
            columns += [pa.array(np.concatenate(levels)), pa.array(np.concatenate(keys).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "size", "common", "level", "key"])

    return run


def rare_and_common(texts: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(shingle, node): by which nodes meet that can be linked and share a rare shingle; and (node, size,
    shared, whole) of nodes that can be linked by their common shingles alone, with these and a hash of
    them. `texts` has rid and body."""
    key = texts.schema["rid"].dataType.simpleString()
    each = texts.mapInArrow(_shingles(width), f"node {key}, size bigint, shingles array<bigint>").select("node", "size", F.explode("shingles").alias("shingle"))
    held = each.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("held > 1")
    held = stored(held, "jaccard-held")
    nodes = held.groupBy("node").agg(F.first("size").alias("size"), F.count_if(F.col("held") > RARE).alias("common"), F.count(F.lit(1)).alias("several"))
    # linked nodes share `least` of either; so many of these are rare, and all but so many shingles less one hold one of them
    must = F.greatest(F.lit(1), F.ceil(least * F.col("size") - 1e-6) - F.col("common"))
    first = nodes.select("node", (F.col("several") - F.col("common") - must + 1).alias("first")).where("first > 0")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    meets = held.where(F.col("held") <= RARE).withColumn("rank", rank).join(first, "node").where("rank <= first").select("shingle", "node")
    common = held.where(F.col("held") > RARE).groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("shingle")).alias("shared"))
    common = common.where(F.size("shared") >= least * F.col("size") - 1e-6)
    return meets, common.withColumn("whole", F.sha1(F.array_join(F.col("shared").cast("array<string>"), ",")))


def _ordered(a: str, ra: str, b: str, rb: str):
    """A pair, the smaller node first."""
    one, other = (F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(rx).alias("ra"), F.col(ry).alias("rb")) for x, y, rx, ry in ((a, b, ra, rb), (b, a, rb, ra)))
    return F.when(F.col(a) < F.col(b), one).otherwise(other).alias("x")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, is_first) of each row of a table with row keys: one row of each component of near
    copies, the one with the smallest id, is the first."""
    base = docs.select(F.col(ROW).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    key = docs.schema[ROW].dataType.simpleString()
    rows = stored(base.mapInArrow(_sketch(width), f"rid {key}, doc_id {kind}, same binary, keys array<bigint>"), "jaccard-rows")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("low")
    nodes = stored(rows.groupBy("same").agg(low, F.first("keys").alias("keys")).select(F.col("low.rid").alias("node"), "low", "same", "keys"), "jaccard-nodes")
    crowds = nodes.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("all")).where(F.size("all") > 1)
    crowds = crowds.select("all").distinct().withColumn("crowd", F.monotonically_increasing_id())
    members = stored(stored(crowds, "jaccard-crowds").select("crowd", F.posexplode("all").alias("pos", "node")), "jaccard-members")
    texts = base.select("rid", "body").join(members.select(F.col("node").alias("rid")).distinct(), "rid", "left_semi")
    members = members.withColumn("root", F.col("node"))

    def linked(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The roots, once the pairs (x) are verified; what is linked are the components so far."""
        pairs = pairs.select("x.*").distinct().join(texts.toDF("a", "s"), "a").join(texts.toDF("b", "t"), "b").select("ra", "rb", "s", "t")
        merged = components(stored(pairs.mapInArrow(_verify(width, least), f"a {key}, b {key}"), "jaccard-links"), "a", "b")
        if roots is not None:
            again = roots.withColumnRenamed("root", "was").join(merged.withColumnRenamed("node", "was"), "was", "left")
            fresh = merged.join(roots.select("node"), "node", "left_anti")
            merged = again.select("node", F.coalesce("root", "was").alias("root")).unionByName(fresh)
        return stored(merged, "jaccard-roots")

    def still_open(members: DataFrame, roots: DataFrame, at: int) -> DataFrame:
        """The members of crowds that have some to compare and more than one root."""
        left = members.drop("root", "last").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = left.groupBy("crowd").agg(F.max("pos").alias("last"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("last") > at) & (F.col("low") != F.col("high")))
        return stored(left.join(open_.select("crowd", "last"), "crowd"), "jaccard-members")

    def fronts(members: DataFrame, at: int, front: int, *more: str) -> DataFrame:
        """The members of crowds, each with those of the front that come before it and are not yet connected to it."""
        one = members.where((F.col("pos") >= at) & (F.col("pos") < at + front))
        one = one.select("crowd", F.col("pos").alias("p"), F.col("node").alias("other"), F.col("root").alias("was"), *[F.col(c).alias(f"o_{c}") for c in more])
        return members.join(one, "crowd").where("pos > p AND root <> was")

    pair = _ordered("node", "root", "other", "was")
    roots = None
    if not members.isEmpty():
        roots = linked(fronts(members, 0, 1).select(pair), roots)
        members = still_open(members, roots, 1)
    if roots is not None and not members.isEmpty():
        pairs = fronts(members.where(F.col("last") <= FRONT), 1, FRONT).select(pair)
        rooted = members.where(F.col("last") > FRONT).select("node", "root").distinct()
        large = not rooted.isEmpty()
        if large:
            meets, common = rare_and_common(texts.join(rooted.select(F.col("node").alias("rid")), "rid", "left_semi"), width, least)
            common = stored(common, "jaccard-common")
            meets = stored(meets.join(rooted, "node"), "jaccard-meets")
            others = meets.select("shingle", F.col("node").alias("other"), F.col("root").alias("was"))
            pairs = pairs.unionByName(meets.join(others, "shingle").where("node < other AND root <> was").select(pair))
            alike = common.join(rooted, "node").select("whole", "size", "node", "root", F.size("shared").alias("common"))
            top = alike.groupBy("whole").agg(F.min(F.struct("size", "node", "root")).alias("top")).select("whole", F.col("top.size").alias("o_size"), F.col("top.node").alias("other"), F.col("top.root").alias("was"))
            close = _slack(F.col("size") + F.col("o_size"), 2 * F.col("common"), least) >= -1e-6
            pairs = pairs.unionByName(alike.join(top, "whole").where("root <> was").where(close).select(pair))
        roots = linked(pairs, roots)
        if large:
            left = common.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            left = left.groupBy("whole", "root").agg(F.min(F.struct("size", "node", "shared")).alias("top")).select("top.node", "root", "top.size", "top.shared")
            keyed = left.mapInArrow(_parts(least), f"node {key}, root {key}, size bigint, common bigint, level bigint, key bigint")
            slack = _slack(F.col("size"), F.col("common"), least).alias("slack")
            crowds = keyed.groupBy("level", "key").agg(F.sort_array(F.collect_list(F.struct(slack, "node", "root", "size", "common")), asc=False).alias("all"), F.min("root").alias("low"), F.max("root").alias("high"))
            crowds = stored(crowds.where("low <> high").select("level", "all").withColumn("crowd", F.monotonically_increasing_id()), "jaccard-parts")
            members = stored(crowds.select("crowd", "level", F.posexplode("all").alias("pos", "x")).select("crowd", "level", "pos", "x.*"), "jaccard-members")
            may = F.floor(F.col("slack") + F.col("o_slack") + 1e-6)
            at_least = F.least("common", "o_common") >= least / (1 + least) * (F.col("size") + F.col("o_size")) - 1e-6
            at, front = 0, FRONT
            while not members.isEmpty():
                pairs = fronts(members, at, front, "slack", "size", "common").where((may <= F.col("level")) & (2 * may > F.col("level")) & at_least)
                roots = linked(pairs.select(pair), roots)
                at, front = at + front, front * FRONT * FRONT
                members = still_open(members, roots, at)
    labelled = nodes.select("node", "low", "same").withColumn("root", F.col("node"))
    if roots is not None:
        labelled = nodes.select("node", "low", "same").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = labelled.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.rid").alias("rid"), F.lit(True).alias("hit"))
    return rows.select("rid").join(first, "rid", "left").select(F.col("rid").alias(ROW), F.col("hit").isNotNull().alias("is_first"))
