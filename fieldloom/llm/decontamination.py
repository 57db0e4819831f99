"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity of whole sets says nothing; what counts
is the share of an item's word shingles that a document contains. The items are partitioned by
the number s of their distinct shingles (powers of two), and each partition has its own MinHash
sketch size k: the sketch of an item is the k smallest hashes of its shingles. A document that
contains a share t of the item misses at most floor((1 - t) s) shingles, hence at least
k - floor((1 - t) s) of any k of them are in it; k is chosen so that this is a few. Every pair
with that many sketch hits is a candidate, so no pair is lost, and candidates are then verified
by exact containment of the shingles as text.

A sketch is small whatever the corpus is. It is broadcast if its measured size is under
`BROADCAST_BYTES`, and joined by shuffle otherwise.

Defined results: a null text counts as empty; an item without words matches nothing; an item of
fewer than `width` words is one shingle, searched as that many consecutive words; repeated rows
are searched each; equal items are found each; very long texts are searched whole; either table may
be empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ROW, SPACE, stored, with_row

#: Most bytes of item shingles that are broadcast: their texts, and this much for the rest of a row.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Sketch hits that are asked for, where an item has that many shingles.
HITS = 4


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), SPACE)


def _hash(at: str, width: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'wh[{at} + {k}]' for k in range(width))})")


def _shingles(rows: DataFrame, width: int, with_text: bool) -> DataFrame:
    """Explode the words `w` of rows to hashes `h` of shingles, with repeats; with their text too if asked."""
    hashed = rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).where(F.size("w") >= width)
    at = F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("at")
    if with_text:
        return hashed.select("*", at).withColumn("h", _hash("at", width)).drop("wh")
    return hashed.drop("w").select("*", F.explode(F.sequence(F.lit(0), F.size("wh") - width)).alias("at")).withColumn("h", _hash("at", width)).drop("wh", "at")


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 5, threshold: float = 0.8, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document and item whose containment reaches the threshold: doc_id, item_id,
    item_shingles, shared_shingles, containment and the carried columns."""
    carried = [f"carry_{c}" for c in carry]
    listed = items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("item"), _words(F.col(item_text_col)).alias("w"))
    listed = stored(listed.where(F.element_at("w", 1) != "").withColumn("width", F.least(F.lit(width), F.size("w"))), "decon-items")
    widths = [r[0] for r in listed.select("width").distinct().orderBy("width").collect()]  # at most `width` numbers
    base = with_row(docs).select(
        F.col(id_col).alias("doc_id"),
        F.col(ROW).alias("rid"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
        _words(F.col(text_col)).alias("w"),
    )
    found = None
    for one in widths or [width]:
        part = _contained(base, listed.where(F.col("width") == one).drop("width"), one, threshold, carried)
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({f"carry_{c}": c for c in carry})


def _contained(base: DataFrame, listed: DataFrame, width: int, threshold: float, carried: list[str]) -> DataFrame:
    text = F.array_join(F.slice("w", F.col("at") + 1, width), " ").alias("shingle")
    full = stored(_shingles(listed, width, True).select("item", "item_id", "h", text).distinct(), "decon-shingles")
    sizes = full.groupBy("item", "item_id").agg(F.count("*").alias("s"), F.sort_array(F.collect_list("h")).alias("hs"))
    slack = F.floor((1 - threshold) * F.col("s") + 1e-9).cast("int")
    largest = F.pow(F.lit(2), F.floor(F.log2("s")) + 1) - 1  # of the item's size partition
    k = F.least(F.col("s"), F.floor((1 - threshold) * largest + 1e-9) + HITS).cast("int")
    sizes = sizes.withColumn("needed", k - slack).withColumn("sketch", F.slice("hs", F.lit(1), k)).drop("hs")
    sizes = stored(sizes, "decon-sketches")
    sketch = sizes.select("item", "needed", F.explode("sketch").alias("h"))
    size = full.agg(F.coalesce(F.sum(F.octet_length("shingle") + ROW_BYTES), F.lit(0))).first()[0]
    hits = _shingles(base.select("rid", "w"), width, False).join(_bounded(sketch, size), "h")
    # the same shingle may come often in a document; a row for each is merged before the shuffle
    hits = hits.groupBy("rid", "item", "needed", "h").agg(F.lit(1).alias("one")).groupBy("rid", "item", "needed").agg(F.count("*").alias("hits"))
    candidates = stored(hits.where("hits >= needed").select("rid", "item"), "decon-candidates")
    suspects = base.join(candidates.select("rid").distinct(), "rid", "left_semi")
    shared = _shingles(suspects, width, True).select("rid", "doc_id", *carried, "h", text)
    shared = shared.join(_bounded(full, size), ["h", "shingle"]).join(candidates, ["rid", "item"], "left_semi")
    shared = shared.groupBy("rid", "item", "item_id", "h", "shingle").agg(*[F.first(c).alias(c) for c in ("doc_id", *carried)])
    shared = shared.groupBy("rid", "item", "item_id").agg(F.count("*").alias("shared_shingles"), *[F.first(c).alias(c) for c in ("doc_id", *carried)])
    shared = shared.join(sizes.select("item", "s"), "item").withColumn("containment", F.col("shared_shingles") / F.col("s"))
    shared = shared.where(F.col("shared_shingles") >= F.ceil(threshold * F.col("s") - 1e-9))
    return shared.select("doc_id", "item_id", F.col("s").alias("item_shingles"), "shared_shingles", "containment", *carried)
