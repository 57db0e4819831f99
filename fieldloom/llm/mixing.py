"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents is to be taken
target / source size times, a whole part that is sure and a fractional part that is drawn. The
draw is pivotal: two documents meet and one passes words of its fraction to the other, at
random so that expectations stay, until one fraction is 0 or 1. As words are passed, not
fractions, a source's sum of taken words changes at no step, and only the very last document
of a source is rounded alone.

The pairs form a reduction tree. In every round the documents that still have a fraction are
dealt by hash into buckets of about `FAN` within their source; a bucket folds to decided
documents and one residual; the residuals are the next round. A source with any number of
documents is thus spread over all tasks, and rounds grow with the logarithm of its documents.
All of it is DataFrame expressions. Every random number is a hash of ids and a seed, so runs
agree whatever the partitions are.

Defined results: a null text has size zero; a null source is a source of its own, after all
others; documents of size zero give no words and are drawn by themselves; repeated rows are
separate documents, and alike ones may be drawn in place of each other; very long texts count whole; a table without words gets targets of zero; an empty table an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, stored

#: Documents that a bucket of the reduction tree holds on average.
FAN = 64


def word_count(text: Column) -> Column:
    """Number of words of a text, zero for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    The targets share `share` times all words by weight and stop at `cap` times their source;
    what is above is shared again among the others until none is above.
    """
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # a distributed rank: sort by range, count within each range, and add the counts before it
    ranged = totals.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "mix-ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    ranked = ranged.withColumn("inside", inside).join(offsets.drop("rows"), "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("inside") + F.col("offset")) % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("limit")), "mix-weights")
    all_words, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (share * all_words / all_weights if all_words else 0.0), -1
    while True:
        above = F.col("weight") * level > F.col("limit")
        now, words, free = ranked.agg(
            F.count_if(above), F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if now in (capped, None) or not free:
            break
        capped, level = now, (share * all_words - words) / free
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, F.col("limit")).alias("target"))


def _uniform(*columns: str) -> str:
    """A number in [0, 1) from a hash of SQL expressions."""
    return f"((xxhash64({', '.join(columns)}) & 9007199254740991) / 9007199254740992D)"


#: One step of a fold: the carried document c meets the next one e. `up` words can go from e to c
#: and `down` words from c to e before one of the fractions is 0 or 1.
_STEP = """
aggregate(
  slice(units, 2, size(units)),
  named_struct('c', units[0], 'done', filter(transform(units, x -> named_struct('unit', x, 'take', 0)), x -> false)),
  (s, e) -> transform(array(named_struct(
      'c', s.c, 'e', e, 'done', s.done,
      'up', least((1 - s.c.p) * s.c.size, e.p * e.size), 'down', least(s.c.p * s.c.size, (1 - e.p) * e.size))),
    x -> transform(array(named_struct(
      'x', x, 'rise', x.up + x.down > 0 AND {uniform} * (x.up + x.down) < x.down)),
    y -> CASE
      WHEN y.rise AND (1 - y.x.c.p) * y.x.c.size <= y.x.e.p * y.x.e.size THEN named_struct(
        'c', {e_less}, 'done', array_append(y.x.done, named_struct('unit', y.x.c, 'take', 1)))
      WHEN y.rise THEN named_struct(
        'c', {c_more}, 'done', array_append(y.x.done, named_struct('unit', y.x.e, 'take', 0)))
      WHEN y.x.c.p * y.x.c.size <= (1 - y.x.e.p) * y.x.e.size THEN named_struct(
        'c', {e_more}, 'done', array_append(y.x.done, named_struct('unit', y.x.c, 'take', 0)))
      ELSE named_struct(
        'c', {c_less}, 'done', array_append(y.x.done, named_struct('unit', y.x.e, 'take', 1)))
    END)[0])[0])
"""


def _fold(kept: list[str], seed: int) -> str:
    """SQL that folds the array `units` of structs(size, h, p, kept columns)."""

    def moved(which: str, delta: str) -> str:
        u = f"y.x.{which}"
        fields = ", ".join(f"'{k}', {u}.{k}" for k in kept)
        return f"named_struct('size', {u}.size, 'h', {u}.h, 'p', least(1D, greatest(0D, {u}.p {delta} / {u}.size)){', ' + fields if fields else ''})"

    return _STEP.format(
        uniform=_uniform("x.c.h", "x.e.h", str(seed)),
        e_less=moved("e", "- y.x.up"), c_more=moved("c", "+ y.x.up"), e_more=moved("e", "+ y.x.down"), c_less=moved("c", "- y.x.down"),
    )


def pivotal_round(units: DataFrame, group: str, kept: list[str], seed: int = 7) -> DataFrame:
    """Round the fractions `p` of units of positive `size` to 0 or 1 within each group.

    `units` has the group, h (a hash that tells units apart), p, size and the kept columns; the
    result has the group, size, the kept columns and `take`. Large units are folded first, so
    that the one left at the end, whose rounding nothing makes up for, is a small one.
    """
    names = ["size", "h", "p", *kept]
    decided, round_ = None, 0
    units = stored(units.select(group, *names), "mix-units")
    while True:
        counts = units.groupBy(group).agg(F.count("*").alias("members"))
        most = counts.agg(F.max("members")).first()[0] or 0
        if most <= 1:
            break
        buckets = F.ceil(F.col("members") / FAN)
        dealt = units.join(counts.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group")))
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(seed + round_)), buckets))
        folded = dealt.groupBy(group, "bucket").agg(F.sort_array(F.collect_list(F.struct(*names)), asc=False).alias("units"))
        folded = stored(folded.select(group, F.expr(_fold(kept, seed + round_)).alias("s")), "mix-round")
        done = folded.select(group, F.explode("s.done").alias("d")).select(group, "d.unit.size", *[F.col(f"d.unit.{k}").alias(k) for k in kept], F.col("d.take").alias("take"))
        decided = done if decided is None else decided.unionByName(done)
        units = folded.select(group, *[F.col(f"s.c.{k}").alias(k) for k in names])
        round_ += 1
    last = units.select(group, "size", *kept, F.expr(f"CAST({_uniform('h', str(seed - 1))} < p AS INT)").alias("take"))
    return last if decided is None else decided.unionByName(last)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5, cap: float = 2.0, seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, carried columns."""
    carried = [f"carry_{c}" for c in carry]
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("content"), *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized, weights, share, cap)
    # rows that are alike are told apart by a running number, which may go to any of them
    # (without an id they are alike only if their texts are; without words it makes no difference which is which)
    again = F.row_number().over(Window.partitionBy("doc_id", "source", "size", "content").orderBy(*(carried or [F.lit(0)])))
    told = sized.where("size > 0").withColumn("again", again).unionByName(sized.where("size = 0").withColumn("again", F.lit(1)))
    rated = told.withColumn("h", F.xxhash64("doc_id", "source", "size", "content", "again", F.lit(seed))).drop("content", "again")
    rated = rated.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12))
    rated = rated.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = stored(rated, "mix-rated")
    kept = ["doc_id", "source_size", "target", "whole", *carried]
    drawn = (F.col("size") > 0) & (F.col("p") > 1e-12)
    rounded = pivotal_round(rated.where(drawn), "source", kept, seed)
    alone = rated.where(~drawn).select("source", "size", *kept, F.expr(f"CAST({_uniform('h', str(seed - 1))} < p AND p > 1e-12 AS INT)").alias("take"))
    out = rounded.unionByName(alone).withColumn("copies", F.col("whole") + F.col("take"))
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})
