"""Pixel neighbourhoods by windows over rows and columns of a tile, and per-segment statistics.

All windows are partitioned by tile and row or tile and column, which one tile bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def down_rows():
    return Window.partitionBy("tile", "c").orderBy("r")


def along_columns():
    return Window.partitionBy("tile", "r").orderBy("c")


def boundary(px: DataFrame, label: str, name: str) -> DataFrame:
    """Thick boundary: any 4-neighbour in the tile has another label (null is a label)."""
    own = F.coalesce(F.col(label), F.lit(-1))
    moved = [f(own, 1).over(w) for f in (F.lag, F.lead) for w in (down_rows(), along_columns())]
    differs = [F.coalesce(m != own, F.lit(False)) for m in moved]
    return px.withColumn(name, differs[0] | differs[1] | differs[2] | differs[3])


def dilated(px: DataFrame, mask: str, name: str, size: int = 3) -> DataFrame:
    """Dilation of a boolean mask by a square, a maximum over rows and then columns.

    A square of even size has no middle: it reaches one step further up and left than down and
    right, so size 2 looks at a pixel, the one above, the one to the left and the one between."""
    before, after = size // 2, (size - 1) // 2
    along = F.max(F.col(mask).cast("int")).over(down_rows().rowsBetween(-before, after))
    return px.withColumn("__rows", along).withColumn(name, F.max("__rows").over(along_columns().rowsBetween(-before, after)) > 0).drop("__rows")


def field_mask(px: DataFrame, label: str, name: str) -> DataFrame:
    """Fields and the pixels next to them: where agricultural land is, with its outer boundaries."""
    return dilated(px.withColumn("__field", F.coalesce(F.col(label) > 0, F.lit(False))), "__field", name).drop("__field")


def padded_edge(px: DataFrame, mask: Column, last: int, name: str) -> DataFrame:
    """Set the border of a tile to one."""
    return px.withColumn(name, F.when(F.col("r").isin(0, last) | F.col("c").isin(0, last), 1).otherwise(mask.cast("int")))


def moving_std(px: DataFrame, values: list[str], size: int, last: int, names: list[str]) -> DataFrame:
    """Standard deviations over size x size windows with reflected edges (the edge sample not repeated).

    Reflected rows and columns are added, counts and sums run over rows and then columns of a grid
    that every tile fills, and the additions are dropped. Places that a tile lacks do not count, so
    a partial tile has the deviation of the pixels that are there."""
    k = size // 2

    def reflected(df: DataFrame, at: str) -> DataFrame:
        here = F.col(at)
        places = [F.when((here >= 1) & (here <= k), -here), here, F.when((here < last) & (here >= last - k), 2 * last - here)]
        return df.withColumn(at, F.explode(F.array_compact(F.array(*places))))

    sums = [f"{kind}{n}" for n in range(len(values)) for kind in ("x", "xx")] + ["n"]
    wide = reflected(reflected(px.select("tile", "r", "c", *[F.col(v).cast("double").alias(f"x{n}") for n, v in enumerate(values)]), "r"), "c")
    wide = wide.withColumns({f"xx{n}": F.col(f"x{n}") * F.col(f"x{n}") for n in range(len(values))}).withColumn("n", F.lit(1.0))
    side = F.sequence(F.lit(-k).cast("long"), F.lit(last + k).cast("long"))
    empty = px.select("tile").distinct().withColumn("r", F.explode(side)).withColumn("c", F.explode(side))
    wide = wide.unionByName(empty.select("*", *[F.lit(0.0).alias(c) for c in sums])).groupBy("tile", "r", "c").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("here", F.col("n") > 0)
    wide = wide.repartition("tile")
    for w in (down_rows(), along_columns()):
        wide = wide.withColumns({c: F.sum(c).over(w.rowsBetween(-k, k)) for c in sums})
    inside = wide.where(F.col("here") & F.col("r").between(0, last) & F.col("c").between(0, last))
    spread = lambda n: F.sqrt(F.greatest(F.col(f"xx{n}") / F.col("n") - F.pow(F.col(f"x{n}") / F.col("n"), 2), F.lit(0.0)))
    return inside.select("tile", "r", "c", *[spread(n).alias(name) for n, name in enumerate(names)])


def adjacent_pairs(px: DataFrame, label: str) -> DataFrame:
    """(tile, a, b), a < b: labels that share a pixel edge."""
    own = F.col(label)
    sides = px.where(own.isNotNull()).select("tile", "r", "c", own.alias("own"))
    right = sides.select("tile", "r", (F.col("c") - 1).alias("c"), F.col("own").alias("other"))
    down = sides.select("tile", (F.col("r") - 1).alias("r"), "c", F.col("own").alias("other"))
    pairs = sides.join(right.unionByName(down), ["tile", "r", "c"]).where("own <> other")
    return pairs.select("tile", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def neighbour_statistics(pairs: DataFrame, stats: DataFrame, value: str) -> DataFrame:
    """(tile, label, nb_count, nb_mean, nb_std): mean and sample deviation of a value over adjacent labels; null counts as zero."""
    both = pairs.union(pairs.select("tile", "b", "a")).toDF("tile", "label", "other")
    joined = both.join(stats.select("tile", F.col("label").alias("other"), F.col(value).alias("x")), ["tile", "other"])
    n, s, ss = F.count("x"), F.sum("x"), F.sum(F.col("x") * F.col("x"))
    spread = F.sqrt(F.greatest((ss - s * s / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))
    return joined.groupBy("tile", "label").agg(n.alias("nb_count"), F.coalesce(F.avg("x"), F.lit(0.0)).alias("nb_mean"), F.coalesce(spread, F.lit(0.0)).alias("nb_std"))


def entropy(df: DataFrame, group: list[str], value: Column, bins: int = 100, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Entropy of a histogram with the last bin closed; values out of range do not count."""
    place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    counts = df.where(value.between(low, high)).groupBy(*group, place.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    return total.select(*group, (F.ln("total") - F.col("nln") / F.col("total")).alias("entropy"))


def without_small(px: DataFrame, label: str, least: int) -> DataFrame:
    """Labels with fewer pixels than `least` become null; a label with as many stays."""
    size = F.count("*").over(Window.partitionBy("tile", label))
    return px.withColumn(label, F.when(size >= least, F.col(label)))
