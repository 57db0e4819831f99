"""Dataset curation: quality filters, group thresholds, crosstabs, normalising, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import row_sum


def quality_filter(fields: DataFrame, min_area: float, classes: list[str], most: float) -> DataFrame:
    """Fields over an area whose sum over given classes (null: zero) stays at or under a bound."""
    return fields.where((F.col("area") > min_area) & (row_sum(*classes) <= most))


def tile_thresholds(fields: DataFrame, min_share: float, min_fields: int) -> DataFrame:
    """Tiles whose agricultural share and number of fields reach bounds: one aggregation, one having."""
    tiles = fields.groupBy("tile_id").agg(F.count("*").alias("n_fields"), (F.coalesce(F.sum("agri"), F.lit(0.0)) / F.sum("area")).alias("agri_share"))
    return tiles.where((F.col("agri_share") >= min_share) & (F.col("n_fields") >= min_fields))


def crosstab(df: DataFrame, zone: list[str], value: Column, classes: list) -> DataFrame:
    """Counts of a fixed list of classes by zone; absent classes are null."""
    return df.groupBy(*zone).agg(*[F.nullif(F.count_if(value == k), F.lit(0)).alias(f"n_{k}") for k in classes])


def mode_smallest(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value by group, the smallest on a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("best"))
    return best.select(*group, (-F.col("best.v")).alias("mode"), F.col("best.n").alias("n"))


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """An indicator column for each of the given values."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def scaled(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Min-max ('minmax') or sample z-score ('zscore') over the whole table, by one aggregation of a few scalars."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        low, size = (F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")) if how == "minmax" else (F.col(f"avg_{c}"), F.col(f"std_{c}"))
        out = out.withColumn(c, F.when(size != 0, (F.col(c) - low) / size))
    return out.select(*df.columns)


def seeded_sample(df: DataFrame, key: str, seeds: list[int], n: int) -> DataFrame:
    """n rows per seed without replacement, in the order of a mixing hash of key and seed.

    One scan whatever the seeds: each row is repeated for them, and a window that is cut at a place
    keeps n rows a seed in each task before anything is shuffled."""
    again = df.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(mixed, key))
    return again.withColumn("place", place).where(F.col("place") <= n)


def group_folds(df: DataFrame, group: str, folds: int, repeats: int) -> DataFrame:
    """Folds that keep groups whole, for each repeat, by a mixing hash: no shuffle, sizes follow chance.
    (`relational.balanced_group_folds` deals by size.)"""
    again = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    mixed = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col("repeat").cast("string")))
    return df.select("*", again).withColumn("fold", F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long") % folds)


def nearest(points: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """Join points (x, y) to the values of their grid cells."""
    keys = {"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}
    return points.withColumns(keys).join(cells, ["cx", "cy"], "left")


def knn_distances(samples: DataFrame, others: DataFrame, id_: str, other_id: str, vector: str, k: int, by: list[str], blocks: int = 16) -> DataFrame:
    """Squared distance to the k-th nearest other vector within each group; itself is not counted.

    Samples, a stated query set, are dealt into blocks, and the others meet every block, so no key
    holds all pairs of a group. Each task keeps the k smallest distances of a sample."""
    a = samples.withColumn("block", F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")).alias("a")
    b = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("b")
    pairs = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "block"]])
    d = F.aggregate(F.zip_with(f"a.{vector}", f"b.{vector}", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.where(F.col(f"a.{id_}") != F.col(f"b.{other_id}")).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{id_}").alias(id_), d.alias("d2"))
    if k == 1:
        return pairs.groupBy(*by, id_).agg(F.min("d2").alias("d2"))
    place = F.row_number().over(Window.partitionBy(*by, id_).orderBy("d2"))
    return pairs.withColumn("place", place).where(F.col("place") == k).drop("place")
