"""Shape properties of labelled regions as aggregations over pixel rows.

Sums of powers of coordinates, 2 x 2 patterns and rims are all groupings by (tile, label), so a
region of any size is combined map-side, and no tile is ever held in memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ["tile", "label"]


def labelled(px: DataFrame, label: str) -> DataFrame:
    """(tile, label, r, c) of the pixels that have the label."""
    return px.where(F.col(label).isNotNull()).select("tile", F.col(label).alias("label"), "r", "c")


def _spread(px: DataFrame, steps: dict[tuple[int, int], int]) -> DataFrame:
    """(tile, label, r, c, code): each pixel adds a code to the places that it reaches by the steps."""
    reach = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for (a, b), k in steps.items()])).alias("s")
    moved = px.select(*_KEY, "r", "c", reach).select(*_KEY, (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("s.k").alias("k"))
    return moved.groupBy(*_KEY, "r", "c").agg(F.sum("k").alias("code"))


def moments(px: DataFrame) -> DataFrame:
    """(tile, label, area, row, col, mu_pq): centroid and central moments up to the third order.

    Coordinates are whole numbers, so the raw sums are exact and one aggregation is enough."""
    powers = [(p, q) for p in range(4) for q in range(4) if 0 < p + q <= 3]
    raw = px.groupBy(*_KEY).agg(F.count("*").alias("area"), *[F.sum((F.pow("r", F.lit(p)) * F.pow("c", F.lit(q))).cast("double")).alias(f"m_{p}{q}") for p, q in powers])
    row, col = F.col("m_10") / F.col("area"), F.col("m_01") / F.col("area")
    m = {(p, q): F.col(f"m_{p}{q}") for p, q in powers} | {(0, 0): F.col("area").cast("double")}

    def central(p: int, q: int) -> Column:
        """By the binomial theorem."""
        terms = [math.comb(p, i) * math.comb(q, j) * F.pow(-row, F.lit(p - i)) * F.pow(-col, F.lit(q - j)) * m[i, j] for i in range(p + 1) for j in range(q + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return raw.select(*_KEY, "area", row.alias("row"), col.alias("col"), *[central(p, q).alias(f"mu_{p}{q}") for p, q in powers if p + q > 1])


def hu_moments(px: DataFrame) -> DataFrame:
    """(tile, label, hu_1 .. hu_7): Hu's invariants of scaled central moments."""
    out = moments(px)
    e = {(p, q): F.col(f"mu_{p}{q}") / F.pow(F.col("area").cast("double"), F.lit(1 + (p + q) / 2)) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, b = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3]
    u, v, d = e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3], e[2, 0] - e[0, 2]
    ta, tb = a * a - 3 * b * b, 3 * a * a - b * b
    hu = [e[2, 0] + e[0, 2], d * d + 4 * e[1, 1] * e[1, 1], u * u + v * v, a * a + b * b, u * a * ta + v * b * tb, d * (a * a - b * b) + 4 * e[1, 1] * a * b, v * a * ta - u * b * tb]
    return out.select(*_KEY, *[h.alias(f"hu_{k + 1}") for k, h in enumerate(hu)])


def axes(px: DataFrame) -> DataFrame:
    """(tile, label, area, axis_major, axis_minor, eccentricity) of the ellipse with the region's second
    moments; a pixel counts as a unit square, hence the twelfth."""
    n = F.col("area")
    a, b, d = F.col("mu_20") / n + 1 / 12, F.col("mu_02") / n + 1 / 12, F.col("mu_11") / n
    middle, root = (a + b) / 2, F.sqrt((a - b) * (a - b) / 4 + d * d)
    out = moments(px).select(*_KEY, "area", (middle + root).alias("big"), F.greatest(middle - root, F.lit(0.0)).alias("small"))
    return out.select(*_KEY, "area", (4 * F.sqrt("big")).alias("axis_major"), (4 * F.sqrt("small")).alias("axis_minor"), F.sqrt(1 - F.col("small") / F.col("big")).alias("eccentricity"))


def euler_numbers(px: DataFrame) -> DataFrame:
    """(tile, label, euler_4, euler_8): components less holes, from counts of 2 x 2 patterns."""
    quads = _spread(px, {(0, 0): 1, (0, 1): 2, (1, 0): 4, (1, 1): 8})
    one, three, cross = (F.count_if(F.col("code").isin(*codes)) for codes in ((1, 2, 4, 8), (7, 11, 13, 14), (6, 9)))
    return quads.groupBy(*_KEY).agg(((one - three + 2 * cross) / 4).cast("long").alias("euler_4"), ((one - three - 2 * cross) / 4).cast("long").alias("euler_8"))


def rim(px: DataFrame) -> DataFrame:
    """Pixels of each region that have a 4-neighbour outside it."""
    near = _spread(px, {(0, 0): 100, (0, 1): 1, (0, -1): 1, (1, 0): 1, (-1, 0): 1})
    return near.where("code >= 100 AND code < 104").drop("code")


def perimeters(px: DataFrame) -> DataFrame:
    """(tile, label, perimeter): length of the line through the centres of the rim pixels.

    A rim pixel weighs 1, the root of 2 or their mean, by the number of rim pixels beside it and at
    its corners (2 and 10 each, itself 1), after Benkrid and Crookes."""
    steps = {(a, b): 1 if not a and not b else 10 if a and b else 2 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    codes = _spread(rim(px), steps)
    weight = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), math.sqrt(2)).when(F.col("code").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return codes.groupBy(*_KEY).agg(F.sum(weight).alias("perimeter"))


def region_properties(px: DataFrame) -> DataFrame:
    """All native shape properties of each region in one row, with the circularity."""
    out = axes(px).join(euler_numbers(px), _KEY).join(perimeters(px), _KEY)
    return out.withColumn("circularity", F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("area") / F.pow("perimeter", F.lit(2))))
