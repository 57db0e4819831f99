"""Choice of training subsets that look like the whole: many random trials, ranked by divergence, of
which the least overlapping ones are kept.

The table of tiles that is sampled is small by nature (one row a tile, a few numbers) and checked
against `MOST_TILES` before it is broadcast; trials, of which there can be any number, are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_TILES = 200_000
#: Distances that are held at a time.
CELLS = 1 << 22


def nearest(x: np.ndarray, y: np.ndarray, k: int = 1) -> np.ndarray:
    """Distance from each row of x to the k-th nearest row of y."""
    out, step = np.empty(len(x)), max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = np.zeros((len(part), len(y)))
        for a, b in zip(part.T, y.T):
            d += (a[:, None] - b[None]) ** 2
        out[at : at + step] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
    return out


def divergence(x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> float:
    """Nearest-neighbour estimate of how far the sample y is from the distribution of x; `own` are the
    distances of x to its second nearest neighbours, the first being itself."""
    own = nearest(x, x, 2) if own is None else own
    n, d = x.shape
    return float(-np.log(own / nearest(x, y)).sum() * d / n + np.log(len(y) / (n - 1.0)))


def drawn(n: int, size: int, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, noise) of a trial: a sample without replacement, and a little normal noise that keeps
    members from being at no distance from themselves."""
    state = np.random.RandomState(seed)
    places = state.choice(n, size=size, replace=False)
    return places, state.multivariate_normal(np.zeros(width), np.identity(width) / 10e5, size)


def trial_divergences(spark: SparkSession, tiles: np.ndarray, sizes: list[int], trials: int) -> DataFrame:
    """(n_samples, seed, kl) of every trial; sizes over the number of tiles have none."""
    if len(tiles) > MOST_TILES:
        raise ValueError(f"more than {MOST_TILES} tiles are not broadcast")
    shared = spark.sparkContext.broadcast((tiles, nearest(tiles, tiles, 2)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, own = shared.value
        for frame in frames:
            kl = []
            for size, seed in zip(frame.n_samples, frame.seed):
                places, noise = drawn(len(x), size, seed, x.shape[1])
                kl.append(divergence(x, x[places] + noise, own))
            yield frame.assign(kl=kl)

    usable = [s for s in sizes if s <= len(tiles)]
    rows = spark.range(trials * len(usable)).repartition(max(1, trials * len(usable) // 1000))
    size = F.element_at(F.array(*map(F.lit, usable or [0])), (F.col("id") % max(1, len(usable)) + 1).cast("int"))
    rows = rows.select(size.cast("long").alias("n_samples"), F.expr(f"id div {max(1, len(usable))}").alias("seed"))
    return rows.mapInPandas(run, "n_samples long, seed long, kl double")


def best_trials(found: DataFrame, subsets: int, trials: int) -> DataFrame:
    """The trials of least divergence of each size, one in a hundred and twice the subsets at least."""
    place = F.row_number().over(Window.partitionBy("n_samples").orderBy("kl", "seed"))
    return found.withColumn("place", place).where(F.col("place") <= max(2 * subsets, int(0.01 * trials)))


def eliminated(sets: list[np.ndarray], keep: int, n: int) -> tuple[list[int], np.ndarray]:
    """Numbers of the sets that stay when the one with the largest sum of overlaps goes again and again
    (the first on a tie), and the overlaps of those that stay."""
    member = np.zeros((len(sets), n), np.int32)
    for k, s in enumerate(sets):
        member[k, s] = 1
    overlap = member @ member.T
    np.fill_diagonal(overlap, 0)
    left = list(range(len(sets)))
    while len(left) > keep:
        left.pop(int(overlap[np.ix_(left, left)].sum(axis=0).argmax()))
    return left, overlap[np.ix_(left, left)]


def choose_subsets(spark: SparkSession, tiles: pd.DataFrame, columns: list[str], sizes: list[int], subsets: int = 5, trials: int = 25_000) -> DataFrame:
    """(n_samples, subset_idx, seed, kl, mean_ovlp, max_ovlp, tile_list): for each size the subsets of low
    divergence that overlap least. `tiles` has the column `tile`; its order is what seeds refer to."""
    values, names = tiles[columns].to_numpy(float), tiles["tile"].to_numpy()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        sets = [drawn(len(names), size, seed, len(columns))[0] for size, seed in zip(frame.n_samples, frame.seed)]
        left, overlap = eliminated(sets, subsets, len(names))
        own = frame.iloc[left][["n_samples", "seed", "kl"]].reset_index(drop=True)
        lists = [names[sets[k]].tolist() for k in left]
        return own.assign(subset_idx=range(len(left)), mean_ovlp=overlap.mean(axis=0), max_ovlp=overlap.max(axis=0).astype(float), tile_list=lists)

    found = best_trials(trial_divergences(spark, values, sizes, trials), subsets, trials)
    kind = "long" if np.issubdtype(names.dtype, np.integer) else "string"
    return found.groupBy("n_samples").applyInPandas(choose, f"n_samples long, seed long, kl double, subset_idx long, mean_ovlp double, max_ovlp double, tile_list array<{kind}>")
