"""The operators as stages of a corpus pipeline: documents in, documents out.

A stage gives the rows of its input keys, lets the operator decide on rows, and keeps the rows
whose keys stay, so that repeated ids and extra columns pass through untouched. An operator
that meets null texts, empty or very long ones, ties, repeated rows or an empty table does here
what its own docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ROW, stored, with_row
from .decontamination import contained_items
from .exact_dedup import exact_dedup
from .jaccard_dedup import near_copies
from .mixing import mix_sources
from .simhash import simhash_components
from .toxicity import fit, score_toxicity


def _keep(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose key is in `kept`, with the columns of the documents."""
    return numbered.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go; the classifier learns from `labels`."""
    numbered = with_row(docs, by_values=True)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(numbered, score_toxicity(numbered, model, carry=(ROW,)).where("predicted = 0"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    numbered = with_row(docs, by_values=True)
    return _keep(numbered, exact_dedup(numbered, carry=(ROW,)).where("kept"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word Jaccard of 0.8) one row stays, and of those
    that stay one of each component of close fingerprints (three words, three bits)."""
    numbered = with_row(docs, by_values=True)
    apart = numbered.join(stored(near_copies(numbered), "near-copies").where("is_first").select(ROW), ROW, "left_semi")
    return _keep(numbered, simhash_components(apart, carry=(ROW,)).where("is_first"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of `benchmark` go."""
    numbered = with_row(docs, by_values=True)
    found = contained_items(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=(ROW,))
    return numbered.join(found.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy of a document that is taken, none if it is not.

    Beside the columns of the documents a row has copy (from 1), copies, size, source_size,
    target (of the source) and taken (words that this row adds); a name that the documents have
    themselves gets the prefix mix_."""
    numbered = with_row(docs, by_values=True)
    mixed = mix_sources(numbered, carry=(ROW,)).where("copies > 0")
    new = {
        "copy": F.explode(F.sequence(F.lit(1).cast("long"), "copies")), "copies": F.col("copies"), "size": F.col("size"),
        "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("size"),
    }
    mixed = mixed.select(ROW, *[c.alias(f"mix_{k}" if k in docs.columns else k) for k, c in new.items()])
    return numbered.join(mixed, ROW).drop(ROW)
