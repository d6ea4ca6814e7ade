"""Documents to training sequences: each stage's result is written as Parquet and read again as the next one's documents.

Quality, near-duplicates and decontamination drop documents, substring dedup drops words of documents, and packing turns what is
left into sequences of token ids. Null and empty texts pass through every stage as their operators define; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import common as C
from tracelode.llm import decontamination, packing, quality, repeats, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidied(stage: Stage) -> Stage:
    """The stage, which gives back the driver's memory before it plans anything and before its result is written: what one stage
    has freed isn't held on top of the next one's plans, nor what training has freed on top of the stage's own."""

    @functools.wraps(stage)
    def run_tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.tidy(spark)
        out = stage(spark, docs, sf_dir)
        C.tidy(spark)
        return out

    return run_tidied


@tidied
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained on the labels of the whole table."""
    model = quality.fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, "_score").filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


@tidied
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: SimHash fingerprints at 3 bits or fewer, or a similarity of 0.8 or more of
    5-word shingles."""
    return simhash.one_of_each(docs.select(*COLUMNS), similar_too=True)


@tidied
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that a smaller doc_id has too; others' texts stay as they are."""
    out = repeats.remove_repeats(docs, ("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars").cast("long")).alias("n_chars"))


@tidied
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, C.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    own = docs.select(*COLUMNS, F.xxhash64("text").alias("_own"))
    return own.alias("d").join(found.alias("f"), F.expr("d._own = f._row and cast(d.doc_id as long) <=> f._id"), "left_anti").select(*COLUMNS)


@tidied
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
