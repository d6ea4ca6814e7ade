"""Labelled documents with their whole texts: all of them as a table, or a bounded sample on which the driver trains small models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import common as C
from tracelode.llm.decontamination import CELLS, bitmap


def _known(labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[DataFrame, dict[int, int], float]:
    """(doc_id, label) outside the held-out fold, the rows of each class, and the share of class 1."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (C.fold("doc_id", folds) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    return known, counts, counts.get(1, 0) / max(1, sum(counts.values()))


def _agreed(known: DataFrame) -> DataFrame:
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def every(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, held_out: int = 0) -> tuple[DataFrame, float]:
    """(label, text) of all labelled documents, and the share of class 1; rows are left out as by sample(). Before the join a bitmap
    of CELLS bits, whatever the tables, keeps most texts without a label inside the scan."""
    C.bounded_batches(docs.sparkSession)
    known, _, share = _known(labels, label, folds, held_out)
    agreed = _agreed(known)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(agreed.select(F.xxhash64("doc_id").alias("h"))))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        cell = h.to_numpy() & (CELLS - 1)
        return pd.Series((bits.value[cell >> 3] >> (cell & 7) & 1).astype(bool))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null").filter(listed(F.xxhash64("doc_id")))
    return texts.join(agreed, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), share


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, held_out: int = 0) -> tuple[list[tuple[int, bytes]], float]:
    """At most per_class (label, whole text) of each class 0 and 1, and the share of class 1. Rows of the held-out fold, null
    labels and null ids are left out, and so are ids that are labelled both 0 and 1, which teach nothing; repeated equal labels
    are one. Which rows are taken depends on a hash of the id only; of several documents with one id it is the least text. The
    driver gets at most 2 * per_class texts."""
    C.bounded_batches(docs.sparkSession)
    known, counts, share = _known(labels, label, folds, held_out)
    # of a large class, a hash below its part leaves some twice per_class rows, before the least are taken
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    part = {y: min(1.0, 2 * (per_class + 50) / max(1, counts.get(y, 0))) for y in (0, 1)}
    agreed = _agreed(known.filter(order < int(max(part.values()) * (1 << 30))))
    parts = [agreed.filter((F.col("label") == y) & (order < int(part[y] * (1 << 30)))).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # the chosen rows are bounded by per_class, so they may be broadcast; equal ids can't make the sample larger than its bound
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(r["label"], r["text"].encode()) for r in rows], share
