"""What is made of findings: lines to display, roll-ups, duplicates of overlapping windows, the list of detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans.catalogue import CATALOGUE


def displayed(findings: DataFrame, details: bool = False) -> DataFrame:
    """The column `line`: the details, with type, location, confidence and certainty if asked for."""
    full = F.format_string("%s [%s at %s, %s: %s]", "details", "type", "location", "confidence", "certainty")
    return findings.withColumn("line", full if details else F.col("details"))


def rollup(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and certainties by keys, type and confidence."""
    return findings.groupBy(*keys, "type", "confidence").agg(F.count("*").alias("n_findings"), F.max("certainty").alias("max_certainty"), F.min("certainty").alias("min_certainty"))


def without_overlaps(findings: DataFrame, source: Sequence[str] = ("source",)) -> DataFrame:
    """One row for each source, type, place, size and keyword: what overlapping windows found twice. The payload follows from these and is
    a key too, since Spark would have to sort the findings to take the first one's."""
    return findings.dropDuplicates([*source, "type", "location", "size", "keyword", *(c for c in ("payload",) if c in findings.columns)])


def as_view(findings: DataFrame, name: str = "findings") -> DataFrame:
    """Registers findings under a name, for SQL."""
    findings.createOrReplaceTempView(name)
    return findings


def catalogue(spark: SparkSession) -> DataFrame:
    """The detectors: place, name, types, categories, largest certainty, description."""
    rows = [(i, d.name, list(d.types), list(d.categories), d.most, d.about) for i, d in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "detector_seq int, name string, types array<string>, categories array<string>, max_certainty int, about string")
