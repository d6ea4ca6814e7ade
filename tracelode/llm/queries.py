"""The registered queries of the training-data operators, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontamination, divergence, fingerprints, html, language, lm_scoring, manifest, packing, quality, repeats, simhash, tokenbits, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_packing": packing.query,
    "op3_repeats": repeats.query,
    "op4_decontamination": decontamination.query,
    "op5_simhash": simhash.query,
    "op6_toxicity": toxicity.query,
    "op7_language": language.query,
    "op8_html": html.query,
    "op9_fingerprints": fingerprints.query,
    "op10_quality": quality.query,
    "op11_manifest": manifest.query,
    "op12_tokenbits": tokenbits.query,
    "op13_divergence": divergence.query,
}

ORACLE_SQL: dict[str, str] = {"op3_repeats": repeats.SQL, "op11_manifest": manifest.SQL, "op13_divergence": divergence.SQL}
