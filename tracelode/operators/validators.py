"""Validators: predicates on a finding's payload.

A validator is `all:X` or `has:X` with X one of NUMERIC, ALPHA, LOWER, UPPER, ALPHANUMERIC, SYMBOL (ASCII; case doesn't matter), or
`search:pattern` with a Java regular expression. Line breaks and dashes are taken out of the payload first; a payload of several
parts is joined. `all` holds for an empty payload, `has` doesn't.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = {"NUMERIC": "0-9", "ALPHA": "A-Za-z", "LOWER": "a-z", "UPPER": "A-Z", "ALPHANUMERIC": "A-Za-z0-9", "SYMBOL": "^A-Za-z0-9"}


def cleaned(payload: Column) -> Column:
    return F.regexp_replace(F.concat_ws("", payload), r"[\n\r-]", "")


def predicate(validator: str, payload: Column, strict: bool = False) -> Column:
    """strict: a search pattern ends at its first colon."""
    mode, _, what = validator.partition(":")
    s = cleaned(payload)
    if mode.lower() == "search":
        return s.rlike(what.split(":")[0] if strict else what)
    if mode.lower() not in ("all", "has"):
        raise ValueError(f"validator {validator!r}: the mode must be all, has or search")
    chars = CLASSES.get(what.upper())
    if chars is None:
        raise ValueError(f"validator {validator!r}: the class must be one of {', '.join(CLASSES)}")
    return s.rlike(rf"\A[{chars}]*\z" if mode.lower() == "all" else f"[{chars}]")


def validate(findings: DataFrame, validators: Sequence[str], combine: str = "or", strict: bool = False) -> DataFrame:
    """Findings that pass one of the validators (combine 'or'), or all of them ('and'). strict: one row for each that passes."""
    if not validators:
        return findings
    tests = [predicate(v, F.col("payload"), strict) for v in validators]
    if strict:
        return reduce(DataFrame.unionByName, [findings.filter(t) for t in tests])
    return findings.filter(reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), tests))
