"""The scan: a text column to one row per finding.

Runs of hex digits are found once per text, and dispatched by length to the detectors of digests. All active detectors' hits go into
one array, exploded once; findings are scored on the rows of hits. There is no shuffle and no
Python: the plan is a projection, a generator, a projection, a generator and a filter, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.plans.catalogue import DEFAULT, GUARDS, LEAST_RUN, Detector, Hit, Options, active, never

HIT = "array<struct<det: int, n: int, m: string, at: int, extra: string>>"
FINDING = "array<struct<type: string, payload: array<string>, certainty: int, details: string, keyword: string>>"
CONFIDENT, LIKELY = 80, 60
COLUMNS = ("type", "payload", "location", "size", "certainty", "confidence", "details", "keyword", "detector_seq", "match_seq")


def confidence(certainty: Column) -> Column:
    return F.when(certainty >= CONFIDENT, F.lit("confident")).when(certainty >= LIKELY, F.lit("likely")).otherwise(F.lit("possible"))


def _hits(s: str, i: int, d: Detector, options: Options, first: Column | None, whole: Column | None) -> Column:
    none = F.array().cast(HIT)
    found, extra = d.runs("_runs") if d.runs is not None else T.matches_sql(s, d.pattern) if d.hits is None else d.hits(s, options), "x.extra" if d.hits is not None else "''"
    out = F.expr(f"transform({found}, (x, n) -> struct({i} AS det, cast(n AS int) AS n, x.m AS m, x.at AS at, {extra} AS extra))")
    if d.guard is not None:
        out = F.when(F.col(f"_guards.`{d.guard}`"), out)
    begin = whole if d.whole else first if d.anchored else None
    if begin is not None:
        out = F.when(begin, out)
    return F.coalesce(out.cast(HIT), none)


def _findings(d: Detector, options: Options) -> Column:
    x = Hit(F.col("_hit.m"), F.col("_hit.extra"), F.col("_part"), F.col("_random"), F.col("_upper"))
    each = []
    for e in d.emits(x, options):
        one = F.struct(F.lit(e.type).alias("type"), F.array(*e.payload).alias("payload"), e.certainty.cast("int").alias("certainty"), e.details.alias("details"), (e.keyword if e.keyword is not None else F.lit(None).cast("string")).alias("keyword"))
        each.append(F.when(e.when, one) if e.when is not None else one)
    return F.array(*each)


def _by_detector(chosen: list[tuple[int, Detector]], value: Callable[[Detector], Column | None], otherwise: Column) -> Column:
    out = None
    for i, d in chosen:
        v = value(d)
        if v is not None:
            out = F.when(F.col("_hit.det") == i, v) if out is None else out.when(F.col("_hit.det") == i, v)
    return otherwise if out is None else out.otherwise(otherwise)


def scan(
    df: DataFrame, text: str = "text", ids: Sequence[str] = (), filters: Sequence[str] = DEFAULT, min_certainty: int = 0, strict: bool = False, extended: bool = False,
    base_offset: str | None = None, keep: tuple[str, str] | None = None, detectors: Sequence[str] | None = None, created_on: bool = False, last: str | None = None,
) -> DataFrame:
    """Findings in a string column, with the columns `ids` carried along.

    filters: categories to search; unknown ones match nothing. min_certainty also leaves out detectors that can't reach it.
    strict: keeps the quirks of the original where it gave output or failed. extended: salted and second-generation Joomla hashes.
    base_offset: a column added to locations (where a piece or window begins); patterns that need the start of a text then only hold
    at 0, unless strict. last: a column that says whether the text ends with this piece; patterns for a whole text then need a piece
    that is the whole. keep: the columns keep_from and keep_to of overlapping windows (readers.windows): only matches that begin from
    keep_from to before keep_to count, and of those none that the end of the window cuts; so each is found once, with what stands
    beside it, if it is no longer than half the overlap. detectors: only these. Null texts have no findings.
    """
    options = Options(tuple(filters), strict, extended)
    chosen = [(i, d) for i, d in active(options, min_certainty) if detectors is None or d.name in detectors]
    s, name = F.col(text), T.named(text)
    base = F.col(base_offset).cast("bigint") if base_offset else F.lit(0).cast("bigint")
    first = base == 0 if base_offset and not strict else None
    whole = first & F.col(last) if last and first is not None else first
    carried = [F.col(c) for c in ids]
    hits = [_hits(name, i, d, options, first, whole) for i, d in chosen] or [F.array().cast(HIT)]
    names = sorted({d.guard for _, d in chosen if d.guard})
    guards = F.struct(*[GUARDS[g](s).alias(g) for g in names]) if names else F.lit(None)
    rows = df.filter(s.isNotNull()).withColumn("_guards", guards)
    if any(d.runs is not None for _, d in chosen):  # found once for all detectors of hex digits
        rows = rows.withColumn("_runs", F.when(F.col("_guards.hex"), T.hex_runs(name, LEAST_RUN)))
    all_hits = F.concat(*hits) if len(hits) > 1 else hits[0]
    if keep and not strict:
        since, before, size = F.coalesce(keep[0], F.lit(0)), F.col(keep[1]), F.length(s)
        owned = lambda x: (x["at"] >= since) & (before.isNull() | (x["at"] < before) & (x["at"] + F.length(x["m"]) < size))
        all_hits = F.filter(all_hits, owned)
    # "outer", since Spark would else look for all hits once more, to leave out texts without any before they are exploded
    rows = rows.select(*carried, base.alias("_base"), F.explode_outer(all_hits).alias("_hit")).filter(F.col("_hit").isNotNull())
    rows = rows.withColumn("_part", _by_detector(chosen, lambda d: d.scored(F.col("_hit.m")) if d.scored else None, F.col("_hit.m")))
    rows = rows.withColumn("_upper", T.upper_or_digits(F.col("_part")))
    needed = _by_detector(chosen, lambda d: d.needs(F.col("_hit.m"), F.col("_upper")) if d.needs else None, F.lit(True))
    runs = [i for i, d in chosen if d.runs is not None and d.needs is not never]
    if runs:
        rows = T.with_random_looking(rows.withColumn("_scored", F.when(needed, F.col("_part"))), "_scored", F.col("_hit.det").isin(*runs), "_random")
    else:
        rows = rows.withColumn("_random", F.when(needed, T.random_looking(F.col("_part"))).otherwise(F.lit(False)))
    # a projection of its own, since a generator's expressions are interpreted; a lambda in it makes Spark cut its code into methods that
    # are small enough to be compiled, however many detectors there are. Findings that aren't are null, and go with the uncertain ones
    none = F.filter(F.array().cast(FINDING), lambda f: f.isNotNull())
    rows = rows.select(*carried, "_base", "_hit", _by_detector(chosen, lambda d: _findings(d, options), none).alias("_found"))
    out = rows.select(*carried, "_base", "_hit", F.explode_outer("_found").alias("_f")).filter(F.col("_f.certainty") >= min_certainty)
    shift = F.lit(0) if strict else F.col("_base")
    columns = [
        F.col("_f.type").alias("type"), F.col("_f.payload").alias("payload"), (F.col("_hit.at") + shift).cast("bigint").alias("location"), F.length("_hit.m").alias("size"), F.col("_f.certainty").alias("certainty"),
        confidence(F.col("_f.certainty")).alias("confidence"), F.col("_f.details").alias("details"), F.col("_f.keyword").alias("keyword"), F.col("_hit.det").alias("detector_seq"), F.col("_hit.n").alias("match_seq"),
    ]
    return out.select(*carried, *columns, *([F.current_timestamp().alias("created_on")] if created_on else []))
