"""Scalar functions on text, as Spark expressions: entropy, ASCII predicates, boundaries, and matches with their places.

Offsets are those of the column's characters; text decoded from bytes as ISO-8859-1 has one character per byte.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strictly more bits per character than this counts as random-looking.
RANDOM = 3.3
HEX, CRYPT, WORD = "[0-9A-Fa-f]", "[A-Za-z0-9./]", "[A-Za-z0-9_]"
#: ASCII word boundaries: Java's own is Unicode-aware, while its word class isn't.
NO_WORD_BEFORE, NO_WORD_AFTER = f"(?<!{WORD})", f"(?!{WORD})"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
MATCHES = "array<struct<m: string, at: int>>"
#: Matches whose places are summed up at once; arrays of this size are copied, never those of a whole text.
BLOCK = 256


def _bits(length: Column, sums: Column) -> Column:
    """Entropy from the sum of c * log2(c) over the counts c of the characters, in their order (sums of doubles depend on it)."""
    return F.greatest(F.lit(0.0), F.log2(length) - sums / length)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string. The characters are sorted, so that each is one run, and only the
    runs are summed up: the time doesn't depend on how many characters differ."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    counts = F.transform(runs, lambda r: F.length(r).cast("double"))
    sums = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(F.length(s) > 0, _bits(F.length(s), sums)).otherwise(F.lit(0.0))


def random_looking(s: Column) -> Column:
    return entropy(s) > RANDOM


#: As many hex digits as are counted by bits: two words of 64 bits for each of a digit's four bits.
MOST_HEX = 128


def with_hex_sums(rows: DataFrame, s: str, out: str) -> DataFrame:
    """rows with out: the sum of c * log2(c) over the counts c of the values of the hex digits s (MOST_HEX at most; null: null). 16 digits
    are read as one number, and bit j of 64 digits is gathered in one word, so that the digits of one value are the bits set in a conjunction
    of four words. The lambda at the beginning, as the one in entropy, keeps the method that Spark generates for this small enough to be compiled."""
    ones, words, name = F.lit(0x1111111111111111), range(MOST_HEX // 64), (out + "_{}_{}").format
    kept, length = rows.columns, F.length(s)
    numbers = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 16).cast("int")), lambda k: F.conv(F.substring(s, 16 * k + 1, F.lit(16)), 16, -10).cast("bigint"))
    bit = lambda k, j: F.shiftleft(F.shiftrightunsigned(name("number", k), j).bitwiseAND(ones), k % 4)
    is_set = lambda j, w, v: F.col(name(f"bit{j}", w)) if v else F.bitwise_not(name(f"bit{j}", w))
    count = lambda v: reduce(Column.__add__, [F.bit_count(F.col(name(f"low{v % 4}", w)).bitwiseAND(F.col(name(f"high{v // 4}", w)))) for w in words])
    rows = rows.withColumn(out, numbers)
    rows = rows.withColumns({name("number", k): F.coalesce(F.get(out, F.lit(k)), F.lit(0).cast("bigint")) for k in range(MOST_HEX // 16)})
    rows = rows.withColumns({name(f"bit{j}", w): reduce(Column.bitwiseOR, [bit(4 * w + i, j) for i in range(4)]) for w in words for j in range(4)})
    rows = rows.withColumns({name(f"{half}{v}", w): is_set(j, w, v & 1).bitwiseAND(is_set(j + 1, w, v & 2)) for w in words for j, half in ((0, "low"), (2, "high")) for v in range(4)})
    absent = F.lit(MOST_HEX) - length  # digits that aren't there read as 0
    rows = rows.select(*kept, (count(0) - absent).cast("double").alias(name("count", 0)), *[count(v).cast("double").alias(name("count", v)) for v in range(1, 16)])
    sums = reduce(lambda acc, c: acc + c * F.log2(F.greatest(c, F.lit(1.0))), [F.col(name("count", v)) for v in range(16)], F.lit(0.0))
    return rows.select(*kept, sums.alias(out))


def with_random_looking(rows: DataFrame, s: str, hexes: Column, out: str) -> DataFrame:
    """rows with out: whether the column s looks random (null: no). Where `hexes` holds, s has hex digits only; these are counted by
    bits, unless they are more than MOST_HEX or letters of both cases, since then a value isn't a character."""
    s_, short, sums = F.col(s), f"{out}_hex", f"{out}_sums"
    rows = rows.withColumn(short, F.when(hexes & F.length(s).between(1, MOST_HEX) & ((s_ == F.lower(s)) | (s_ == F.upper(s))), s_))
    rows = with_hex_sums(rows, short, sums)
    by_bits = _bits(F.length(short), F.col(sums))
    return rows.withColumn(out, F.when(F.col(short).isNotNull(), by_bits > RANDOM).when(s_.isNotNull(), random_looking(s_)).otherwise(F.lit(False)))


def upper_or_digits(s: Column) -> Column:
    return s.rlike(r"\A[A-Z0-9]*\z")


# Matches with their places, as SQL text: one call to the parser instead of some hundred to build the expression


def named(column: str) -> str:
    """The name of a column (or of a field, with dots) as SQL."""
    return column if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", column) else "`" + column.replace("`", "``") + "`"


def _raw(pattern: str) -> str:
    if "'" in pattern:
        raise ValueError("a pattern can't have a quote")
    return f"r'{pattern}'"


def _let(value: str, name: str, body: str) -> str:
    """body of a value that is worked out once, however often body names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_WIDTH = "length(x.gap) + coalesce(length(x.m), 0)"
_PART = f"slice(fs, b * {BLOCK} + 1, {BLOCK})"
#: fs: array<struct<gap, m>>; bs: numbers of its blocks; st: where they begin; and what is placed in each (the matches, or the gaps).
_STARTS = f"aggregate(bs, struct(0 AS at, cast(array() AS array<int>) AS out), (acc, b) -> struct(acc.at + aggregate({_PART}, 0, (n, x) -> n + {_WIDTH}) AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out)"


def _placed(out: str) -> str:
    inside = f"aggregate({_PART}, struct(element_at(st, b + 1) AS at, cast(array() AS {MATCHES}) AS out), (acc, x) -> struct(acc.at + {_WIDTH} AS at, {out} AS out), acc -> acc.out)"
    return _let(f"sequence(0, cast((size(fs) - 1) div {BLOCK} AS int))", "bs", _let(_STARTS, "st", f"flatten(transform(bs, b -> {inside}))"))


_PLACED = _placed("if(x.m IS NULL, acc.out, concat(acc.out, array(struct(x.m AS m, acc.at + length(x.gap) AS at))))")
_PARTS = _placed("if(x.gap = '', acc.out, concat(acc.out, array(struct(x.gap AS m, acc.at AS at))))")


def _split(s: str, pattern: str, placed: str, none: str) -> str:
    """`placed`, in terms of gaps and of fs (gaps and matches), where there are matches, else `none`: running sums of both lengths, first for every
    BLOCK of them, then in each block, so that the time is linear in the matches."""
    found = f"zip_with(gaps, regexp_extract_all({s}, {_raw(pattern)}, 0), (gap, m) -> struct(gap, m))"
    return _let(f"split({s}, {_raw(pattern)}, -1)", "gaps", f"if(size(gaps) > 1, {_let(found, 'fs', placed)}, {none})")


def matches_sql(s: str, pattern: str) -> str:
    """All leftmost, non-overlapping matches (MATCHES) of the SQL expression s with their places (0-based): the text between matches
    comes from a split by the same pattern. The pattern must not match the empty string."""
    return _split(s, pattern, _PLACED, f"cast(array() AS {MATCHES})")


def parts_sql(s: str, separator: str) -> str:
    """What stands between the matches of a separator, without empty parts, with its places (MATCHES)."""
    whole = f"if({s} = '', cast(array() AS {MATCHES}), array(struct({s} AS m, 0 AS at)))"
    return _split(s, separator, _PARTS, whole)


def matches(s: str, pattern: str) -> Column:
    return F.expr(matches_sql(s, pattern))


#: A maximal run: whether a word character stands before and after it, whether a star after a word character stands before it, and
#: whether 0x that begins a word does.
RUN = "array<struct<m: string, at: int, n: int, left: boolean, right: boolean, star: boolean, header: boolean>>"


def hex_runs(s: str, least: int) -> Column:
    """Maximal runs of hex digits, `least` or more. What stands beside them are the ends of the gaps; before a gap that isn't the
    first one stands the last digit of a run."""
    beside = rf"transform(gaps, (g, i) -> struct(right(concat(if(i > 0, 'f', ''), right(g, 3)), 3) AS before, g rlike r'\A{WORD}' AS word))"
    before = "element_at(by, i + 1).before"
    run = rf"struct(x.m AS m, x.at AS at, length(x.m) AS n, {before} rlike r'{WORD}\z' AS left, element_at(by, i + 2).word AS right, {before} rlike r'{WORD}\*\z' AS star, {before} rlike r'(?:\A|[^A-Za-z0-9_])0x\z' AS header)"
    return F.expr(_split(s, f"{HEX}{{{least},}}+", _let(beside, "by", f"transform({_PLACED}, (x, i) -> {run})"), f"cast(array() AS {RUN})"))


def _only(s: Column, allowed: str) -> Column:
    """The characters of a class; most texts have no others, which one pass tells much faster than a search for its complement."""
    return F.when(s.rlike(rf"\A[{allowed}]*+\z"), s).otherwise(F.regexp_replace(s, f"[^{allowed}]", ""))


def base64_length_ok(s: Column) -> Column:
    """Whether a lenient decoder accepts it: characters outside the alphabet don't count, the rest must come in fours."""
    return F.length(_only(s, "A-Za-z0-9+/")) % 4 == 0


def base64_text(s: Column) -> Column:
    """Decoded leniently, one character per byte; null where the padding is wrong. Other characters are dropped first, once."""
    decoded = F.transform(F.array(_only(s, "A-Za-z0-9+/=")), lambda clean: F.when(F.length(clean) % 4 == 0, F.decode(F.unbase64(clean), "ISO-8859-1")))
    return F.element_at(decoded, 1)


def printable(s: Column) -> Column:
    return s.rlike(r"\A[\x09-\x0D\x20-\x7E]*\z")
