"""Page verdicts: for each page of memory (or any text), which types are there with which confidence, first match only.

No entropy is used here; a type is put into one of three lists by its shape. Categories are given as a string or a list. The catalogue's
guards spare pages without a trace of a type its pattern, and each pattern is looked for once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.plans.catalogue import CRC_FAMILIES, GUARDS, UUID_VERSIONS

H, C, W = T.HEX, T.CRYPT, T.WORD
L, R = T.NO_WORD_BEFORE, T.NO_WORD_AFTER
PAGE, OVER_READ = 0x1000, 0x30


@dataclass(frozen=True)
class Sign:
    """types are reported at `level` of a page that `there` holds for."""

    types: tuple[str, ...]
    category: str | None
    there: Column
    level: Column
    details: Column | None
    guard: str | None = None


#: 32 hex digits and no more, the sign of four types.
HEX32 = f"(?<!{H})({H}{{32}})(?!{H})"


def _level(*rules: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, level in rules:
        out = F.when(condition, F.lit(level)) if out is None else out.when(condition, F.lit(level))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def _signs(s: Column, filters: tuple[str, ...]) -> list[Sign]:
    get = lambda p, g=1: F.regexp_extract(s, p, g)
    upper = s.rlike(r"\A[A-Z0-9]*\z")
    lower = s.rlike(r"\A[a-z0-9$]*\z")
    say = lambda label, *v: F.concat_ws(" ", F.lit(label), *v)
    hex32 = F.col("_hex32")
    certain = "confident" if set(filters) & {"web", "other"} else "likely"
    account = rf"\A(?:{W}+:[0-9]+:)?"
    out = [
        Sign(("md5",), None, hex32 != "", F.lit(certain), say("MD5 digest:", hex32)),
        Sign(("md4",), None, hex32 != "", F.lit("possible"), say("MD4 digest:", hex32)),
    ]

    def add(types: tuple[str, ...] | str, category: str, pattern: str, level: Column, details: Column | None = None, guard: str = "hex") -> None:
        out.append(Sign((types,) if isinstance(types, str) else types, category, s.rlike(pattern), level, details, guard))

    for name, size, right in (("mssql2005", 48, R), ("mssql2000", 88, "")):
        p = f"{L}(?:0x0100)?{H}{{{size}}}{right}"
        body = F.regexp_replace(get(p, 0), r"\A0x0100", "")
        add(name, "db", p, _level((s.rlike(f"{L}0x0100{H}{{{size}}}{R}"), "confident"), otherwise="likely"), say("Microsoft SQL Server, salt and hashes:", F.substring(body, 1, 8), F.substring(body, 9, 80)))
    for name in ("lm", "ntlm"):
        out.append(Sign((name,), "win", hex32 != "", _level((upper, "confident"), otherwise="likely"), say(name.upper() + " hash:", hex32)))
    star = rf"\*({H}{{40}}){R}"
    add("MySQL4+", "db", star, F.lit("likely"), say("MySQL 4 or later:", get(star)))
    bare = F.regexp_replace(s, r"\n\z", "")
    is_base64 = bare.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (F.length(bare) % 4 == 0)
    out.append(Sign(("base64",), "other", is_base64, _level((s.endswith("="), "confident"), otherwise="possible"), say("Base64 of:", F.when(is_base64, T.base64_text(bare)))))
    ntlm = rf"{account}\*:({H}{{32}})(?!{H})"
    add("SAM(*:ntlm)", "win", ntlm, _level((T.upper_or_digits(get(ntlm)), "confident"), otherwise="possible"), say("SAM entry without LM hash, NTLM:", get(ntlm)))
    lm = rf"{account}({H}{{32}}):\*"
    add("SAM(lm:*)", "win", lm, F.lit("confident"), say("SAM entry without NTLM hash, LM:", get(lm)))
    both = rf"{account}({H}{{32}}):({H}{{32}}){R}"
    add("SAM(lm:ntlm)", "win", both, F.lit("confident"), say("SAM entry, LM and NTLM:", get(both), get(both, 2)))
    add("RipeMD320", "other", f"{L}{H}{{80}}{R}", F.lit("possible"))
    for name, size in (("sha1", 40), ("sha224", 56), ("sha256", 64), ("sha384", 96)):
        add(name, "other", f"{L}{H}{{{size}}}{R}", F.lit("likely"))
    add(("sha512", "whirlpool"), "other", f"{L}{H}{{128}}{R}", F.lit("likely"))
    old = f"{L}({H}{{16}}){R}"
    add("mysql323", "db", old, _level((upper, "confident"), otherwise="likely") if filters == ("db",) else F.lit("likely"), say("MySQL 3.23 or earlier:", get(old)))
    family = F.lit("of no known length")
    for k, name in CRC_FAMILIES.items():
        family = F.when(F.length(s) - 2 == k, F.lit(name)).otherwise(family)
    add("CRC", "other", f"0x{H}{{1,16}}{R}", F.lit("possible"), say("Checksum", family), "0x")
    des = f"(?<![A-Za-z0-9./$])({C}{{2}})({C}{{11}})(?!{C})"
    shadow = rf"\A{W}+:{C}{{13}}(?::[0-9]*){{2}}(?::[^\n]*?){{2}}:[^\n]*\n?\z"
    add("des-salt-unix", "unix", des, F.lit("confident") if filters == ("unix",) else _level((s.rlike(shadow), "confident"), otherwise="possible"), say("Unix DES, salt and hash:", get(des), get(des, 2)), "short run")
    for name, algorithm, salt, size in (("sha256-salt-django", "(?:sha256|sha1)", "[A-Za-z0-9./]+", 64), ("sha256-django", "(?:sha256|sha1)", "", 64), ("sha384-salt-django", "sha384", "[A-Za-z0-9.]+", 96), ("sha384-django", "sha384", "", 96)):
        p = rf"\A{algorithm}\$({salt})\$({C}{{{size}}})\n?\z"
        add(name, "web", p, _level((lower, "confident"), otherwise="likely"), say("Django account:", get(p), get(p, 2)), "sha")
    for name, mark, salt, size, before in (("sha256-salt-unix", r"\$5\$", "8,16", 43, ""), ("sha512-salt-unix", r"\$6\$", "8,16", 86, ""), ("apr1-salt-unix", r"\$apr1\$", "8", 22, ""), ("md5-salt-unix", "", "8", 22, "(?<![A-Za-z0-9.])")):
        p = rf"{before}{mark}({C}{{{salt}}})\$({C}{{{size}}})(?!{C})"
        add(name, "unix", p, F.lit("confident"), say("Unix account, salt and hash:", get(p), get(p, 2)), "$")
    run = f"(?<![A-Za-z0-9.])({C}{{31}})(?![A-Za-z0-9.=/])"
    for name, mark in (("md5-wordpress", "P"), ("md5-phpBB3", "H")):
        rules = [(s.rlike(rf"\A\${mark}\${C}{{31}}\n?\z"), "confident"), *([(s.startswith("$"), "likely")] if filters == ("web",) else [])]
        add(name, "web", run, _level(*rules, otherwise="possible"), say("Portable hash:", get(run)), "run")
    for version, size, start in ((2, 32, r"\A"), (1, 16, "(?<![A-Za-z0-9.])")):
        p = rf"{start}([a-z0-9./]{{32}}):({C}{{{size}}})(?!{C})"
        add(f"md5-salt-joomla{version}", "web", p, F.lit("confident"), say("Joomla account, hash and salt:", get(p), get(p, 2)), "run")
        q = rf"{start}([a-z0-9./]{{32}})(?!{C})"
        out.append(Sign((f"md5-joomla{version}",), "web", s.rlike(q) & ~s.rlike(p), F.lit("likely"), say("Joomla account, hash:", get(q)), "run"))
    blow = rf"(?<=\$2\$|\$2a\$)({C}{{2}})\$({C}{{53}})(?!{C})"
    add("blowfish-salt-unix", "unix", blow, F.lit("confident"), say("Unix Blowfish account, salt and hash:", get(blow), get(blow, 2)), "$")
    uuid = f"(?<!{H})({H}{{8}}-{H}{{4}}-({H}){H}{{3}}-({H}){H}{{3}}-{H}{{12}})(?!{H})"
    kind = F.lit("version 1, 2 or unknown")
    for v in ("3", "4", "5"):
        here = (get(uuid, 2) == v) & (F.lower(get(uuid, 3)).isin("8", "9", "a", "b") if v == "4" else F.lit(True))
        kind = F.when(here, F.lit(f"version {v}, {UUID_VERSIONS[v]}")).otherwise(kind)
    add("uuid", "uuid", uuid, F.lit("confident"), say("UUID", kind), "-")
    return out


LEVELS = ("confident", "likely", "possible")


def verdicts(pages: DataFrame, text: str = "text", ids: Sequence[str] = (), filters: str | Sequence[str] = (), uuids: bool = False) -> DataFrame:
    """ids, an array of types for each level, and details by type, of every page on which anything is found."""
    names = tuple(x for x in filters.replace(" ", "").split(",") if x) if isinstance(filters, str) else tuple(filters)
    s = F.col(text)
    signs = [x for x in _signs(s, names) if x.category is None or x.category in names or x.category == "uuid" and uuids]
    guards = sorted({"hex", *(x.guard for x in signs if x.guard)})
    there = lambda x: F.col(f"_guards.`{x.guard}`") & x.there if x.guard else x.there
    found = [F.when(there(x), F.struct(F.lit(t).alias("type"), x.level.alias("level"), (x.details if x.details is not None else F.lit(None).cast("string")).alias("details"))) for x in signs for t in x.types]
    rows = pages.filter(s.isNotNull()).withColumn("_guards", F.struct(*[GUARDS[g](s).alias(g) for g in guards]))
    rows = rows.withColumn("_hex32", F.when(F.col("_guards.hex"), F.regexp_extract(s, HEX32, 1)))
    # exploded, since Spark would else look for everything twice: below the projections too, to leave out pages without anything
    rows = rows.select(*ids, F.explode_outer(F.array(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("_found")).filter(F.size("_found") > 0)
    of = lambda level: F.transform(F.filter("_found", lambda x: x["level"] == level), lambda x: x["type"])
    told = F.filter("_found", lambda x: x["details"].isNotNull())
    return rows.select(*ids, *[of(level).alias(level) for level in LEVELS], F.map_from_arrays(F.transform(told, lambda x: x["type"]), F.transform(told, lambda x: x["details"])).alias("details"))


def shown(found: DataFrame) -> DataFrame:
    """The column `line`: for each level the first type, and the details of all."""
    parts = [F.when(F.size(level) > 0, F.concat(F.lit("Found "), F.element_at(level, 1), F.lit(f" ({level})"), F.concat_ws("", F.transform(F.filter(level, lambda t: F.map_contains_key("details", t)), lambda t: F.concat(F.lit("\t"), F.col("details")[t]))))) for level in LEVELS]
    return found.withColumn("line", F.concat_ws("\n", *parts))


def of_processes(pages: DataFrame, name: str | None = None, pid: int | None = None) -> DataFrame:
    """Pages of the processes whose name begins so, or of this process; all if neither is given."""
    tests = [*([F.col("pname").startswith(name)] if name is not None else []), *([F.col("pid") == pid] if pid is not None else [])]
    if not tests:
        return pages
    return pages.filter(tests[0] if len(tests) == 1 else tests[0] | tests[1])
