"""The detectors: what each looks for, under which categories, and how its hits are scored.

A detector is a pattern (or an expression for its hits), the name of a cheap guard that spares texts without a trace of it, and the
findings that a hit gives. Guards are worked out once per text for all detectors; hits of all detectors are exploded once; findings
are scored on the rows, with one entropy per hit, so that only hits cost anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions import text as T

CATEGORIES = ("win", "web", "unix", "db", "personal", "crypto", "other", "secrets")
#: What is searched unless categories are given.
DEFAULT = ("win", "web", "unix", "db", "personal", "crypto", "other")


@dataclass(frozen=True)
class Options:
    filters: tuple[str, ...] = DEFAULT
    strict: bool = False
    extended: bool = False


@dataclass(frozen=True)
class Hit:
    """A match, what its hits expression adds, its scored part, whether that looks random, and whether it is upper case or digits."""

    m: Column
    extra: Column
    part: Column
    random: Column
    upper: Column


@dataclass(frozen=True)
class Emit:
    """One finding of a hit: nothing if `when` is false."""

    type: str
    payload: list[Column]
    certainty: Column
    details: Column
    when: Column | None = None
    keyword: Column | None = None


@dataclass(frozen=True)
class Detector:
    name: str
    types: tuple[str, ...]
    categories: tuple[str, ...]
    most: int  # the largest certainty it can give
    pattern: str | None
    emits: Callable[[Hit, Options], list[Emit]]
    guard: str | None = None
    scored: Callable[[Column], Column] | None = None  # the part of a match whose entropy counts; the whole if None
    runs: Callable[[str], str] | None = None  # SQL of text.RUN -> SQL of array<struct<m, at>>
    hits: Callable[[str, Options], str] | None = None  # SQL of the text -> SQL of array<struct<m, at, extra>>
    anchored: bool = False  # only where a text begins
    whole: bool = False  # only if it is all of a text
    needs: Callable[[Column, Column], Column] | None = None  # match, whether its part is upper case -> whether the certainty depends on its entropy; always if None
    about: str = ""


def never(m: Column, upper: Column) -> Column:
    """The certainty doesn't depend on entropy."""
    return F.lit(False)


H, C, W = T.HEX, T.CRYPT, T.WORD
_L, _R = T.NO_WORD_BEFORE, T.NO_WORD_AFTER


def _part(m: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(m, pattern, group)


def _say(label: str, *values: Column) -> Column:
    """label with a placeholder per value."""
    return F.format_string(label.replace("{}", "%s"), *values)


def _scored(base: int, *rules: tuple[Column, int]) -> Column:
    """The first rule that holds gives the certainty."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return F.lit(base) if out is None else out.otherwise(F.lit(base))


#: The shortest run of hex digits that a detector takes.
LEAST_RUN = 16


def _whole_runs(size: int) -> Callable[[str], str]:
    """Runs of this size that are words."""
    return lambda runs: f"filter({runs}, r -> r.n = {size} AND NOT r.left AND NOT r.right)"


def _digest(name: str, size: int, base: int, boosted: int, label: str) -> Detector:
    def emits(x: Hit, o: Options) -> list[Emit]:
        return [Emit(name, [x.m], _scored(base, (x.random, boosted)) if boosted > base else F.lit(base), _say(label + ": {}", x.m))]

    return Detector(name, (name,), ("crypto", "other"), boosted, None, emits, "hex", runs=_whole_runs(size), needs=None if boosted > base else never, about=f"{size} hex digits")


#: Words that make a line worth reading, and beginnings that speak against a secret.
SECRET_WORDS = ("pass", "key", "security")
SECRET_PITFALLS = ("/", "-", "keystore_", "{{", "$", "secret", "configmap", "[", "true", "false")


def any_case(word: str) -> str:
    """A pattern for an ASCII word in upper or lower case."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


#: Guards by name; each is a test of the text that must hold if a detector with this guard can match.
GUARDS: dict[str, Callable[[Column], Column]] = {
    "hex": lambda s: s.rlike(f"{T.HEX}{{16}}"),
    "run": lambda s: s.rlike(f"{T.CRYPT}{{31}}"),
    "short run": lambda s: s.rlike(f"{T.CRYPT}{{13}}"),
    "des run": lambda s: s.rlike(_DES_RUN),
    "digits": lambda s: s.rlike("[0-9]"),
    "secret": lambda s: s.rlike("|".join(map(any_case, SECRET_WORDS))),
    "eyJ": lambda s: s.contains("eyJ"),
    "=": lambda s: s.contains("="),
    "://": lambda s: s.contains("://"),
    "0x": lambda s: s.contains("0x"),
    "$": lambda s: s.contains("$"),
    "-": lambda s: s.contains("-") & s.rlike(f"-{T.HEX}{{4}}-"),
    "sha": lambda s: s.startswith("sha"),
    "base64": lambda s: s.rlike(r"\A[A-Za-z0-9+/]+={0,2}\n?\z"),
}


# Tokens, secrets, cookies


def _jwt(x: Hit, o: Options) -> list[Emit]:
    m, parts = x.m, F.split(x.m, r"\.")
    head, body = T.base64_text(parts[0]), T.base64_text(parts[1])
    ok = m.startswith("eyJ") & T.base64_length_ok(parts[0]) & T.base64_length_ok(parts[1]) & T.printable(F.coalesce(head, F.lit("\x00")))
    return [Emit("jwt", [m], F.lit(85), _say("JSON web token, header {}, payload {}, signature {}", parts[0], F.coalesce(body, F.lit("")), parts[2]), ok)]


#: A line ends at a line break or at a backslash followed by n. Lines are what stands between: a pattern for a whole line would have to
#: repeat a group, which takes the regular expression engine's stack for every character.
_LINE_END = r"\r\n?|\n|\\n"
_SEGMENT = "[^=|:]+"


def _secret_hits(s: str, o: Options) -> str:
    words = f"concat_ws(',', {', '.join(f"if(line.m rlike '{any_case(w)}', '{w}', NULL)" for w in SECRET_WORDS)})"
    segment = f"transform({T.matches_sql('line.m', _SEGMENT)}, y -> struct(y.m AS m, y.at{'' if o.strict else ' + line.at'} AS at, words AS extra))"
    none = "cast(array() AS array<struct<m: string, at: int, extra: string>>)"
    of_line = f"element_at(transform(array({words}), words -> if(words <> '', {segment}, {none})), 1)"
    return f"flatten(transform({T.parts_sql(s, _LINE_END)}, line -> {of_line}))"


def _secret(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r'\A"+|"+\z', ""), r"\A'+|'+\z", ""), r"\A[ \t-\r]+|[ \t-\r]+\z", ""))
    pitfall = F.lit(False)
    for p in SECRET_PITFALLS:
        pitfall = pitfall | bare.startswith(p)
    certainty = F.lit(45) - F.when(pitfall, 25).otherwise(0) + F.when(x.random, 40).otherwise(0)
    return [Emit("secret", [m], certainty, _say("Secret near the word {}: {}", F.lit(w), m), F.array_contains(F.split(x.extra, ","), w), F.lit(w)) for w in SECRET_WORDS]


#: Parts of names of known session cookies, in lower case.
SESSION_COOKIES = ("_utm", "apsession", "sessionid", "web_session")


def _known_cookie(m: Column) -> Column:
    return F.lower(_part(m, r"\A;?([^=]+)=")).rlike("|".join(SESSION_COOKIES))


def _cookie(x: Hit, o: Options) -> list[Emit]:
    name, value = _part(x.m, r"\A;?([^=]+)="), x.part
    known = _known_cookie(x.m) & x.random
    return [Emit("web-cookie", [name, value], _scored(45, (known, 85)), _say("Cookie {} with value {}", name, value))]


def _md5(x: Hit, o: Options) -> list[Emit]:
    m, r = x.m, x.random
    return [Emit("md4", [m], _scored(10, (r, 30)), _say("MD4 digest: {}", m)), Emit("md5", [m], _scored(10, (r, 80)), _say("MD5 digest: {}", m))]


def _md5_runs(runs: str) -> str:
    """Each 32 digits of a run in turn."""
    return f"flatten(transform(filter({runs}, r -> r.n >= 32), r -> transform(regexp_extract_all(r.m, '{H}{{32}}', 0), (m, k) -> struct(m AS m, r.at + 32 * k AS at))))"


def _url(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    host, path = _part(m, r"://([^/]*)"), _part(m, r"://[^/]*(/[\s\S]*)\z")
    return [Emit("URL", [m], _scored(70, (path != "", 90)), _say("URL {}: scheme {}, host {}, path {}", m, F.lower(_part(m, r"\A([^:]+):")), host, path), host != "")]


def _digits(*groups: int) -> str:
    """Groups of digits, with a dash, a dot, a blank or nothing between them."""
    return r"[-.\s]?".join(f"[0-9]{{{n}}}" for n in groups)


#: A number with its area code in three groups, one without it in two, and one with it in brackets.
_LONG, _SHORT = _digits(3, 3, 4), _digits(3, 4)
_AREA = rf"\({_digits(3)}\)\s*{_SHORT}"


def _phone(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    number = _part(m, f"{_LONG}|{_AREA}|{_SHORT}", 0)
    sure = m.rlike(rf"\A(?:\+{_LONG}|{_AREA}|{_SHORT}[^0-9])") if "personal" in o.filters else F.lit(False)
    return [Emit("phone", [number], _scored(40, (sure, 55)), _say("Phone number: {}", number))]


#: Card brands in the order in which they are tried, and the shape of their numbers.
BRANDS = (
    ("Visa", "4[0-9]{12}(?:[0-9]{3})?"),
    ("Mastercard", "5[1-5][0-9]{14}"),
    ("American Express", "3[47][0-9]{13}"),
    ("Diners Club", "3(?:0[0-5]|[68][0-9])[0-9]{11}"),
    ("Discover", "6(?:011|5[0-9]{2})[0-9]{12}"),
    ("JCB", "(?:2131|1800|35[0-9]{3})[0-9]{11}"),
)


def _credit(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    number, brand = m, F.lit("unknown brand")
    for name, shape in reversed(BRANDS):
        number, brand = F.when(m.rlike(shape), _part(m, shape, 0)).otherwise(number), F.when(m.rlike(shape), F.lit(name)).otherwise(brand)
    return [Emit("credit", [number], _scored(45, (brand == "unknown brand", 15)), _say("Card number {} ({})", number, brand))]


# Databases and Windows


def _mssql(name: str, size: int, label: str) -> Detector:
    def emits(x: Hit, o: Options) -> list[Emit]:
        m, body = x.m, x.part
        cuts = [F.substring(body, 1, 8), F.substring(body, 9, 40), *([F.substring(body, 49, 40)] if size == 88 else [])]
        rules = [(m.startswith("0x"), 95), *([(x.random, 75)] if size == 48 else [])]
        return [Emit(name, cuts, _scored(55, *rules), _say(label + ", salt {}, hashes {}", cuts[0], F.concat_ws(" ", *cuts[1:])))]

    def found(runs: str) -> str:
        """With the header 0x0100 or without; of the longer kind only the beginning of a run need match."""
        fits = lambda n: f"r.n = {n} AND NOT r.right" if size == 48 else f"r.n >= {n}"
        bare, headed = f"(NOT r.left AND {fits(size)})", f"(r.header AND startswith(r.m, '0100') AND {fits(size + 4)})"
        return f"transform(filter({runs}, r -> {bare} OR {headed}), r -> if({bare}, struct(substring(r.m, 1, {size}) AS m, r.at AS at), struct(concat('0x', substring(r.m, 1, {size + 4})) AS m, r.at - 2 AS at)))"

    return Detector(name, (name,), ("db", "crypto", "secrets"), 95, None, emits, "hex", lambda m: F.regexp_replace(m, r"\A0x0100", ""), runs=found, needs=lambda m, upper: ~m.startswith("0x") if size == 48 else F.lit(False), about=f"optional 0x0100 header, {size} hex digits")


def _lm(x: Hit, o: Options) -> list[Emit]:
    m, c = x.m, _scored(50, (x.upper & x.random, 80), (x.upper, 60))
    return [Emit("lm", [m], c, _say("LM hash: {}", m)), Emit("ntlm", [m], c, _say("NTLM hash: {}", m))]


def _mysql4_runs(runs: str) -> str:
    """A star after a word character belongs to the match."""
    return f"transform({_whole_runs(40)(runs)}, r -> if(r.star, struct(concat('*', r.m) AS m, r.at - 1 AS at), struct(r.m AS m, r.at AS at)))"


def _mysql4(x: Hit, o: Options) -> list[Emit]:
    h = x.part
    return [Emit("MySQL4+", [h], _scored(50, (x.m.startswith("*") & x.upper & x.random, 80)), _say("MySQL 4 or later: {}", h))]


def _mysql323(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    return [Emit("MySQL323", [m], F.lit(40), _say("MySQL 3.23 or earlier: {}", m))]


def _base64_hits(s: str, o: Options) -> str:
    """The whole text (without one final line break) is padded base64."""
    bare = rf"regexp_replace({s}, r'\n\z', '')"
    return f"if(length({bare}) % 4 = 0, array(struct({bare} AS m, 0 AS at, '' AS extra)), NULL)"


def _base64(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    return [Emit("base64", [m], _scored(40, (m.endswith("="), 80)), _say("Base64 of: {}", F.coalesce(T.base64_text(m), F.lit(""))))]


_ACCOUNT = rf"(?:{W}+:[0-9]+:)?"
_PREFIX = rf"\A{W}+:[0-9]+:"


def _sam_ntlm(x: Hit, o: Options) -> list[Emit]:
    m, h, sure = x.m, x.part, x.upper & x.random
    return [Emit("SAM(*:ntlm)", [h], _scored(40, (sure & m.rlike(_PREFIX), 85), (sure, 70)), _say("SAM entry without LM hash, NTLM: {}", h), F.lit(not o.strict))]


def _sam_lm(x: Hit, o: Options) -> list[Emit]:
    h = x.part
    return [Emit("SAM(lm:*)", [h], _scored(40, (x.upper & x.random, 70), (x.random, 85)), _say("SAM entry without NTLM hash, LM: {}", h))]


def _sam_both(x: Hit, o: Options) -> list[Emit]:
    m, lm, ntlm = x.m, x.part, F.right(x.m, F.lit(32))
    sure = m.rlike(_PREFIX) & x.random & T.random_looking(ntlm)
    return [Emit("SAM(lm:ntlm)", [lm, ntlm], _scored(50, (sure & T.upper_or_digits(F.concat(lm, ntlm)), 90), (sure, 80)), _say("SAM entry, LM: {}, NTLM: {}", lm, ntlm))]


def _sha512(x: Hit, o: Options) -> list[Emit]:
    m, r = x.m, x.random
    return [Emit("sha512", [m], _scored(15, (r, 65)), _say("SHA-512 digest: {}", m)), Emit("whirlpool", [m], _scored(5, (r, 20)), _say("Whirlpool digest: {}", m))]


#: Checksum families by their number of hex digits.
CRC_FAMILIES = {1: "CRC-1 or CRC-4", 2: "CRC-4 to CRC-8", 3: "CRC-10, CRC-11 or CRC-12", 4: "CRC-15 or CRC-16", 6: "CRC-24", 8: "CRC-30 or CRC-32", 10: "CRC-40", 16: "CRC-64"}


def _crc(x: Hit, o: Options) -> list[Emit]:
    digits = F.substring(x.m, 3, 16)
    n, family = F.length(digits), F.lit("of no known length")
    for k, name in CRC_FAMILIES.items():
        family = F.when(n == k, F.lit(name)).otherwise(family)
    return [Emit("CRC", [digits], _scored(0, (n.isin(*CRC_FAMILIES), 15)), _say("Checksum {}: {}", family, digits))]


# Unix and web accounts


#: Exactly 13 characters, no $ before. What stands before is looked back at: matched as what is none of these, it takes Java ten times as long.
_DES_RUN = rf"(?<![A-Za-z0-9./$]){C}{{13}}(?!{C})"


def _des(x: Hit, o: Options) -> list[Emit]:
    salt, h = F.substring(x.m, 1, 2), F.substring(x.m, 3, 11)
    return [Emit("des-salt-unix", [salt, h], F.lit(80 if o.filters == ("unix",) else 55), _say("Unix DES, salt {}, hash {}", salt, h))]


def _django(name: str, algorithm: str, salted: bool, salt: str, size: int) -> Detector:
    shape = rf"\A{algorithm}\${salt + '+' if salted else ''}\${C}{{{size}}}(?=\n?\z)"

    def emits(x: Hit, o: Options) -> list[Emit]:
        s, h = _part(x.m, r"\A[^$]+\$([^$]*)\$"), F.right(x.m, F.lit(size))
        when = ~s.contains("/") if o.strict and salted else None
        return [Emit(name, [s, h] if salted else [h], F.lit(65), _say("Django account, salt {}, hash {}", s, h), when)]

    return Detector(name, (name,), ("crypto", "web"), 65, shape, emits, "sha", whole=True, needs=never, about=f"the whole text is {algorithm}, a salt or none, and {size} characters")


def _crypt(name: str, mark: str, salt: str, size: int, base: int, boosted: int, categories: tuple[str, ...], label: str, before: str = "") -> Detector:
    def emits(x: Hit, o: Options) -> list[Emit]:
        s, h = _part(x.m, rf"({C}+)\${C}{{{size}}}\z"), x.part
        return [Emit(name, [s, h], _scored(base, (x.random, boosted)) if boosted > base else F.lit(base), _say(label + ", salt {}, hash {}", s, h))]

    return Detector(name, (name,), categories, boosted, rf"{before}{mark}{C}{{{salt}}}\${C}{{{size}}}(?!{C})", emits, "$", lambda m: F.right(m, F.lit(size)), needs=None if boosted > base else never, about=f"{label}: salt of {salt}, hash of {size}")


_RUN = "(?<![A-Za-z0-9.])"


def _run31(name: str, label: str) -> Detector:
    return Detector(name, (name,), ("crypto", "web"), 45, f"{_RUN}{C}{{31}}(?![A-Za-z0-9.=/])", lambda x, o: [Emit(name, [x.m], F.lit(45), _say(label + ": {}", x.m))], "run", needs=never, about="31 characters of a crypt hash")


def _joomla(version: int) -> Callable[[Column, Column, Options], list[Emit]]:
    def emits(x: Hit, o: Options) -> list[Emit]:
        h, salt = F.substring(x.m, 1, 32), F.substring(x.m, 34, 32)
        lower, salted = h.rlike(r"\A[a-z0-9./]*\z"), x.m.contains(":") if o.extended else F.lit(False)
        bare = Emit(f"md5-joomla{version}", [h], F.lit(45 if version == 1 else 50), _say("Joomla {} account, hash {}", F.lit(version), h), lower & ~salted & F.lit(version == 1 or o.extended))
        return [Emit(f"md5-salt-joomla{version}", [h, salt], F.lit(85), _say("Joomla {} account, hash {}, salt {}", F.lit(version), h, salt), lower & salted), bare]

    return emits


#: What a UUID's version digit says.
UUID_VERSIONS = {"1": "from time and MAC address", "2": "DCE security", "3": "from an MD5 hash", "4": "random", "5": "from a SHA-1 hash"}


def _uuid(x: Hit, o: Options) -> list[Emit]:
    m = x.m
    version, variant = F.substring(m, 15, 1), F.lower(F.substring(m, 20, 1))
    known = version.isin("1", "2", "3", "5") | (version == "4") & variant.isin("8", "9", "a", "b")
    kind = F.lit("of unknown version")
    for v, name in UUID_VERSIONS.items():
        kind = F.when((version == v) & known, F.lit(name)).otherwise(kind)
    return [Emit("uuid", [m], _scored(5, (known, 75)), _say("UUID {}, version {}: {}", kind, version, m))]


#: Where a run of these begins, all of it is tried at once; from within it nothing else would come.
_ID, _NAME = "[A-Za-z0-9_-]", r"[A-Za-z0-9_:|\-$&%#@]"
#: Names, lengths, alphabets, marks, categories and certainties define the types; they are stated as they must be.
CATALOGUE: tuple[Detector, ...] = (
    Detector("jwt", ("jwt",), ("web", "crypto", "secrets"), 85, rf"(?<!{_ID}){_ID}++\.{_ID}++\.{_ID}*+", _jwt, "eyJ", needs=never, about="three dotted base64url parts, the last may be empty"),
    Detector("secret", ("secret",), ("crypto", "secrets"), 85, None, _secret, "secret", hits=_secret_hits, about="parts of lines that mention a password, key or security"),
    Detector("web-cookie", ("web-cookie",), ("web", "crypto"), 85, rf"(?:;|(?<!{_NAME})){_NAME}++=[^; \t\n\x0B\f\r]++", _cookie, "=", lambda m: _part(m, r"\A[^=]+=([\s\S]*)\z"), needs=lambda m, upper: _known_cookie(m), about="name=value"),
    Detector("md5", ("md4", "md5"), ("web", "unix", "crypto", "other"), 80, None, _md5, "hex", runs=_md5_runs, about="32 hex digits, also within longer runs"),
    Detector("URL", ("URL",), ("web", "personal", "other"), 90, rf"(?<![A-Za-z0-9])[A-Za-z0-9]++://{C}+{T.EDGE}", _url, "://", needs=never, about="scheme://host/path"),
    Detector("phone", ("phone",), ("web", "personal", "other"), 55, f"[^0-9]{_LONG}|{_AREA}|{_SHORT}[^0-9]", _phone, "digits", needs=never, about="ten digits after, or seven before, something else; area code in brackets"),
    Detector("credit", ("credit",), ("personal",), 45, f"{_L}[0-9](?:[ -]*+[0-9]){{12,15}}{_R}", _credit, "digits", needs=never, about="13 to 16 digits with blanks or dashes"),
    _mssql("mssql2005", 48, "Microsoft SQL Server 2005"),
    _mssql("mssql2000", 88, "Microsoft SQL Server 2000"),
    Detector("lm", ("lm", "ntlm"), ("win", "crypto", "secrets"), 80, None, _lm, "hex", runs=lambda runs: f"filter({runs}, r -> r.n = 32)", needs=lambda m, upper: upper, about="exactly 32 hex digits"),
    Detector("MySQL4+", ("MySQL4+",), ("db", "crypto", "secrets"), 80, None, _mysql4, "hex", lambda m: F.regexp_replace(m, r"\A\*", ""), runs=_mysql4_runs, needs=lambda m, upper: m.startswith("*") & upper, about="40 hex digits, optionally after *"),
    Detector("MySQL323", ("MySQL323",), ("db", "crypto", "secrets"), 40, None, _mysql323, "hex", runs=_whole_runs(16), needs=never, about="16 hex digits"),
    Detector("base64", ("base64",), ("other",), 80, None, _base64, "base64", hits=_base64_hits, whole=True, needs=never, about="the whole text is padded base64"),
    Detector("SAM(*:ntlm)", ("SAM(*:ntlm)",), ("win", "crypto"), 85, rf"\A{_ACCOUNT}\*?:{H}{{32}}(?!{H})", _sam_ntlm, "hex", lambda m: F.right(m, F.lit(32)), anchored=True, needs=lambda m, upper: upper, about="account without LM hash"),
    Detector("SAM(lm:*)", ("SAM(lm:*)",), ("win", "crypto", "secrets"), 85, rf"\A{_ACCOUNT}{H}{{32}}:\*", _sam_lm, "hex", lambda m: _part(m, rf"({H}{{32}}):\*\z"), anchored=True, about="account without NTLM hash"),
    Detector("SAM(lm:ntlm)", ("SAM(lm:ntlm)",), ("win", "crypto", "secrets"), 90, rf"\A{_ACCOUNT}{H}{{32}}:{H}{{32}}{_R}", _sam_both, "hex", lambda m: _part(m, rf"({H}{{32}}):{H}{{32}}\z"), anchored=True, about="account with both hashes"),
    _digest("RipeMD320", 80, 10, 10, "RIPEMD-320 digest"),
    _digest("sha1", 40, 15, 65, "SHA-1 digest"),
    _digest("sha224", 56, 15, 65, "SHA-224 digest"),
    _digest("sha256", 64, 15, 65, "SHA-256 digest"),
    _digest("sha384", 96, 15, 65, "SHA-384 digest"),
    Detector("sha512", ("sha512", "whirlpool"), ("crypto", "other"), 65, None, _sha512, "hex", runs=_whole_runs(128), about="128 hex digits"),
    Detector("CRC", ("CRC",), ("other",), 15, f"0x{H}{{1,16}}{_R}", _crc, "0x", needs=never, about="0x and up to 16 hex digits"),
    Detector("des-salt-unix", ("des-salt-unix",), ("crypto", "unix"), 80, _DES_RUN, _des, "des run", needs=never, about="exactly 13 characters of a crypt hash"),
    _django("sha256-salt-django", "(?:sha256|sha1)", True, "[A-Za-z0-9./]", 64),
    _django("sha256-django", "(?:sha256|sha1)", False, "", 64),
    _django("sha384-salt-django", "sha384", True, "[A-Za-z0-9.]", 96),
    _django("sha384-django", "sha384", False, "", 96),
    _crypt("sha256-salt-unix", r"\$5\$", "8,16", 43, 55, 55, ("crypto", "unix"), "Unix SHA-256 account"),
    _crypt("sha512-salt-unix", r"\$6\$", "8,16", 86, 55, 55, ("crypto", "unix"), "Unix SHA-512 account"),
    _crypt("apr1-salt-unix", r"\$apr1\$", "8", 22, 45, 45, ("crypto", "web"), "Apache MD5 account"),
    _crypt("md5-salt-unix", "", "8", 22, 45, 80, ("crypto", "unix"), "Unix MD5 account", _RUN),
    _run31("md5-wordpress", "WordPress account, hash"),
    _run31("md5-phpBB3", "phpBB 3 account, hash"),
    Detector("md5-joomla2", ("md5-salt-joomla2", "md5-joomla2"), ("crypto", "web"), 85, rf"{_RUN}{C}{{32}}(?::{C}{{32}})?(?!{C})", _joomla(2), "run", needs=never, about="32 characters, optionally : and 32 more (extended only)"),
    Detector("md5-joomla1", ("md5-salt-joomla1", "md5-joomla1"), ("crypto", "web"), 85, rf"{_RUN}{C}{{32}}(?::{C}{{16}})?(?!{C})", _joomla(1), "run", needs=never, about="32 characters, optionally : and 16 more"),
    _crypt("blowfish-salt-unix", "", "2", 53, 55, 85, ("crypto", "unix"), "Unix Blowfish account", r"(?<=\$2\$|\$2a\$)"),
    Detector("uuid", ("uuid",), ("other",), 75, rf"(?<!{H}){H}{{8}}-{H}{{4}}-{H}{{4}}-{H}{{4}}-{H}{{12}}(?!{H})", _uuid, "-", needs=never, about="8-4-4-4-12 hex digits"),
)


def active(options: Options, min_certainty: int = 0) -> list[tuple[int, Detector]]:
    """Detectors of these categories that can reach the certainty, with their places in the catalogue."""
    out = []
    for i, d in enumerate(CATALOGUE):
        if not set(d.categories) & set(options.filters) or d.most < min_certainty:
            continue
        if d.name == "md5-joomla2" and not options.extended or d.name == "SAM(*:ntlm)" and options.strict:
            continue
        out.append((i, d))
    return out
