"""Detectors on small texts: what fires, with which payload, place and certainty."""

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tracelode.functions import text as T
from tracelode.operators.scan import scan
from tracelode.plans.catalogue import CATALOGUE

from pyspark.sql import functions as F

A32 = "563DE3D2F07D0747BBE4BA2697AE33AA"
B32 = "7db9d24c238b77af11b99f0a67e99abe"
S40 = hashlib.sha1(b"x").hexdigest()
P22, P43, P53, P86 = "3lzrzB14HceT7uc3oTmog1", "5B8vYYiY.CVt1RlTTf8KbXBH3hsxY/GNooZaBBGWEc8", "Nh8Vn2oLYzVmZ1yQkq7bu.RkzGdYQyXcPsNIV0eJ7u8W4mLr2tHqE", "svn8UoSVapNtMuq1ukKS4tPQd8iKwSMHWjlO/O817G3uBnIFNjnQJuesI68OTLiBFdcbYEdFCoEOfaS35inz1"
P86 = (P86 + "aB")[:86]


def run(spark, rows, **options):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    out = {}
    for r in scan(df, ids=["id"], **options).orderBy("id", "detector_seq", "match_seq").collect():
        out.setdefault(r.id, []).append(r)
    return [out.get(i, []) for i in range(len(rows))]


def brief(found, *types):
    return [(r.type, tuple(r.payload), r.location, r.certainty) for r in found if not types or r.type in types]


CASES = [
    # text, types looked at, expected (type, payload, location, certainty)
    (f"a {S40} b", ("sha1", "MySQL4+"), [("MySQL4+", (S40,), 2, 50), ("sha1", (S40,), 2, 65)]),
    (f"é{S40}é", ("sha1",), [("sha1", (S40,), 1, 65)]),
    (f"_{S40}", ("sha1",), []),
    (f"x*{S40.upper()}", ("MySQL4+",), [("MySQL4+", (S40.upper(),), 1, 80)]),
    (f"*{S40.upper()}", ("MySQL4+",), [("MySQL4+", (S40.upper(),), 1, 50)]),
    ("0" * 40, ("sha1",), [("sha1", ("0" * 40,), 0, 15)]),
    ("ab" * 35, ("md4", "md5"), [("md4", ("ab" * 16,), 0, 10), ("md5", ("ab" * 16,), 0, 10), ("md4", ("ab" * 16,), 32, 10), ("md5", ("ab" * 16,), 32, 10)]),
    (A32, ("lm", "ntlm"), [("lm", (A32,), 0, 80), ("ntlm", (A32,), 0, 80)]),
    (B32, ("lm",), [("lm", (B32,), 0, 50)]),
    ("A" * 32, ("lm",), [("lm", ("A" * 32,), 0, 60)]),
    (A32 + "a", ("lm",), []),
    ("5850478A34D818CE", ("MySQL323",), [("MySQL323", ("5850478A34D818CE",), 0, 40)]),
    (f"0x0100{S40}{'1234abcd'}", ("mssql2005",), [("mssql2005", (S40[:8], S40[8:] + "1234abcd"), 0, 95)]),
    (f"{S40}1234abcd", ("mssql2005",), [("mssql2005", (S40[:8], S40[8:] + "1234abcd"), 0, 75)]),
    (f"0x0100{S40}{S40}00000000ff", ("mssql2000",), [("mssql2000", (S40[:8], S40[8:] + S40[:8], S40[8:] + "00000000"), 0, 95)]),
    (f"Bob:500:{A32}:{A32}:::", ("SAM(lm:ntlm)",), [("SAM(lm:ntlm)", (A32, A32), 0, 90)]),
    (f"{B32}:{B32}", ("SAM(lm:ntlm)",), [("SAM(lm:ntlm)", (B32, B32), 0, 50)]),
    (f"Bob:500:{B32}:*", ("SAM(lm:*)",), [("SAM(lm:*)", (B32,), 0, 85)]),
    (f"Bob:500:{A32}:*", ("SAM(lm:*)",), [("SAM(lm:*)", (A32,), 0, 70)]),
    (f"Bob:500:*:{A32}", ("SAM(*:ntlm)",), [("SAM(*:ntlm)", (A32,), 0, 85)]),
    (f":{A32}", ("SAM(*:ntlm)",), [("SAM(*:ntlm)", (A32,), 0, 70)]),
    (f"x :{A32}", ("SAM(*:ntlm)",), []),
    ("dGVzdGUK", ("base64",), [("base64", ("dGVzdGUK",), 0, 40)]),
    ("dGVzdA==\n", ("base64",), [("base64", ("dGVzdA==",), 0, 80)]),
    ("dGVzdA=", ("base64",), []),
    ("at 0xff and 0x12345", ("CRC",), [("CRC", ("ff",), 3, 15), ("CRC", ("12345",), 12, 0)]),
    ("a 550e8400-e29b-41d4-a716-446655440000", ("uuid",), [("uuid", ("550e8400-e29b-41d4-a716-446655440000",), 2, 75)]),
    ("550e8400-e29b-41d4-c716-446655440000", ("uuid",), [("uuid", ("550e8400-e29b-41d4-c716-446655440000",), 0, 5)]),
    ("see http://a.b/c. ftp://x file:///y", ("URL",), [("URL", ("http://a.b/c",), 4, 90), ("URL", ("ftp://x",), 18, 70)]),
    ("call +123-000-0000", ("phone",), [("phone", ("123-000-0000",), 5, 55)]),
    ("(123) 456-7890", ("phone",), [("phone", ("(123) 456-7890",), 0, 55)]),
    (" 1234567890", ("phone",), [("phone", ("1234567890",), 0, 40)]),
    ("378282246310005", ("credit",), [("credit", ("378282246310005",), 0, 45)]),
    ("4111 1111 1111 1111", ("credit",), [("credit", ("4111 1111 1111 1111",), 0, 15)]),
    ("12345678901234567", ("credit",), []),
    ("JSESSIONID=PUYQGHUMEAAJPUYLA9;x=1", ("web-cookie",), [("web-cookie", ("JSESSIONID", "PUYQGHUMEAAJPUYLA9"), 0, 85), ("web-cookie", ("x", "1"), 29, 45)]),
    ("password = hunter2", ("secret",), [("secret", ("password ",), 0, 45), ("secret", (" hunter2",), 10, 45)]),
    ("api_key: Zx81-kq7Lw0pVb93\\nplain: text", ("secret",), [("secret", ("api_key",), 0, 45), ("secret", (" Zx81-kq7Lw0pVb93",), 8, 85)]),
    ("pass: true", ("secret",), [("secret", ("pass",), 0, 45), ("secret", (" true",), 5, 20)]),
    (f"u:$1$hanhd/cF${P22}:1", ("md5-salt-unix",), [("md5-salt-unix", ("hanhd/cF", P22), 5, 80)]),
    (f"$apr1$abcdefgh${P22}", ("apr1-salt-unix", "md5-salt-unix"), [("apr1-salt-unix", ("abcdefgh", P22), 0, 45), ("md5-salt-unix", ("abcdefgh", P22), 6, 80)]),
    (f"$5$saltsalt${P43}", ("sha256-salt-unix",), [("sha256-salt-unix", ("saltsalt", P43), 0, 55)]),
    (f"$6$saltsalt${P86}", ("sha512-salt-unix",), [("sha512-salt-unix", ("saltsalt", P86), 0, 55)]),
    (f"$2a$10${P53}", ("blowfish-salt-unix",), [("blowfish-salt-unix", ("10", P53), 4, 85)]),
    (f"10${P53}", ("blowfish-salt-unix",), []),
    ("root:abcdefghijklm:", ("des-salt-unix",), [("des-salt-unix", ("ab", "cdefghijklm"), 5, 55)]),
    ("$P$" + "B" * 31, ("md5-wordpress", "md5-phpBB3"), [("md5-wordpress", ("B" * 31,), 3, 45), ("md5-phpBB3", ("B" * 31,), 3, 45)]),
    (f"{B32}:YEfafQuaj58ExG3V", ("md5-joomla1", "md5-salt-joomla1"), [("md5-joomla1", (B32,), 0, 45)]),
    ("sha1$ab.c$" + "a" * 64, ("sha256-salt-django",), [("sha256-salt-django", ("ab.c", "a" * 64), 0, 65)]),
    ("sha256$$" + "a" * 64 + "\n", ("sha256-django",), [("sha256-django", ("a" * 64,), 0, 65)]),
    ("sha384$s$" + "a" * 96, ("sha384-salt-django",), [("sha384-salt-django", ("s", "a" * 96), 0, 65)]),
    ("eyJhbGciOiJub25lIn0.eyJhIjoxfQ", ("jwt",), []),
    ("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJhIjox.c2ln", ("jwt",), [("jwt", ("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJhIjox.c2ln",), 0, 85)]),
    (S40 * 2, ("RipeMD320",), [("RipeMD320", (S40 * 2,), 0, 10)]),
    ((S40 * 4)[:128], ("sha512", "whirlpool"), [("sha512", ((S40 * 4)[:128],), 0, 65), ("whirlpool", ((S40 * 4)[:128],), 0, 20)]),
    *[((S40 * 3)[:n], (name,), [(name, ((S40 * 3)[:n],), 0, 65)]) for n, name in ((56, "sha224"), (64, "sha256"), (96, "sha384"))],
    (None, (), []),
    ("", (), []),
]


def test_cases(spark):
    got = run(spark, [c[0] for c in CASES])
    for (text, types, want), found in zip(CASES, got):
        assert brief(found, *types) == want, text


def test_sizes_locations_confidence(spark):
    (found,) = run(spark, [f"=x ;name={A32} {S40} +123-000-0000."])
    text = f"=x ;name={A32} {S40} +123-000-0000."
    assert found
    for r in found:
        match = text[r.location : r.location + r.size]
        assert len(match) == r.size and all(p in match for p in r.payload)
        assert r.confidence == ("confident" if r.certainty >= 80 else "likely" if r.certainty >= 60 else "possible")


def test_filters_prune_detectors(spark):
    text = f"{A32} http://a.b/c 0xff 378282246310005 secret_key=abc"
    df = spark.createDataFrame([(text,)], "text string")
    types = lambda *f: {r.type for r in scan(df, filters=f).collect()}
    assert types("win") == {"lm", "ntlm"} and types("nothing") == set() and "credit" not in types("web")
    assert types("secrets") == {"lm", "ntlm", "secret"} and types("personal") >= {"credit", "URL", "phone"}
    assert {r.certainty for r in scan(df.selectExpr("'abcdefghijklm' as text"), filters=["unix"], detectors=["des-salt-unix"]).collect()} == {80}
    low = scan(df, min_certainty=80).collect()
    assert low and all(r.certainty >= 80 for r in low)
    assert "RipeMD320" not in scan(df, min_certainty=50)._jdf.queryExecution().optimizedPlan().toString()


def test_strict_and_extended(spark):
    salted = f"{B32}:YEfafQuaj58ExG3V"
    assert brief(run(spark, [salted], extended=True)[0], "md5-salt-joomla1", "md5-joomla1") == [("md5-salt-joomla1", (B32, "YEfafQuaj58ExG3V"), 0, 85)]
    assert brief(run(spark, [f"{B32}:{B32}"], extended=True)[0], "md5-salt-joomla2") == [("md5-salt-joomla2", (B32, B32), 0, 85)]
    assert brief(run(spark, [f":{A32}"], strict=True)[0], "SAM(*:ntlm)") == []
    assert brief(run(spark, ["sha1$a/c$" + "a" * 64], strict=True)[0], "sha256-salt-django") == []
    assert [r.location for r in run(spark, ["x\npass: y"], strict=True)[0] if r.type == "secret"] == [0, 5]
    assert [r.location for r in run(spark, ["x\npass: y"])[0] if r.type == "secret"] == [2, 7]


def test_keywords_repeat(spark):
    found = [r for r in run(spark, ["pass key: v"])[0] if r.type == "secret"]
    assert [(r.payload[0], r.keyword) for r in found] == [("pass key", "pass"), ("pass key", "key"), (" v", "pass"), (" v", "key")]


def test_no_python_and_no_shuffle(spark):
    plan = scan(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_entropy(spark):
    got = spark.createDataFrame([("aab",), ("",), ("abcd",)], "s string").select(T.entropy(F.col("s"))).collect()
    assert [round(r[0], 6) for r in got] == [0.918296, 0, 2]
    # thousands of different characters, line ends and characters beyond 16 bits, in time that doesn't depend on how many differ
    rng = random.Random(1)
    texts = ["".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(200_000)), "a" * 200_000, "aab\n\n\r\U0001f600\U0001f600\u00e9\x00", "A a"]
    begun = time.time()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.entropy(F.col("s"))).collect()]
    assert time.time() - begun < 20
    want = [-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) for t in texts]
    assert all(abs(a - b) < 1e-9 and a >= 0 for a, b in zip(got, want))


def test_catalogue_names_are_unique():
    names = [t for d in CATALOGUE for t in d.types]
    assert len(names) == len(set(names)) and {"jwt", "secret", "whirlpool", "uuid"} <= set(names)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.text(alphabet="aF09$:=./-*;@ \nxé_", max_size=120), min_size=5, max_size=30))
def test_total_on_anything(spark, rows):
    for text, found in zip(rows, run(spark, rows, extended=True)):
        for r in found:
            assert 0 <= r.location and r.location + r.size <= len(text)
            assert all(p in text for p in r.payload) and 0 <= r.certainty <= 95


def test_long_text(spark):
    text = f"{'word ' * 100000}{S40} {'ab' * 20000}"
    found = run(spark, [text], detectors=["sha1", "md5"])[0]
    assert brief(found, "sha1") == [("sha1", (S40,), 500000, 65)] and sum(r.type == "md5" for r in found) == 1 + 1250


def test_time_is_linear_in_matches(spark):
    import time

    def took(text, *names):
        df = spark.createDataFrame([(text,)], "text string")
        start = time.perf_counter()
        n = scan(df, detectors=names).count()
        return n, time.perf_counter() - start

    took("a=1;b", "web-cookie")
    for one, name in (("ab=cd12 ", "web-cookie"), (f"{A32} ", "lm"), ("x555-1234", "phone")):
        few, short = took(one * 20_000, name)
        many, long = took(one * 80_000, name)
        assert abs(many - 4 * few) < 5 and long < 30 and long < 10 * short + 3


HEX_RULES = {
    "md5": r"[0-9A-Fa-f]{32}", "lm": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32}(?![0-9A-Fa-f])", "MySQL323": r"\b[0-9A-Fa-f]{16}\b", "MySQL4+": r"(?:(?<=\w)\*|\b)[0-9A-Fa-f]{40}\b",
    "mssql2005": r"\b(?:0x0100)?[0-9A-Fa-f]{48}\b", "mssql2000": r"\b(?:0x0100)?[0-9A-Fa-f]{88}", **{k: rf"\b[0-9A-Fa-f]{{{n}}}\b" for k, n in (("RipeMD320", 80), ("sha1", 40), ("sha224", 56), ("sha256", 64), ("sha384", 96), ("sha512", 128))},
}


def test_hex_runs_by_brute_force(spark):
    """Each rule as a pattern of its own, against the runs that are found once."""
    import random
    import re

    rng = random.Random(7)
    pieces = [*"xg_*. 0é:", "0x", "0x0100", " 0x0100", "w*", "*", " "]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice((3, 15, 16, 17, 32, 40, 44, 48, 52, 56, 64, 80, 88, 92, 96, 128, 300)))) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    got = run(spark, texts, detectors=list(HEX_RULES))
    first = {"md5": "md4", "lm": "lm", "sha512": "sha512"}
    for text, found in zip(texts, got):
        for name, rule in HEX_RULES.items():
            want = [(m.start(), len(m[0])) for m in re.finditer(rule, text, re.ASCII)]
            assert [(r.location, r.size) for r in found if r.type == first.get(name, name)] == want, (name, text)


MD5, LM, SHA1 = [("md4", 30), ("md5", 80)], [("lm", 80), ("ntlm", 80)], [("MySQL4+", 50), ("sha1", 65)]
#: Lines as they come from standard input, and all that the default detectors find in them.
LINES = [
    ("web_sessionid=hQ7xW2kPz9LmB4tR\n", [("web-cookie", 85)]), ("http://www.example.org\n", [("URL", 70)]), ("ftp://example.com/x\n", [("URL", 90)]),
    (f"Administrator:500:{A32}:{A32}:::\n", [*MD5, *MD5, *LM, *LM, ("SAM(lm:ntlm)", 90), ("des-salt-unix", 55)]), (f"u:$1$hanhd/cF${P22}:1\n", [("md5-salt-unix", 80)]), (f"{A32}\n", [*MD5, *LM, ("base64", 40)]),
    (f"{B32}\n", [*MD5, ("lm", 50), ("ntlm", 50), ("base64", 40), ("md5-joomla1", 45)]), (f"{S40}\n", [*MD5, *SHA1, ("base64", 40), ("phone", 55)]), ("5850478A34D818CE\n", [("MySQL323", 40), ("base64", 40), ("phone", 55)]),
    ("+123-000-0000\n", [("phone", 55)]), ("000-000-0000\n", [("phone", 55)]), ("000-000-0000", []), ("378282246310005\n", [("phone", 55), ("credit", 45)]), ("4111 1111 1111 1111\n", [("phone", 55), ("phone", 55), ("credit", 15)]), ("dGVzdGUK\n", [("base64", 40)]),
]


def test_all_findings_of_lines(spark):
    for (line, want), found in zip(LINES, run(spark, [x for x, _ in LINES])):
        assert sorted((r.type, r.certainty) for r in found) == sorted(want), line


def test_entropy_only_where_it_matters(spark, monkeypatch):
    """The certainty is the same if the entropy of every hit is worked out."""
    import dataclasses
    import hashlib
    import importlib

    module = importlib.import_module("tracelode.operators.scan")
    a, b, c = hashlib.md5(b"a").hexdigest(), hashlib.sha1(b"b").hexdigest(), hashlib.sha512(b"c").hexdigest()
    flat = ["0" * n for n in (16, 32, 40, 48, 80, 88)]
    texts = [a, a.upper(), "*" + b.upper(), "x*" + b, b, "x*" + "A" * 40, c[:48], "0x0100" + c[:48], c[:88], c[:80], f"u:1:*:{a.upper()}", f"*:{a}", "sessionid=" + c, "sessionid=aaaa", "id=" + c, f"{a}:{b[:16]}", c[:13], *flat, "*" + flat[2]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = lambda: sorted((r.id, r.type, r.location, r.certainty) for r in module.scan(df, ids=["id"], filters=module.DEFAULT + ("secrets",), extended=True).collect())
    lazy, of = found(), module.active
    assert sum(d.needs is not None for _, d in of(module.Options())) > 15
    monkeypatch.setattr(module, "active", lambda *x: [(i, dataclasses.replace(d, needs=None)) for i, d in of(*x)])
    assert lazy == found()


def test_des_runs_and_base64_by_brute_force(spark):
    """Words of 13 characters without a $ before, at their places; no text is searched for what is in none of some ranges."""
    import base64
    import random
    import re

    from tracelode.functions import text as T
    from tracelode.operators.scan import scan
    from tracelode.plans.catalogue import CATALOGUE

    rng = random.Random(5)
    texts = ["".join(rng.choice(["abcdefghijklm", "a", "./A9", "$", " ", "é", "\n", "😀"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = sorted((r.id, "".join(r.payload)) for r in scan(df, ids=["id"], detectors=["des-salt-unix"]).collect())
    assert found == sorted((i, m) for i, t in enumerate(texts) for m in re.findall(r"(?<![A-Za-z0-9./$])[A-Za-z0-9./]{13}(?![A-Za-z0-9./])", t)) and found
    des, cookie = (next(d for d in CATALOGUE if d.name == n) for n in ("des-salt-unix", "web-cookie"))
    assert des.hits is None and "[^A-Z" not in des.pattern and r"[^;\s]" not in cookie.pattern
    wrapped = [base64.b64encode(t.encode()).decode() for t in texts] + [" Q-U_J D\n", "QUJ", "", "é"]
    made = spark.createDataFrame([(t,) for t in wrapped], "t string").select("t", T.base64_text(F.col("t")).alias("text"), T.base64_length_ok(F.col("t")).alias("ok")).collect()
    for t, text, ok in made:
        bare = re.sub(r"[^A-Za-z0-9+/=]", "", t)
        assert text == (base64.b64decode(bare).decode("latin-1") if len(bare) % 4 == 0 else None) and ok == (len(re.sub(r"=", "", bare)) % 4 == 0)


def test_hex_digits_are_counted_by_bits(spark):
    """With the very sums of entropy, also of long runs and of letters of both cases; such hits, and no others, leave the characters alone."""
    rng = random.Random(9)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFabcdef", "01", "f", "0", "23456789ab"]
    texts = [("".join(rng.choices(a, k=n)),) for n in [*range(1, 34), 40, 47, 48, 56, 63, 64, 65, 80, 96, 127, 128, 129, 200] for a in alphabets]
    df = spark.createDataFrame([*texts, ("",), (None,)], "s string").repartition(4)
    seen = T.with_random_looking(df, "s", F.lit(True), "r").withColumn("want", F.coalesce(T.random_looking(F.col("s")), F.lit(False))).cache()
    assert seen.count() == len(texts) + 2 and seen.filter("r <=> want").count() == len(texts) + 2 and 0 < seen.filter("r").count() < len(texts)
    short = [t for (t,) in texts if len(t) <= T.MOST_HEX and t in (t.lower(), t.upper())]
    assert sorted(r.s for r in seen.filter("r_hex IS NOT NULL").collect()) == sorted(short)
    summed = seen.filter("r_hex IS NOT NULL").withColumn("bits", T._bits(F.length("s"), F.col("r_sums")))
    assert summed.filter(F.col("bits") == T.entropy(F.col("s"))).count() == len(short)
    other = T.with_random_looking(df, "s", F.lit(False), "r")
    assert other.filter("r_hex IS NOT NULL").count() == 0
    found = spark.createDataFrame([("d41d8cd98f00b204e9800998ecf8427e",)], "text string")
    plan = scan(found, detectors=["md5"])._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in plan and "_random_hex" in plan
