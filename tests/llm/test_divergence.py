"""The divergence audit against a plain version and its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tracelode.llm import divergence as D

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, term string, lang string, source string, n long, item string, doc_id long"


def plain(rows, least=D.LEAST, top=D.TOP):
    """rows: lang, source, text."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(D.TERM, text or "")]
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, sources = len(kept), sorted(s for g, s in groups if g == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        of[None] = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(x.values()) + 2 * v) for t, c in x.items()} for s, x in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if of[s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, part, item.decode(), -value, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (value, item) in enumerate(found)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, "x", lang, s, 7, "clash", i) for i, (lang, s, t) in enumerate(rows)], SCHEMA)


WORDS = "Alpha beta GAMMA ünï Ünï ζ β b 漢字 😀x a1b2c don't e-f [x] {y} \\z \x7fq ÿ".split(" ")
CASES = {
    "empty": [],
    "nulls": [(None, None, None), (None, "s", "x y"), ("en", None, None), (None, None, "")],
    "nothing kept": [("en", s, "one two") for s in "abc"] + [("de", "a", "drei")],
    "ties": [("en", "ab"[i % 2], "same words here") for i in range(24)],
    "some": [(["en", "de", None][i % 3], f"s{i * i % 5}", " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 9))) for i in range(120)] + [("en", "bare", "")] * 2,
    "long": [("en", "long", "lorem ipsum dolor " * 100_000)] + [("en", "b", "lorem dolor dolor")] * 12,
    "hot": [("en", "hot" if i % 3 else f"s{i % 7}", f"w{'abc'[i % 3]} common {'rare' if i % 29 == 0 else ''}") for i in range(900)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name, tmp_path):
    rows = CASES[name]
    want = plain(rows)
    assert Counter(map(tuple, D.audit(frame(spark, rows)).collect())) == want
    frame(spark, rows).toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select doc_id, {', '.join(f'cast({c} as varchar) as {c}' for c in ('text', 'lang', 'source'))} from '{tmp_path}/d.parquet'")
    assert Counter(con.sql(D.SQL).fetchall()) == want


def test_large_counts(spark):
    """Shares don't overflow: 10^9 times a count is above 64 bits."""
    n, d = 10**17, 3 * 10**17
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(d).alias("d")).select(D.share("n", "d").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // d


def test_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()]
    got = D.query(spark, SF)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    found = Counter(map(tuple, got.collect()))
    assert found == plain(rows) and len(found) > 1000
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert found == Counter(con.sql(D.SQL).fetchall())
