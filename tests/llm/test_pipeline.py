import hashlib

import corpus_pipeline as P
import test_decontamination
import test_packing
import test_repeats
import test_simhash
import test_similar
from pyspark.sql import functions as F
from tracelode.llm import common as C
from tracelode.llm import quality

T = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs, sf_dir):
    out = [docs]
    for name, stage in P.STAGES:
        out.append(C.stored(stage(spark, out[-1], sf_dir), "test"))
    return [[r for r in df.collect()] for df in out]


def verify(spark, sf_dir, docs):
    d = stages(spark, docs, sf_dir)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    for rows in d[1:5]:
        assert all(r.__fields__ == list(P.COLUMNS) for r in rows)
    # quality: the same model, text by text
    model = quality.fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    assert key(d[1]) == key([r for r in d[0] if model.score([(r.text or "").encode()])[0] >= quality.THRESHOLD])
    # near-duplicates
    rows = [(r.doc_id, r.text) for r in d[1]]
    roots = test_similar.brute(rows)
    want = sorted({(k, t) for (k, t), (_, _, c) in zip(rows, roots) if k == c}, key=str)
    got = key(d[2])
    assert len(got) == len(set(got)) and set(got) <= set(want) and {k for k, _ in got} == {k for k, _ in want}
    # substrings
    rows = [(r.doc_id, r.text) for r in d[2]]
    left = {(k, n - m): h for k, n, m, h in test_repeats.brute(rows)}
    for r in d[3]:
        w = (r.text or "").encode().split()
        assert left[r.doc_id, len(w)] == hashlib.sha256(b" ".join(w)).hexdigest()
    assert len(d[3]) == len(d[2])
    # benchmark
    items = [(r.item_id, r.text) for r in C.table(spark, sf_dir, "benchmark").collect()]
    texts = {i: " ".join(t.split()) for i, t in items}
    bad = {r.doc_id for r in d[3] if any(x in " ".join((r.text or "").split()) for x in texts.values())}
    assert {r.doc_id for r in d[4]} == {r.doc_id for r in d[3]} - bad
    # packing
    test_packing.verify([(r.doc_id, r.text) for r in d[4]], d[5])
    return d


def test_driver_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    d = verify(spark, sf_dir, C.table(spark, sf_dir, "documents"))
    assert len(d[0]) > len(d[1]) > len(d[2]) >= len(d[4]) > 0


def test_cases(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = C.table(spark, sf_dir, "documents").limit(40)
    odd = spark.createDataFrame([(None, "a text that has no id at all, but some words", None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0)], T)
    d = stages(spark, docs.unionByName(docs.limit(5)).unionByName(odd), sf_dir)
    assert len({(r.doc_id, r.text) for r in d[2]}) == len(d[2]) and len(d[5])
    assert [len(x) for x in stages(spark, docs.limit(0), sf_dir)] == [0] * 6


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] > 0 and P.ORACLE_SQL is None
