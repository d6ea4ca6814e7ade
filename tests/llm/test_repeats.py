import hashlib
import random

import numpy as np
import pytest
from tracelode.llm import common as C
from tracelode.llm import repeats as R

T = "doc_id long, text string, n_words string, kept string"


def brute(rows, size=50):
    first = {}
    words = [(k if k is not None else 2**63 - 1, (t or "").encode().split()) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, k), k)
    out = []
    for (k0, _), (k, w) in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone.update(range(i, i + size))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((k0, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([49, 50, 51, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                w += rng.choice(passages)
        rows.append((i * 7 % n, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    return rows


SAME = " ".join(["x"] * 400)
CASES = [[], [(1, None), (2, ""), (3, "  ")], [(1, SAME), (1, SAME), (2, SAME), (None, SAME), (3, SAME + " y")], [(5, " ".join(map(str, range(80)))), (5, " ".join(map(str, range(10, 90))))], corpus(1), corpus(2), [(i, " ".join(map(str, range(30000)))) for i in range(3)]]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], T)
    from pyspark.sql import functions as F

    got = R.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_full_sketch_loses_nothing(spark):
    """Whatever is estimated as repeated, the second pass is exact."""
    rows = corpus(3)
    got = R.repeated(spark.createDataFrame([(k, t, "", "") for k, t in rows], T), twice=lambda batch, i, j, anchor: anchor == anchor).collect()
    gone = {k: set() for k, _ in rows}
    for r in got:
        gone[r.doc_id].update(range(len(dict(rows)[r.doc_id].split())) if r.copy else [p + k for p in r.places for k in range(50)])
    assert sorted((k, len(v)) for k, v in gone.items()) == sorted((x[0], x[2]) for x in brute(rows))


@pytest.mark.parametrize("rows", CASES)
def test_sketch_in_shards_gives_the_same(spark, rows, monkeypatch):
    """The way beyond what is broadcast, with some shards."""
    monkeypatch.setattr(R, "SENT", 0)
    monkeypatch.setattr(R, "CELLS_PER_BYTE", 300)
    got = R.remove_repeats(spark.createDataFrame([(k, t, "", "") for k, t in rows], T)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted((x[:3] for x in brute(rows)), key=str)


def test_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    same = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{a} {same}"), (2, f"{b} {same}"), (3, f"{same} {a}"), (4, f"{a[:64]} {same}"), (5, f"{b[:64]} {same}"), (6, f"{b[:64]} {same}")]
    got = R.remove_repeats(spark.createDataFrame([(k, t, "", "") for k, t in rows], T)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 50)]


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 130))) for _ in range(20000)}
    words |= {b"a" * n for n in range(1, 200)} | {b"a" * n + b"\1" for n in range(1, 200)}
    text = b" ".join(words)
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = C.words(data, np.array([0, len(data)]))
    for seed in (1, 2):
        assert len(np.unique(C.word_hashes(data, starts, ends, seed))) == len(words)
    other = np.frombuffer(b"x " + text, np.uint8)
    assert (C.word_hashes(other, *C.words(other, np.array([0, len(other)]))[:2])[1:] == C.word_hashes(data, starts, ends)).all()


def test_driver_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in C.table(spark, d, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, R.query(spark, d).collect())) == sorted(brute(rows))


def test_sql_gives_the_same(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(R.SQL)
    got = R.query(spark, d).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
