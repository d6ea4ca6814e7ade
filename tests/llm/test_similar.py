import random

import numpy as np
import pytest
import test_simhash
from pyspark.sql import functions as F
from tracelode.llm import similar as S
from tracelode.llm import simhash

T = "doc_id long, text string"


def sets(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.decode()) for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def brute(rows):
    """Like test_simhash.brute, with links of similarity too."""
    fp = [test_simhash.plain(t) for _, t in rows]
    shingled = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = shingled[i], shingled[j]
            if (fp[i] ^ fp[j]).bit_count() <= 3 or len(x & y) >= 0.8 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{fp[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"W{rng.randint(0, 99)}é" for _ in range(rng.choice([3, 40, 100, 300]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i * 7 % 160, rng.choice([" ", "\n"]).join(w)))
    return rows


CASES = [[], [(3, None), (1, ""), (2, " \t")], [(None, "a b"), (None, "A B"), (4, "a b c d")], [(2, "A b c d e f"), (2, "a B c d e f"), (1, "zz " * 20000)], corpus(1), corpus(2)]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, T), similar_too=True).collect()
    assert sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)


def test_recall_on_the_driver_table(spark):
    """All pairs of similarity 0.8 or more are in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    root = {r.doc_id: r.root for r in simhash.near_duplicates(docs, similar_too=True).collect()}
    rows = [(r.doc_id, sets(r.text)) for r in docs.collect()]
    by = {}
    for i, (_, x) in enumerate(rows):
        for h in x:
            by.setdefault(h, []).append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    close = [(rows[a][0], rows[b][0]) for a, b in pairs if len(rows[a][1] & rows[b][1]) >= 0.8 * len(rows[a][1] | rows[b][1])]
    assert len(close) > 50 and all(root[a] == root[b] for a, b in close)


@pytest.mark.parametrize("block", [16, 1024])
def test_dense_groups_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        x = list(w)
        x[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(x)))
    docs = spark.createDataFrame(rows, T).select(F.xxhash64("text").alias("row"), "text")
    found = S.links(docs).collect()
    texts = len({t for _, t in rows})
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in found:
        root[find(r.u)] = find(r.v)
    assert len(root) == texts and len({find(k) for k in list(root)}) == 1


def test_dense_group_of_many_false_candidates(spark):
    """Template texts with one of two words at each of 170 places: most pairs lie between 0.7 and 0.8, few reach 0.8."""
    rng = np.random.default_rng(5)
    words, n = 3000, 200
    places = np.arange(170) * 17 + 10
    filled = rng.integers(0, 2, (n // 2, len(places))).repeat(2, axis=0)
    for i in range(1, n, 2):
        filled[i, rng.choice(len(places), 65, replace=False)] ^= 1
    apart = (filled[:, None, :] != filled[None, :, :]).sum(2)
    close = (words - 4 - 5 * apart) / (words - 4 + 5 * apart)  # each place is in five shingles of its own
    few = close[np.triu_indices(n, 1)]
    assert (few >= 0.8).mean() < 0.02 and ((few > 0.7) & (few < 0.8)).mean() > 0.95
    texts = []
    for row in filled:
        x = [f"w{k}" for k in range(words)]
        for p, y in zip(places.tolist(), row.tolist()):
            x[p] = f"{'ab'[y]}{p}"
        texts.append(" ".join(x))
    assert abs(jaccard(texts[0], texts[1]) - close[0, 1]) < 1e-9
    docs = spark.createDataFrame(list(enumerate(texts)), T).select("doc_id", F.xxhash64("text").alias("row"), "text")
    number = {r.row: r.doc_id for r in docs.select("row", "doc_id").collect()}

    def groups(pairs):
        root = np.arange(n)
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return root[:, None] == root[None, :]

    found = [(number[r.u], number[r.v]) for r in S.links(docs.drop("doc_id")).collect()]
    assert all(close[a, b] >= 0.8 for a, b in found)
    assert (groups(found) == groups(zip(*np.nonzero(close >= 0.8)))).all()


def test_shingles_of_short_texts():
    data = np.frombuffer("a b|a b|A B c|  |a b c d e f".replace("|", "\0").encode(), np.uint8)
    cuts = np.flatnonzero(data == 0)
    offs = np.array([0, *(cuts + 1), len(data) + 1]) - np.arange(len(cuts) + 2)
    offs[-1] = len(data) - len(cuts)
    h, begin = S.shingles(data[data != 0], offs)
    assert np.diff(begin).tolist() == [1, 1, 1, 1, 2] and h[0] == h[1] != h[2]


def test_garbage_is_collected_between_rounds(spark):
    """Else the driver's heap grows to its bound over the rounds of components."""
    from tracelode.llm.components import components

    whole = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    before = whole()
    got = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long"))
    assert whole() - before >= 3 and {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(1, 61)}


def test_counts_and_forests_of_sets(monkeypatch):
    monkeypatch.setattr(S, "COLUMNS", 7)
    rng = np.random.default_rng(11)
    sets_of = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    shared = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in sets_of] for x in sets_of])
    got, size = S.shared_counts(sets_of), np.array([len(x) for x in sets_of])
    apart = ~np.eye(len(sets_of), dtype=bool)
    assert (got[apart] == shared[apart]).all()
    close = np.triu(shared >= 0.4 * (size[:, None] + size[None, :] - shared), 1)

    def groups(pairs):
        root = np.arange(len(sets_of))
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return root[:, None] == root[None, :]

    p, q = np.nonzero(np.triu(np.ones_like(shared), 1))
    for some in (slice(None), slice(0, 25)):  # many are counted at once, few one by one
        found = S.links_of(sets_of, p[some], q[some], 0.4)
        want = [(a, b) for a, b in zip(p[some], q[some]) if close[a, b]]
        assert set(found) <= set(want) and (groups(found) == groups(want)).all()


@pytest.mark.parametrize("set_bytes", [1 << 14, 16 << 20])
def test_a_dense_group_makes_rows_by_its_texts(spark, monkeypatch, set_bytes):
    """Not by its pairs, though most of them are candidates and no links; and in a fixed number of tables."""
    monkeypatch.setattr(S, "SET_BYTES", set_bytes)
    rng, n = random.Random(9), 400
    words = [[f"{x}{k}" for x in "ab"] for k in range(400)]
    texts = []
    for _ in range(n):  # each differs from the plain text at 7 places of its own: two share some 0.7 of their shingles
        x = [a for a, _ in words]
        for p in rng.sample(range(400), 7):
            x[p] = words[p][1]
        texts.append(" ".join(x))
    texts += [t + " end" for t in texts[:50]]
    near = np.array([[jaccard(a, b) for b in texts[:60]] for a in texts[:60]])[np.triu_indices(60, 1)]
    assert ((near > 0.65) & (near < 0.8)).mean() > 0.7
    docs = spark.createDataFrame(list(enumerate(texts)), T).select("doc_id", F.xxhash64("text").alias("row"), "text")
    number = {r.row: r.doc_id for r in docs.select("row", "doc_id").collect()}
    tables, stored = [], S.C.stored
    monkeypatch.setattr(S.C, "stored", lambda df, name: tables.append((name, (out := stored(df, name)).count())) or out)
    found = {tuple(sorted((number[r.u], number[r.v]))) for r in S.links(docs.drop("doc_id")).collect()}
    monkeypatch.undo()
    # at most a pair a text in each of 16 lists, handed on and verified; all pairs would be 224 a text
    assert len(tables) <= 7 and sum(k for _, k in tables) < (2 * 16 + 4) * len(texts), tables
    assert {(i, n + i) for i in range(50)} <= found and all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in found)


def test_components_without_rounds(spark, monkeypatch):
    """Links that tasks join up by themselves need no round, of which each costs the driver two plans of many exchanges."""
    from tracelode.llm import components as K

    def none(edges):
        raise AssertionError("a round")

    monkeypatch.setattr(K, "_round", none)
    got = K.components(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 7), (1000, 999), (999, 1000)], "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(1, 301)] + [(1000, 999)]


def test_components_over_several_tasks(spark, monkeypatch):
    from tracelode.llm import components as K

    rounds, plain = [], K._round
    monkeypatch.setattr(K, "_round", lambda edges: rounds.append(1) or plain(edges))
    rng = random.Random(4)
    pairs = [(rng.randrange(-300, 300) * 10**15, rng.randrange(-300, 300) * 10**15) for _ in range(330)]
    root = {k: k for p in pairs for k in p}
    for a, b in pairs:
        a, b = sorted((root[a], root[b]))
        root = {k: a if r == b else r for k, r in root.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = K.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rounds and sorted(map(tuple, got)) == sorted((k, r) for k, r in root.items() if k != r)
