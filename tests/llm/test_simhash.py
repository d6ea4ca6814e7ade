import random

import numpy as np
import pytest
import xxhash
from tracelode.llm import common as C
from tracelode.llm import simhash as S
from tracelode.llm.components import components

T = "doc_id long, text string, fp string, root string"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    fp = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{fp[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"W{rng.randint(0, 99)}é" for _ in range(rng.choice([3, 40, 200]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "x"
        rows.append((i * 7 % 150, rng.choice([" ", "\n"]).join(w)))
    return rows


CASES = [[], [(3, None), (1, ""), (2, " \t")], [(None, "a b"), (None, "A B"), (4, "a b c d")], [(2, "A b c"), (2, "a B C"), (1, "zz " * 20000)], corpus(1), corpus(2)]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows, monkeypatch):
    got = S.near_duplicates(spark.createDataFrame([(k, t, "", "") for k, t in rows], T)).collect()
    got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [8, 1024])
def test_links_of_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(5)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(15):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    got = components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = dict(map(tuple, got))
    want = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 3 and want[signed[i]] != want[signed[j]]:
                    want[signed[i]] = want[signed[j]] = min(want[signed[i]], want[signed[j]])
                    changed = True
    assert {x: root.get(x, x) for x in signed} == want


def test_driver_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in C.table(spark, d, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.query(spark, d).collect())) == sorted(brute(rows))
