import base64
import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
import xxhash
from tracelode.llm import common as C
from tracelode.llm import fingerprints as P

T = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), signed(r[1] or ""), r[1] or ""))
    out = []
    for i, (k, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(text) // 2
        out.append((k, len(text), hashlib.sha256((text[: len(text) - h] + nxt[:h]).encode()).hexdigest()))
    return out


CASES = [
    [],
    [(5, "alone é text")],
    [(1, "a b c d e"), (2, None), (3, ""), (4, "x\ny\n\nz é ü 漢字"), (5, "a b c d e"), (None, "null id text"), (6, "w " * 30000)],
    [(7, "same id"), (7, "same id b"), (7, None), (9, "q r s t u v\nq r s")],
    [(i * 3 % 50, f"row {i} " * (i % 7)) for i in range(50)],
]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], T)
    key = lambda r: (str(r[0]), r[1], r[2])
    for ranges in (1, 3, 17):
        got = P.fingerprints(docs, ranges).collect()
        assert sorted([tuple(r[:3]) for r in got], key=key) == sorted(brute(rows), key=key)
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def plain_vector(text):
    """Lane by lane, shingle by shingle, with whole numbers."""
    exact, sketch = [0] * P.EXACT, [0] * P.SKETCH
    for line in text.split("\n"):
        digest = hashlib.shake_128(line.encode()).digest(P.EXACT * 8)
        exact = [(a + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % 2**64 for i, a in enumerate(exact)]
        words, seen = line.split(), Counter()
        for i in range(max(1, len(words) - P.SHINGLE + 1)) if words else ():
            part = words[i : i + P.SHINGLE]
            h = [C.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0:1] for w in part]
            x = C.runs(np.concatenate(h), P.SHINGLE) if len(part) == P.SHINGLE else (h[0] if len(part) == 1 else C.join_hashes(h[0], h[1])) ^ np.uint64(len(part))
            seen[tuple(part)] += 1
            if seen[tuple(part)] > 1:
                x = C.join_hashes(x, np.array([seen[tuple(part)] - 1], np.uint64))
            x = int(x[0])
            sketch[x % P.SKETCH] += 1 if x >> 40 & 1 else -1
    return exact, sketch


def test_fingerprints_by_brute_force(spark):
    rows = [r for case in CASES for r in case if len(r[1] or "") < 1000]
    got = P.fingerprints(spark.createDataFrame([(k, t, "", "", 0) for k, t in rows], T)).collect()
    want = {}
    for _, t in rows:
        exact, sketch = plain_vector(t or "")
        want[base64.b64encode(np.array(exact, np.uint64).tobytes() + np.array(sketch, np.int32).tobytes()).decode()] = exact, sketch
    assert {r.fingerprint for r in got} == set(want)
    for a, b in itertools.product(list(want)[:12], repeat=2):
        x, y = (np.array(want[f][1], float) for f in (a, b))
        near = 1.0 if a == b else max(0.0, x @ y / (x @ x + y @ y - x @ y)) if x @ y > 0 else 0.0
        assert abs(P.likeness(P.unpack(a), P.unpack(b)) - near) < 1e-12


def exact_likeness(a, b):
    """The Tanimoto coefficient of the counts of shingles, line by line."""
    count = lambda t: Counter(tuple(w[i : i + 3]) for w in map(str.split, t.split("\n")) for i in range(max(1, len(w) - 2)))
    x, y = count(a), count(b)
    both = sum(n * y[k] for k, n in x.items())
    return both / (sum(n * n for n in x.values()) + sum(n * n for n in y.values()) - both)


def test_likeness_of_repeated_lines():
    line = "one two three four five six\n"
    for a, b in ((65536, 65537), (40000, 20000), (70000, 1), (3, 2)):
        x, y = line * a, line * b
        got = P.likeness(P.vector(x.encode()), P.vector(y.encode()))
        assert abs(got - exact_likeness(x, y)) < 0.02
    assert P.likeness(P.vector((line * 65536).encode()), P.vector((line * 65537).encode())) > 0.99
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{i}" for i in rng.integers(0, 900, 12)) for _ in range(60)]
    for keep in (55, 40, 20, 5):
        x = "\n".join(lines + lines[:20] * 3)
        y = "\n".join(lines[:keep] + lines[:20] * 3)
        assert abs(P.likeness(P.vector(x.encode()), P.vector(y.encode())) - exact_likeness(x, y)) < 0.12


def test_order_insertion_deletion():
    a, b, ab = (P.pack(P.vector(x)) for x in (b"one two three four\nfive", b"six seven eight", b"six seven eight\nfive\none two three four"))
    assert P.combine(a, b) == ab and P.combine(ab, b, -1) == a
    assert P.pack(P.vector(b"x\ny")) == P.pack(P.vector(b"y\nx")) != P.pack(P.vector(b"x\ny\n"))


def test_likeness():
    rng = np.random.default_rng(0)
    w = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    base, half, other = " ".join(w[:1000]), " ".join(w[:500] + w[1000:1500]), " ".join(w[2000:])
    v = [P.vector(x.encode()) for x in (base, half, other)]
    assert P.likeness(v[0], v[0]) == 1 and abs(P.likeness(v[0], v[1]) - 1 / 3) < 0.12 and P.likeness(v[0], v[2]) < 0.12
