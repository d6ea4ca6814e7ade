import math
from collections import Counter

import numpy as np
import pytest
from tracelode.llm import common as C
from tracelode.llm import lm_scoring as M

D = "doc_id long, text string, n_tokens string, log_prob string"


def hashes(words):
    one = [np.frombuffer(x, np.uint8) for x in words]
    return np.array([C.word_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in one], np.uint64)


def plain(text, vocabulary, net, counts):
    """Word by word, with Python loops."""
    w = (text or "").encode().split()
    if not w:
        return 0, 0.0
    k = vocabulary.look_up(hashes(w))
    rows, (first, second) = vocabulary.inputs(hashes(w), k), vocabulary.targets(k)
    total = 0.0
    for i in range(len(w)):
        x = np.zeros(M.HIDDEN)
        for t, d in enumerate([-2, -1, 1, 2]):
            x = x + net.tables[t][rows[i + d] if 0 <= i + d < len(w) else M.ROWS - 1]
        x = np.tanh(x)
        z = x @ net.out + net.bias
        total += z[first[i]] - math.log(np.exp(z).sum())
        if second[i] >= 0:
            z = x @ net.inner[first[i] - M.OWN] + net.inner_bias[first[i] - M.OWN]
            total += z[second[i]] - math.log(np.exp(z).sum())
        if k[i] < 0:
            total += math.log(max(1, counts[w[i]]) / vocabulary.rare)
    return len(w), total


@pytest.fixture
def small(monkeypatch):
    """A small vocabulary, so that most words aren't listed."""
    monkeypatch.setattr(M, "WORDS", M.OWN + 8)


ROWS = [(None, "no id at all"), (1, None), (2, ""), (3, "  \n"), (4, "x"), (5, "the same words"), (5, "the same words"), (6, "é 漢字 the words of the text " * 50), (7, "w " * 300 + " ".join(f"rare{i} rare{i % 7}" for i in range(40))), (8, " ".join(f"v{i} " * (i % 5 + 3) for i in range(60)))]


def test_against_plain_loops(spark, small):
    docs = spark.createDataFrame([(k, t, "", "") for k, t in ROWS], D)
    counts, words, net = M.fit(docs)
    tally = Counter(w for _, t in ROWS for w in (t or "").encode().split())
    assert {r.h: r.n for r in counts.collect()} == {int(hashes([w]).view(np.int64)[0]): n for w, n in tally.items()}
    got = sorted(((r.doc_id, r.n_tokens, round(r.log_prob, 2), r.mean_log_prob is None) for r in M.scored(docs, counts, words, net).collect()), key=str)
    want = [(k, n, round(s, 2), n == 0) for k, t in ROWS for n, s in [plain(t, words, net, tally)]]
    assert got == sorted(want, key=str)
    empty = docs.limit(0)
    assert M.scored(empty, *M.fit(empty)).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "some words again " * 100_000, "", "")], D)
    assert M.scored(docs, *M.fit(docs)).first().n_tokens == 300_000


def test_probabilities_sum_to_one(spark, small):
    docs = spark.createDataFrame([(1, " ".join(f"v{i} " * (i + 3) for i in range(60)) + " ".join(f"w{i}" for i in range(300)), "", "")], D)
    counts, words, net = M.fit(docs)
    tally = Counter(docs.first().text.encode().split())
    k = words.look_up(hashes(tally))
    first, second = words.targets(k)
    around = np.repeat(np.array([[3], [1], [0], [2]], np.int16), len(k), axis=1)
    p = np.exp(net.log_probability(around, first, second)) * np.where(k < 0, np.array(list(tally.values())) / words.rare, 1)
    # what is missing are places of the first softmax that have no word here
    x = np.tanh(sum(net.tables[t][around[t][:1]] for t in range(4)))
    z = np.exp(x @ net.out + net.bias)[0]
    assert M.OWN < (k >= 0).sum() <= M.WORDS and abs(p.sum() - z[sorted(set(first.tolist()))].sum() / z.sum()) < 1e-4


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_BYTES", 1 << 17)
    docs = C.table(spark, "/root/testdata/sf0.001", "documents")
    each = [{r.doc_id: r.log_prob for r in M.scored(d, *M.fit(d)).collect()} for d in (docs.coalesce(1), docs.repartition(16))]
    assert each[0].keys() == each[1].keys() and all(abs(v - each[1][k]) <= 1e-6 * abs(v) for k, v in each[0].items())


def test_steps_follow_the_gradient(small):
    """One step of a copy against numeric slopes of its loss, by the signs and sizes that Adagrad gives."""
    rng = np.random.default_rng(0)
    vocabulary = M.Vocabulary([(i, i % 3, 90 - i) for i in range(M.OWN + 8)], 5)
    around = rng.integers(0, 9, (4, 64)).astype(np.int16)
    first, second = vocabulary.targets(rng.integers(-1, M.OWN + 8, 64))
    net = M.Network(vocabulary.sizes)
    loss = lambda: -net.log_probability(around, first, second).sum() / 8
    sums = [np.zeros_like(p) for p in net.parameters()]
    before = [p.copy() for p in net.parameters()]
    net.train(around, first, second, sums)
    after = [p.copy() for p in net.parameters()]
    for p, b in zip(net.parameters(), before):
        p[...] = b
    for p, s, a in zip(net.parameters(), sums, after):
        for i in np.argsort(-s.ravel())[:3]:
            at = np.unravel_index(i, p.shape)
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            slope = (up - down) / 2e-2
            assert abs(s[at] ** 0.5 - abs(slope)) < 0.05 * abs(slope) + 0.01
            assert abs((old - a[at]) - M.RATE * slope / np.sqrt(s[at] + 1e-2)) < 0.05


def test_network_beats_counts_and_orders_texts(spark):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    counts, words, net = M.fit(docs)
    a = {r.doc_id: r for r in M.scored(docs, counts, words, net).collect()}
    b = {r.doc_id: r for r in M.scored(docs, counts, words, M.Network(words.sizes)).collect()}
    mean = lambda x: sum(r.log_prob for r in x.values()) / sum(r.n_tokens for r in x.values())
    assert mean(a) > mean(b) + 0.5
    text = " ".join(docs.filter("lang = 'en'").first().text.split()[:150])
    shuffled = " ".join(np.random.default_rng(0).permutation([text[i : i + 3].strip() or "x" for i in range(0, len(text), 3)]))
    x = {r.doc_id: r.mean_log_prob for r in M.scored(spark.createDataFrame([(1, text, "", ""), (2, shuffled, "", "")], D), counts, words, net).collect()}
    assert x[1] > x[2]


def test_words_of_two_documents_score_apart(spark):
    """A whole corpus's counts tell words that come twice from words that come once."""
    docs = C.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    made = lambda k: " ".join(f"q{k}z{i}" for i in range(80))
    more = spark.createDataFrame([(10**6 + i, made(i // 2)) for i in range(40)] + [(2 * 10**6 + i, made(1000 + i)) for i in range(40)], "doc_id long, text string")
    both = docs.unionByName(more)
    got = M.scored(both, *M.fit(both)).filter("doc_id >= 1000000").collect()
    twice, once = ([r.rare_log_prob for r in got if (r.doc_id < 2 * 10**6) == k] for k in (True, False))
    assert min(twice) > max(once)
    assert min(r.mean_log_prob for r in got if r.doc_id < 2 * 10**6) > np.median([r.mean_log_prob for r in got if r.doc_id >= 2 * 10**6])
