import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelode.llm import common as C
from tracelode.llm import toxicity as X

D, L = "doc_id long, text string, score0 string, lang string", "doc_id long, quality int, toxic int, text string"
BAD, FINE = ["blockhead", "rotter", "stinker"], [a + b for a in ("the", "and", "on", "her", "tion", "re") for b in ("en", "er", "ing", "st", "at", "nd", "ou", "es")]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    text = lambda bad: " ".join([*rng.choice(FINE, 60), *(rng.choice(BAD, 2) if bad else [])]).encode()
    m = X.train([(i % 2, text(i % 2)) for i in range(300)], 0.5)
    m.start()
    return m


@pytest.mark.parametrize("written, word", [("bl0ckh3ad", "blockhead"), ("r0tt3r", "rotter"), ("st1nk3r", "stinker"), ("$tinker", "stinker"), ("b.l.o.c.k.h.e.a.d", "blockhead"), ("blllooockhead", "blockhead"), ("r o t t e r", "rotter"), ("s-t-i-n-k-e-r", "stinker"), ("R0TT3R!!", "rotter")])
def test_restored(model, written, word):
    text = "there onher " + written + " anding"
    assert any(X.features(w)[1] == X.features(word)[1] for w in model.restorer.words(text)), model.restorer.words(text)
    assert model.score(text) > 0.5 > model.score("there onher anding")


def test_plain_words_stay(model):
    assert model.restorer.words("The café, y a (b) 12 3.4 ***") >= {"the", "café", "y", "a", "b"}


def test_decoding_is_exact(model):
    """Viterbi against all paths."""
    from itertools import product

    def paths(written):
        for choice in product(*X.lattice(written)):
            out, cost, before, ok = "", 0.0, X.START, True
            for c, extra in choice:
                cost += extra
                if c == X.AGAIN:
                    ok &= before[1] == choice_letter[0]
                elif c == " ":
                    ok &= before != X.START
                    cost += model.letters.cost(before, X.STOP) if ok else 0
                    out, before = out + " ", X.START
                elif c:
                    cost += model.letters.cost(before, c)
                    out, before = out + c, before[1] + c
                choice_letter.append(choice_letter.pop(0))
                if not ok:
                    break
            choice_letter[:] = list(written)
            if ok:
                yield cost + (model.letters.cost(before, X.STOP) if before != X.START else 0), out

    for written in ("r0tt3r", "aab1", "s t o", "oo0.t"):
        choice_letter = list(written)
        best = min(paths(written))
        got = X.restore(written, model.letters)
        assert any(abs(c - best[0]) < 1e-9 and o == got for c, o in paths(written))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in X.query(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in C.table(spark, d, "labels").collect()}
    assert len(got) == C.table(spark, d, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for k, r in got.items())
    mine = np.array([(got[k].predicted, y) for k, y in labels.items() if k in got and got[k].held_out])
    assert (mine[:, 0] == mine[:, 1]).mean() > 0.97 and mine[mine[:, 1] == 1, 0].mean() > 0.8


def test_cases(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "x"), (4, "word 1x " * 40000), (5, "same"), (5, "same"), (6, "a1" * 4000), (7, " ".join("abcde" * 2000))]
    docs = spark.createDataFrame([(k, t, "clash", None) for k, t in rows], D)
    labels = spark.createDataFrame([(k, None, k % 2, "clash") for k in range(1, 8)] + [(None, 1, 0, ""), (8, 1, None, ""), (3, 1, 0, "")], L)
    for known in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        out = X.scored(docs.select("doc_id", "text"), X.fit(docs, known)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1 and len({r.score for r in out if r.doc_id == 5}) == 1
    assert X.scored(docs.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("written, word", [("a$$", "ass"), ("@$$", "ass"), ("w0rthle$$", "worthless"), ("$$tupid", "stupid")])
def test_symbols_at_an_edge_may_be_letters(written, word):
    letters = X.Letters(["ass", "worthless", "stupid", "less", "grass"] * 50)
    assert any(X.features(w)[1] == X.features(word)[1] for w in X.Restorer(letters).word(written))


def test_decoration_goes_in_linear_time(model):
    assert X.undecorated("***word--") == "word" and X.undecorated("-word") == "-word" and X.undecorated("aaab") == "aaab"
    model.score("x" + "-" * 400000 + "x " + "-" * 400000 + " " + "$" * 100000)


def test_scores_by_brute_force():
    """Counts, odds and the largest values by loops over all texts; the weights make the loss least; the score from both."""
    import math

    rng = np.random.default_rng(2)
    text = lambda bad: " ".join([*rng.choice(FINE, 12), *(rng.choice(BAD, 2) if bad and rng.random() < 0.9 else [])])
    rows = [(i % 2, text(i % 2)) for i in range(60)]
    m = X.train([(y, t.encode()) for y, t in rows], 0.5)
    m.start()
    told = [(y, {f for w in m.restorer.words(t) for f in X.features(w)}, m.restorer.words(t)) for y, t in rows]
    n = [sum(y == k for y, *_ in told) for k in (0, 1)]

    def odds(f, without=None):
        c = [sum(f in fs for i, (y, fs, _) in enumerate(told) if y == k and i != without) for k in (0, 1)]
        return math.log((c[1] / n[1] + X.SHRINK / min(n)) / (c[0] / n[0] + X.SHRINK / min(n))), sum(f in fs for y, fs, _ in told if y == 1)

    every = {f for _, fs, _ in told for f in fs}
    kept = {f: v for f in every for v, toxic in [odds(f)] if toxic > 1 and v > 0.2}
    assert kept.keys() == m.odds.keys() and all(abs(kept[f] - m.odds[f]) < 1e-12 for f in kept)
    x = []
    for i, (y, _, words) in enumerate(told):
        best = sorted((max([0.0] + [odds(f, i)[0] for f in X.features(w) if f in kept or not y and odds(f)[1] > 1]) for w in words), reverse=True)
        x.append((best + [0.0] * X.TOP)[: X.TOP] + [1.0])
    slope = [0.0] * (X.TOP + 1)
    for (y, *_), row in zip(told, x):
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, m.weights))))
        slope = [s + (p - y) * 0.5 / n[y] * len(told) * a for s, a in zip(slope, row)]
    assert all(abs(s + (0.5 if k < X.TOP else 1e-6) * m.weights[k]) < 1e-6 for k, s in enumerate(slope))
    for t in ("there " + BAD[0] + " onher", "anding", ""):
        top = sorted((v for w in m.restorer.words(t) for v in [max(kept.get(f, 0.0) for f in X.features(w))] if v > 0), reverse=True)[: X.TOP]
        z = sum(a * b for a, b in zip(m.weights, top)) + m.weights[-1]
        assert abs(m.score(t) - 1 / (1 + math.exp(-z))) < 1e-12


def test_every_labelled_document_teaches(spark):
    """A word of two toxic texts among 4,000 labelled ones, more than any sample took, and the model of the table against that of its rows."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*rng.choice(FINE, 8), *(rng.choice(BAD, 1) if i % 2 else [])])) for i in range(8000)]
    teach = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 and k % 2]
    for k in rng.choice(teach, 2, replace=False).tolist():
        rows[k] = k, "there quixotry anding r0tt3r"
    held = [(k, "zanyword " * 3) for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0 and k % 2]
    rows = list((dict(rows) | dict(held)).items())
    docs = spark.createDataFrame([(k, t, "", None) for k, t in rows], D).repartition(7)
    labels = spark.createDataFrame([(k, None, k % 2, "") for k, _ in rows], L)
    got = X.fit(docs, labels)
    want = X.train([(k % 2, t.encode()) for k, t in rows if zlib.crc32(str(k).encode()) % 5], 0.5)
    assert "quixotry" in got.odds and "zanyword" not in got.odds
    assert got.odds.keys() == want.odds.keys() and all(abs(got.odds[f] - want.odds[f]) < 1e-12 for f in want.odds)
    assert got.letters.tri == want.letters.tri and got.letters.bi == want.letters.bi and got.letters.after1 == want.letters.after1
    assert np.abs(got.weights - want.weights).max() < 1e-6


def test_largest_against_all_words(model):
    """The values of all distinct words, sorted; in any order of texts, and with bounds that are forgotten in between."""
    rng = np.random.default_rng(5)
    letters = list("abeott")
    words = sorted({"".join(rng.choice(letters, rng.integers(1, 11))) for _ in range(3000)} | {"=ab", "abeo*", "aab$$", "b0tt0$$$", "a.b.e"})
    every = sorted({f for w in words for f in X.features(w)})
    odds = {f: float(v) for f, v in zip(every, rng.normal(0, 1, len(every)).round(1)) if v > 0.2}
    for restorer in (None, X.Restorer(X.Letters(words))):
        largest = X.Largest(odds, restorer)
        for k in range(300):
            some = {w + end for w in rng.choice(words, rng.integers(0, 40)).tolist() for end in ("", ".", "$$$")[: rng.integers(1, 4)]}
            said = {w for t in some for w in (restorer.word(t) if restorer else (t,))} | set(words[k : k + 2])
            want = sorted((v for w in said if (v := max([0.0] + [odds.get(f, 0.0) for f in X.features(w)])) > 0), reverse=True)[: X.TOP]
            assert largest(some, words[k : k + 2]) == want
            if k % 100 == 99:
                largest.bound.clear()
                largest.known.clear()


def test_few_words_are_worked_out(model, monkeypatch):
    """Of words of which no feature can be among the largest, nothing is looked up; an end that many words share is decoded once."""
    calls = {"best": 0, "column": 0}
    best = X.best
    monkeypatch.setattr(X, "best", lambda *a: calls.update(best=calls["best"] + 1) or best(*a))
    for name in ("lattice", "choose"):
        if hasattr(X, name):
            monkeypatch.setattr(X, name, lambda *a, of=getattr(X, name): calls.update(column=calls["column"] + 1) or of(*a))
    m = X.Model(model.letters, {"blockhead": 4.0, "rotter": 3.0, "stinker": 3.0, "rotten": 3.0, "ther*": 0.3}, model.weights)
    m.start()
    words = [a + b + c for a in ("th", "on", "an", "re") for b in FINE for c in FINE if not any(x == y for x, y in zip(a + b + c, (a + b + c)[1:]))]
    m.score(" ".join(words))
    assert calls["best"] < len(words) / 10 and not calls["column"]
    ends = [w + "$$$" for w in words if w[-2:] == "en"]
    assert len(ends) > 50
    m.score(" ".join(ends))
    assert calls["column"] == 1
    m.start()
    before = dict(calls)
    m.score(" ".join(ends))
    assert calls == before


def test_remembered_ends_change_nothing(model):
    rng = np.random.default_rng(6)
    for _ in range(2000):
        written = "".join(rng.choice(list("abbott0$*-. "), rng.integers(1, 12)).tolist())
        got = X.restore(written, model.letters)
        model.letters.tails.clear()
        assert X.restore(written, model.letters) == got


def test_spaced_words_are_all_found():
    rng = np.random.default_rng(7)
    for _ in range(20000):
        low = "".join(rng.choice(list("ab  .-_\n\t1"), rng.integers(0, 14)).tolist())
        assert not _ONE_PATTERN.search(low) or X._SPACED.search(low)


def test_listed_features(monkeypatch):
    """Counts of the listed features against loops over the features of each text's words, also where rows are forgotten in between."""
    rng = np.random.default_rng(8)
    odd = ["letter", "leter", "lletterr", "=abcdef", "abcdef*", "=abcd*", "abcdefgh", ""]
    words = sorted({a + b + c for a in FINE[:9] for b in FINE for c in ("", "s")} | set(FINE) | set(odd))
    listed = sorted({f for w in [*words[::3], *odd] for f in X.features(w)})
    texts = [" ".join(dict.fromkeys([*rng.choice(words, 20).tolist(), *rng.choice(odd, k % 3).tolist()])) for k in range(200)] + ["", " ".join(words * 20)]
    for most in (1_000_000, 50):
        monkeypatch.setattr(X, "REMEMBERED", most)
        counts = X.Listed(listed)
        for some in (texts[:80], texts[80:]):
            counts.start()
            for t in some:
                counts.add(t)
            told = [X.seen_in(t.split(" ")) for t in some]
            assert dict(zip(listed, counts.n[1:].tolist())) == {f: sum(f in fs for fs in told) for f in listed}


_ONE_PATTERN = re.compile(r"(?<!\S)[^\s.\-_](?:[ .\-_]{1,2}[^\s.\-_]){2,}(?!\S)")


@settings(max_examples=1500, deadline=None)
@given(st.text("xy .-_\n", max_size=40))
def test_spaced_words(text):
    assert list(X.chains(text)) == [m[0] for m in _ONE_PATTERN.finditer(text)]


@pytest.mark.parametrize("text", ["x- " * 350_000 + "xx", "x " * 500_000 + "xx", "x- " * 350_000, "x. y " * 200_000])
def test_spaced_words_take_linear_time(text):
    start = time.perf_counter()
    list(X.chains(text))
    assert time.perf_counter() - start < 5
