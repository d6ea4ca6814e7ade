import random

from tracelode.llm import common as C
from tracelode.llm import decontamination as X

D, B = "doc_id long, text string, item_id string, h string", "item_id long, text string, doc_id string"
Q = "Anna walks 12 km in 3 hours and then she rests for 12 minutes before Bert joins her on the road to Paris"


def run(spark, docs, items):
    return X.contaminated(spark.createDataFrame([(k, t, "", "") for k, t in docs], D), spark.createDataFrame([(k, t, "") for k, t in items], B)).collect()


def test_reparameterised_and_consistent(spark):
    docs = [
        (1, f"some words before {Q} some after"),
        (2, Q.replace("12", "57").replace("3", "8").replace("Anna", "Claudia").replace("Paris", "Oslo")),
        (3, Q.replace("12 km", "14 km").replace("12 minutes", "99 minutes")),  # 12 stands for two values
        (4, "Anna walks to school and then she rests"),
        (5, " ".join(["the road to Paris"] * 40)),
        (6, Q.upper()),
    ]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in run(spark, docs, [(9, Q)])}
    assert got == {(1, 9): False, (2, 9): True, (6, 9): False}


def test_cases(spark):
    items = [(1, None), (2, ""), (3, "One two"), (4, "12 13 14 15 16 17 18 19 20"), (5, "five small words are enough"), (6, Q), (6, Q), (None, "an item without any id of its own is found as well")]
    docs = [(1, None), (2, ""), (None, f"x {Q}"), (3, "here five small words are enough indeed"), (3, "here five small words are enough indeed"), (4, "w " * 60000 + Q), (5, "12 13 14 15 16 17 18 19 20"), (6, "an item without any id of its own is found as well"), (7, "a line\n one  TWO. \nmore"), (8, "not one two alone")]
    got = sorted(((r.doc_id, r.item_id) for r in run(spark, docs, items)), key=str)
    assert got == sorted([(None, 6), (3, 5), (4, 6), (5, 4), (6, None), (7, 3)], key=str)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def brute(docs, items):
    """Every item against every place of every document, word by word."""
    import numpy as np

    out, codes = set(), X.Codes(X.code)

    def prepared(text):
        w = (text or "").encode().split()
        return [X.core(x) for x in w], X.template(w, codes, np.array([0])).tolist()

    def as_is(values, size):
        return [tuple(x.lower() for x in values[p : p + size]) for p in range(len(values) - size + 1)] if size else []

    texts = {text: prepared(text)[0] for _, text in items}
    for item, text in items:
        iv, it = prepared(text)
        size = min(len(it), X.WINDOW)
        having = lambda w: sum(w in as_is(v, min(len(v), X.WINDOW)) for v in texts.values())
        weight = [max(1, X.WEIGHT // having(w)) for w in as_is(iv, size)]
        for doc, body in docs:
            dv, dt = prepared(body)
            if 0 < size < X.LEAST:
                if any([X.core(x).lower() for x in line.encode().split()] == [x.lower() for x in iv] for line in (body or "").split("\n")):
                    out.add((doc, item, 1))
                continue
            wins = range(len(it) - size + 1) if size else ()
            found, as_template = set(), set()
            templates = [p for p in wins if sum(x >= 16 for x in it[p : p + size]) >= X.LITERAL * size]
            for diagonal in range(-len(it), len(dt)):
                here = [p for p in wins if 0 <= p + diagonal <= len(dt) - size]
                hit = [p for p in here if dt[p + diagonal : p + diagonal + size] == it[p : p + size] and p in templates]
                same = [p for p in here if [x.lower() for x in dv[p + diagonal : p + diagonal + size]] == [x.lower() for x in iv[p : p + size]]]
                slots = {(iv[q], dv[q + diagonal]) for p in hit for q in range(p, p + size) if it[q] < 16}
                if len(slots) == len({a for a, _ in slots}):
                    found.update(hit + same)
                    as_template.update(hit)
            share = lambda some, of: sum(weight[p] for p in some) >= X.COVERAGE * sum(weight[p] for p in of)
            if len(wins) and (share(found, wins) or templates and share(templates, wins) and share(as_template, templates)):
                out.add((doc, item, len(found)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "9", "Oslo", "of", "and", "walks", "5", "12", "km", "Anna", "Bert", "road", "in", "hours", "to", "a", "it", "was"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20)))) for i in range(25)]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                x = [rng.choice(["7", "5"]) if y in ("5", "12") else rng.choice(["Carl", "Anna"]) if y in ("Anna", "Bert") else y for y in x]
            w[rng.randint(0, len(w)) :] = x[: rng.randint(1, len(x))]
        docs.append((i, "".join(x + rng.choice("    \n") for x in w)))
    assert {(r.doc_id, r.item_id, r.matched) for r in run(spark, docs, items)} == brute(docs, items)


def test_a_shared_prompt_is_no_evidence(spark):
    """Items that share an instruction of 20 words and are otherwise words with digits, documents that have the instruction: none is
    found, unless a document has an item's own part; pairs are looked for by the rare windows only."""
    prompt = "read the following lines with care and then write down below which one of them does not belong to others"
    own = lambda k: " ".join(f"x{k}y{j}" for j in range(20))
    items = [(k, f"{prompt} {own(k)}") for k in range(300)]
    docs = [(k, f"some text before {prompt} and words after it that say something else of day {k}") for k in range(300)] + [(1000 + k, f"{prompt} {own(10 * k)}") for k in range(5)]
    assert sorted((r.doc_id, r.item_id) for r in run(spark, docs, items)) == [(1000 + k, 10 * k) for k in range(5)]
    found = X._found(spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "xxhash64(text) item_row", "text"), ["item_id", "item_row"], [X.WINDOW])
    rare = X.weighed(found).filter("rare").collect()
    assert {r.item_id for r in rare} == set(range(300)) and min(r.place for r in rare) >= 17
    # every item the same but for its name and numbers: each way of asking is found for all of them
    asked = lambda name, n: f"how many apples does {name} have left after giving {n} of them to a friend who had none before"
    family = [(k, asked(f"N{'abcdefghij'[k]}", 10 + k)) for k in range(10)]
    assert {r.item_id for r in run(spark, [(1, asked("Zoe", 77))], family)} == set(range(10))


def test_planted_passages_are_found(spark):
    d = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(r.text.split()) for r in C.table(spark, d, "benchmark").collect()}
    docs = {r.doc_id: " ".join(r.text.split()) for r in C.table(spark, d, "documents").collect()}
    planted = {(k, i) for i, x in items.items() for k, t in docs.items() if x in t}
    assert planted and {(r.doc_id, r.item_id) for r in X.query(spark, d).collect()} == planted


def test_each_word_is_worked_out_once(monkeypatch):
    """Both codes of a word come from one look at it, and are right when more words were seen than are remembered."""
    import numpy as np

    seen, core = [], X.core
    monkeypatch.setattr(X, "MEMO", 50)
    words = [w.encode() for w in "Anna walks 12km 12 km, the THE Étage ² x2 (a) ... 3.5kg of ٣ ½".split()] + [f"w{i}".encode() for i in range(60)]
    numbers = X.Numbers()
    assert [len(x) for x in numbers.of([])] == [0, 0]
    for some in (words * 3, words[::-1], [b"new", *words]):
        monkeypatch.setattr(X, "core", lambda w: seen.append(w) or core(w))
        t, same = numbers.of(some)
        monkeypatch.setattr(X, "core", core)
        assert t.tolist() == [X.code(w) for w in some] and same.tolist() == [X.plain(w) for w in some] and t.dtype == np.uint64
        assert len(seen) == len(set(some))
        seen.clear()
