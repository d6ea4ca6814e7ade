import random
import zlib

import numpy as np
from tracelode.llm import common as C
from tracelode.llm import language as G

D = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in G.query(spark, d).collect()}
    true = {r.doc_id: r.lang for r in C.table(spark, d, "documents").select("doc_id", "lang").collect()}
    assert set(got) == set(true)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    mine = [(got[k].lang_pred == lang, got[k].rejected) for k, lang in true.items() if got[k].held_out]
    assert np.mean([ok for ok, _ in mine]) > 0.985
    kept = [ok for ok, no in mine if not no]
    assert np.mean(kept) > 0.995 and len(kept) > 0.9 * len(mine)


def test_cases(spark):
    rows = [(None, "no id text", "en"), (1, None, "en"), (2, "", "de"), (3, "12 %&", "en"), (4, "the words of this " * 20000, "en"), (5, "same of", "de"), (5, "same of", "de"), (6, "é", None), (7, "漢字", "zh"), (8, "x", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], D)
    for known in (docs, docs.filter("lang = 'en'"), docs.limit(0)):
        out = G.identified(docs, G.examples(known)).collect()
        assert len(out) == len(rows)
        by = {r.doc_id: r for r in out}
        assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3))
        assert len({(r.lang_pred, r.score) for r in out if r.doc_id == 5}) == 1
        if known is docs:
            assert all(by[k].lang_pred != "und" for k in (4, 6, 7, 8))
    assert G.identified(docs.limit(0), {}).count() == 0


def test_dictionaries_never_see_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "") for i in range(200)], D)
    seen = b"\n".join(G.examples(docs)["en"]).split(b"\n")
    assert {int(t.split()[-1]) for t in seen} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_the_smallest_size_decides_whatever_the_length(spark):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    z = G.Compressors(G.examples(docs))
    for r in docs.filter("text <> ''").collect():
        for t in (r.text.encode(), r.text[:40].encode()):
            lang, _, rejected = z.best(t)
            if lang == "und":
                continue
            t = G.letters_only(t)
            pieces = [t[i : i + G.PIECE] for i in range(0, len(t), G.PIECE)]
            size = [sum(len(c.compress(p)) for c in s for p in pieces) / G.DICTIONARIES for s in z.sets]
            assert lang == z.langs[int(np.argmin(size))] and rejected == (np.diff(sorted(size)[:2])[0] / len(t) < G.MARGIN)


def test_results_by_brute_force(spark):
    """The query from the table's rows alone: which texts are learnt, their dictionaries, sizes, scores."""
    import zstandard

    d = "/root/testdata/sf0.001"
    rows = C.table(spark, d, "documents").selectExpr("doc_id", "coalesce(text, '') as text", "lang", "xxhash64(doc_id) as h").collect()
    known: dict = {}
    for r in sorted((r for r in rows if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2), key=lambda r: (r.h, r.doc_id)):
        known.setdefault(r.lang, []).append(r.text)
    plain = zstandard.ZstdCompressor(level=G.LEVEL, write_content_size=False)
    sets = {}
    for lang, texts in known.items():
        texts = [G.letters_only(t.encode()) for t in texts[: G.PER_LANGUAGE]]
        content = [b"\n".join(texts[k :: G.DICTIONARIES]) for k in range(G.DICTIONARIES)]
        sets[lang] = [zstandard.ZstdCompressor(level=G.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for c in content]
    got = {r.doc_id: r for r in G.query(spark, d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not G.LETTER.search(r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        t = G.letters_only(r.text.encode())
        pieces = [t[i : i + G.PIECE] for i in range(0, len(t), G.PIECE)]
        size = {lang: sum(len(z.compress(p)) for z in zs for p in pieces) / len(zs) for lang, zs in sets.items()}
        bare = sum(len(plain.compress(p)) for p in pieces)
        best = min(sorted(size), key=size.get)
        saved = {lang: max(0, bare - n) for lang, n in size.items()}
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (saved[best] / sum(saved.values()) if sum(saved.values()) else 1 / len(size))) < 1e-9


def test_all_of_a_large_dictionary_counts():
    """Of 4 MB of examples, a text of any part of them is coded shorter than one that is in none."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [" ".join(word() for _ in range(2600)).encode() for _ in range(160)]
    assert sum(map(len, texts)) > 4_000_000
    z = G.Compressors({"xx": texts})
    assert len(z.sets[0]) >= 8
    other = " ".join(word() for _ in range(40)).encode()
    bare = z.sizes(other)[1][0]
    for t in (0, 1, 79, 80, 158, 159):
        for at in (0, len(texts[t]) // 2, len(texts[t]) - 400):
            assert z.sizes(texts[t][at : at + 400])[1][0] < bare - 20, (t, at)


def test_parts_are_even_and_whole():
    for n in (0, 1, G.LARGEST, G.LARGEST + 1, 3 * G.LARGEST + 5):
        parts = G.even(bytes(n))
        assert b"".join(parts) == bytes(n) and max(map(len, parts)) <= G.LARGEST
