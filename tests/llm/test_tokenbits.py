"""Token ids in files: round trips of bits and files, random access, and the whole query against the library."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tracelode.llm import tokenbits as B

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "ids binary, doc_id long, start string, text string, file string"


@pytest.fixture(scope="module")
def library():
    return lambda text: [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def plain(rows, library):
    """rows: doc_id, text, each id once -> doc_id, start, n_tokens, crc."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library(text), "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in df.collect()), key=lambda r: r[1])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.randoms(use_true_random=False))
def test_bits(width, n, rng):
    ids = np.array([rng.randrange(1 << width) for _ in range(n)], np.uint32)
    data = B.packed(ids, width)
    assert len(data) == -(-n // 64) * width * 8 and np.array_equal(B.unpacked(data, width)[:n], ids)
    bits = "".join(f"{int(x):0{width}b}"[::-1] for x in ids)
    assert "".join(f"{b:08b}"[::-1] for b in data)[: len(bits)] == bits


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"aZé́ẛΣσς'İﬁ漢😀_-09.,!<|>\x00\x1c\x85  　 \t\n\r\x0b\x0c", "n't", "'S ", "<|endoftext|>", "<|startoftext|>", "é", " ́", "가", "가"])))
def test_words_are_encoded_as_texts(parts):
    text = "".join(parts)
    assert B.encoder()([text.encode()])[0].tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def test_every_letter_before_a_mark():
    """Whatever Unicode version a library has, letters that are taken apart from marks give the same ids."""
    for c in map(chr, range(0x530)):
        for text in (f"{c}.", f"a{c},", f"A{c}B!", c):
            assert B.encoder()([text.encode()])[0].tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2], text


def test_texts_together_and_long_ones():
    """Texts in one batch don't touch each other; long ones are taken in parts."""
    texts = ["Ab cd, " * 30, "", "x" * 80 + " y", " Ünï ünï! ", "ab\ncd" * 400_000, "q" * 1_200_000 + " end", "last"]
    got = B.encoder()([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_width():
    assert B.width_of() == 16 and B.width_of("byte_bpe_50k") == 16


def test_other_vocabularies_are_encoded_whole():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " a  b\n", "Ünï <|endoftext|>"):
        assert B.encoder("byte_bpe_50k")([text.encode()])[0].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("width", [1, 13, 16, 17, 31, 32])
def test_file_and_random_access(tmp_path, width):
    import pyarrow as pa

    rng = random.Random(width)
    docs = [np.array([rng.randrange(1 << width) for _ in range(n)], "<u4") for n in (1, 63, 64, 65, 1, 1000, 0, 128, 7)]
    w = B.Writer(f"{tmp_path}/a b.ids", width, 128)
    w.add(pa.array([5, None, 5], pa.int64()), docs[:3])
    w.add(pa.array([6, 7, 8, 9, 10, 11], pa.int64()), docs[3:])
    w.close()
    r = B.Reader(f"{tmp_path}/a b.ids")
    everything = np.concatenate(docs)
    assert (r.n_ids, r.n_documents, r.width) == (len(everything), 9, width)
    for _ in range(200):
        a, b = sorted(rng.randrange(len(everything) + 1) for _ in range(2))
        assert np.array_equal(r.ids(a, b), everything[a:b])
    for a in range(9):
        for b in range(a + 1, 10):
            records, cuts = r.documents(a, b)
            assert [len(docs[k]) for k in range(a, b)] == np.diff(cuts).tolist()
            assert records["known"].tolist() == [int(k != 1) for k in range(a, b)]


CASES = {
    "empty": [],
    "nulls": [(None, None), (3, None), (-1, ""), (2, " \n")],
    "long": [(9, "Lorem Ipsum dolor " * 100_000), (1, "x" * 50_000), (2, "Ünï 漢字 😀 <|endoftext|> <|startoftext|>")],
    "some": [(i * 7 % 101, f"Text {i} don't STOP, it's {i}") for i in range(101)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, library, name):
    rows = CASES[name]
    B.write(spark.createDataFrame([(b"x", d, "7", t, "f") for d, t in rows], SCHEMA), f"file://{tmp_path}/out", block=128)
    assert rows_of(B.read(spark, f"file://{tmp_path}/out")) == plain(rows, library)


def test_repeated_rows(spark, tmp_path, library):
    """Rows of one doc_id, a third of the table, are each written, in the order of a hash of their texts; equal rows stand together."""
    rows = [(4, f"one {i % 5}") for i in range(400)] + [(i, "two") for i in range(800) if i != 4]
    B.write(spark.createDataFrame([(b"x", d, "7", t, "f") for d, t in rows], SCHEMA), str(tmp_path / "out"), block=64)
    got = rows_of(B.read(spark, str(tmp_path / "out")))
    assert [r[0] for r in got] == sorted(d for d, _ in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array(library(t), "<u4").tobytes())
    same = [r[3] for r in got if r[0] == 4]
    assert sorted(same) == sorted(crc(t) for d, t in rows if d == 4) and sum(a != b for a, b in zip(same, same[1:])) == 4


def test_what_failed_attempts_leave_is_not_read(spark, tmp_path, library):
    rows = CASES["some"]
    B.write(spark.createDataFrame([(b"x", d, "7", t, "f") for d, t in rows], SCHEMA), str(tmp_path / "out"))
    (tmp_path / "out" / "part-000000-left.ids").write_bytes(b"half a file")
    assert rows_of(B.read(spark, str(tmp_path / "out"))) == plain(rows, library)
    listed = json.loads((tmp_path / "out" / B.MANIFEST).read_text())
    assert listed["width"] == 16 and sum(f["documents"] for f in listed["files"]) == len(rows)


def test_whole_table(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = B.query(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain(rows, library)
