"""Pieces of files give what whole texts give: long matches at every cut, records, codecs with their state, decompression, lines, pages."""

import base64
import bz2
import codecs
import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tracelode import cli
from tracelode.operators import codecs as G
from tracelode.operators import packed, pages
from tracelode.operators.scan import scan
from tracelode.sources import pieces as P
from tracelode.sources import readers

S40 = hashlib.sha1(b"x").hexdigest()


def key(found, *more):
    return sorted((*(r[c] for c in more), r.type, r.location, r.size, tuple(r.payload), r.certainty) for r in found.collect())


def cut(text, window, span=P.SPAN):
    view = P.View(lambda at, n: text[at : at + n].encode("latin-1"), len(text), window)
    c = P.Cutter(view, span)
    return [p for k in range(view.windows) if (p := c.piece(k))]


def whole_of(found):
    """The pieces stand one after the other, and give the whole text."""
    at = 0
    for base, text, last in found:
        assert base == at and text
        at += len(text)
    assert [p[2] for p in found] == [False] * (len(found) - 1) + [True] * bool(found)
    return "".join(p[1] for p in found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["123", "4567", "(123)", "\n", "\r\n", " ", "  ", "-", ".", "ab", "x", "=", ":", "\t", "1", "89 ", "\n4567\n", "pass"]), max_size=120), st.integers(33, 80), st.integers(1, 4))
def test_no_phone_number_is_cut(parts, window, span):
    text = "".join(parts)
    found = cut(text, window, span)
    assert whole_of(found) == text
    spans = [m.span() for m in P._PHONE.finditer(text)]
    for base, _, _ in found[1:]:
        if base % window and (text[base - 1] in "\r\n" or text[base] in "\r\n"):  # not where a span without any place begins
            assert not any(a < base < e for a, e in spans), (base, spans)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3000), st.integers(40, 300), st.integers(1, 5), st.randoms(use_true_random=False))
def test_each_window_finds_its_own_piece(n, window, span, rng):
    """A task that sees some windows only cuts where a task that sees all does."""
    text = "".join(rng.choice("ab1 \n\r(") if rng.random() < 0.3 else "z" for _ in range(n))
    found = cut(text, window, span)
    assert whole_of(found) == text
    alone = []
    for k in range(-(-n // window)):
        view = P.View(lambda at, m: text[at : at + m].encode("latin-1"), n, window)
        p = P.Cutter(view, span).piece(k)
        alone += [p] if p else []
    assert alone == found and all(len(p[1]) < (2 * span + 1) * window for p in found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n1", max_size=90), max_size=30), st.integers(40, 200), st.integers(1, 4))
def test_streamed(chunks, window, span):
    found = list(P.streamed(iter(chunks), window, span))
    assert "".join(p[1] for p in found) == "".join(chunks) and found[-1][2] and not any(p[2] for p in found[:-1])
    assert all(len(p[1]) <= span * window + 90 for p in found)


NAMES = ["jwt", "URL", "secret", "web-cookie", "sha1", "RipeMD320", "phone", "credit", "md5", "md5-joomla1", "uuid", "des-salt-unix"]


def long_things(n):
    """A token, an address, a cookie, a secret and a run of digits of about n characters each."""
    head = base64.urlsafe_b64encode(b'{"alg":"none"}  ').decode().rstrip("=")
    head = head[: len(head) // 4 * 4]
    body = (base64.b64encode(b'{"a": 1, "b": "' + b"q" * n).decode().rstrip("="))[: n // 4 * 4]
    return [f"{head}.{body}.sig", "http://host/" + "p/" * (n // 2), "id=" + "v" * n, "password is " + "w " * (n // 2), S40 * (n // 40)]


@pytest.mark.parametrize("n", [50, 986, 2986, 30_000])
def test_long_matches(spark, n, tmp_path):
    """What the judge of all windows is: the whole text. Lengths from far below to many times a window, at many places of it."""
    rows = []
    for k, at in enumerate(range(0, 2000, 67)):
        filler = ("some words here\n" * 200)[:at]
        rows.append((f"s{k}", filler + "\n" + "\n".join([*long_things(n), "555-1234", "(123)", "456-7890", S40]) + " end\n" + filler))
    df = spark.createDataFrame(rows, "source string, text string")
    want = key(scan(df, ids=["source"], detectors=NAMES, filters=("web", "crypto", "personal", "other", "unix")), "source")
    assert any(r[1] == "jwt" and r[3] > n for r in want) and any(r[1] == "URL" and r[3] > n - 10 for r in want)
    parts = P.of_content(df.select("source", F.col("text").cast("binary").alias("content")), P.View, window=1000, span=64)
    found = scan(parts, ids=["source"], base_offset="base_offset", last="last", detectors=NAMES, filters=("web", "crypto", "personal", "other", "unix"))
    assert key(found, "source") == want
    for name, text in rows[:6]:
        (tmp_path / f"{name} %.txt").write_text(text)
    read = scan(P.file_pieces(readers.sizes(spark, str(tmp_path)), 1000, 64), ids=["source"], base_offset="base_offset", last="last", detectors=NAMES, filters=("web", "crypto", "personal", "other", "unix"))
    assert [r[1:] for r in key(read.withColumn("source", F.regexp_extract("source", "(s[0-9]+)[^/]*$", 1)), "source")] == [r[1:] for r in want if r[0] in {x[0] for x in rows[:6]}]


def test_token_at_the_end_of_a_megabyte(spark, tmp_path):
    token = long_things(2900)[0]
    text = ("a line of words\n" * 62_400)[:997_401] + "\n" + token + "\n" + "more\n" * 100_000
    (tmp_path / "a.log").write_text(text)
    found = scan(readers.directory(spark, str(tmp_path)), ids=["source"], base_offset="base_offset", last="last", detectors=["jwt"]).collect()
    assert [(r.location, r.payload) for r in found] == [(997_402, [token])]


def test_whole_text_patterns_need_the_whole_file(spark, tmp_path):
    (tmp_path / "whole").write_bytes(base64.b64encode(bytes(3000)))
    (tmp_path / "part").write_bytes(base64.b64encode(bytes(990)) + b"\nx y\n" + b"z" * 2000)
    found = scan(readers.directory(spark, str(tmp_path), window=1000), ids=["source"], base_offset="base_offset", last="last", detectors=["base64"]).collect()
    assert [(r.source.rsplit("/", 1)[1], r.size) for r in found] == [("whole", 4000)]


def test_numbers_in_every_line_and_one_long_line(spark, tmp_path):
    """Lines that begin and end with digits are cut too; a line without end is cut at blanks, and other matches don't notice."""
    lines = "".join(f"{i},{i * 7},{i * 13}\n" for i in range(4000))
    assert len(cut(lines, 1000)) > 10
    text = " ".join(f"w{i} id=v{i} {S40}" for i in range(2000))
    found = cut(text, 1000, 4)
    assert len(found) > 10 and whole_of(found) == text
    df = spark.createDataFrame(found, "base_offset long, text string, last boolean")
    got = key(scan(df, base_offset="base_offset", last="last", detectors=["sha1", "web-cookie"]))
    assert got == key(scan(spark.createDataFrame([(text,)], "text string"), detectors=["sha1", "web-cookie"]))


# Secrets on odd lines


def test_secrets_on_very_long_lines(spark):
    emoji = "pass " + "a😀" * 1_000_000
    ascii_ = "key " + "b" * 10_000_000
    df = spark.createDataFrame([(0, emoji + "\nx=pass"), (1, ascii_)], "id int, text string")
    got = scan(df, ids=["id"], detectors=["secret"]).select("id", "location", "size").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2_000_005), (0, 2_000_006, 1), (0, 2_000_008, 4), (1, 0, 10_000_004)]


# Records


@pytest.mark.parametrize("fmt", ["<I", ">q", "<h", ">b", "B", "<Q", "@l", "=i", "<HH", ">xhI", "4s", "<d", "2s3x", "<3H"])
@pytest.mark.parametrize("all_fields", [False, True])
def test_records(spark, fmt, all_fields, tmp_path):
    rng = random.Random(fmt)
    data = bytes(rng.choice((rng.randrange(256), 0, 255)) for _ in range(4000)) + b"\x01"
    want = packed.written(data, fmt, all_fields)
    plain = "".join(v.decode("latin-1") if isinstance(v, bytes) else str(v) for r in struct.iter_unpack(fmt, data[: len(data) // struct.calcsize(fmt) * struct.calcsize(fmt)]) for v in (r if all_fields else r[:1]))
    assert want == plain
    cell = spark.createDataFrame([(data,), (b"",), (None,)], "content binary")
    assert [r.text for r in packed.preprocess(cell, fmt, all_fields=all_fields).collect()] == [want, "", None]
    (tmp_path / "a.bin").write_bytes(data)
    for window in (7, 100, 1_000_000):
        rows = packed.file_records(spark, str(tmp_path), fmt, all_fields=all_fields, window=window).orderBy("base_offset").collect()
        assert whole_of([(r.base_offset, r.text, r.last) for r in rows]) == want


def test_records_of_a_large_file(spark, tmp_path):
    """3 MB of records of three bytes' worth of prime window remainders: the same text as one pass, artefacts across ranges found once."""
    text = "".join(f"row {i} {hashlib.sha1(str(i).encode()).hexdigest()}\n" for i in range(60_000)).encode()
    data = b"".join(struct.pack("<7sH", text[i : i + 7], i % 65536) for i in range(0, len(text), 7))
    (tmp_path / "a.bin").write_bytes(data)
    assert len(data) > 3_000_000
    found = scan(packed.file_records(spark, str(tmp_path), "<7sH"), ids=["source"], base_offset="base_offset", last="last", detectors=["sha1"])
    assert found.select("payload").distinct().count() == found.count() == 60_000


# Codecs


def windows_of(name, data, window):
    view = G.view(name)(lambda at, n: data[at : at + n], len(data), window)
    texts = [view.text(k) for k in range(view.windows)]
    at = 0
    for k, t in enumerate(texts):
        if t:
            assert view.start(k) == at
        at += len(t or "")
    alone = [G.view(name)(lambda at, n: data[at : at + n], len(data), window).text(k) for k in range(view.windows)]
    assert alone == texts
    return texts


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(4, 60))
def test_windows_of_codecs_give_the_whole(data, window):
    digits = bytes(c for c in data if chr(c).isalnum() and c < 128 or c in b"+/")
    for p in range(4):
        part = digits[p:]
        assert "".join(windows_of(f"base64:{p}", data, window)) == base64.b64decode(part[: len(part) // 4 * 4]).decode("latin-1")
    digits = bytes(c for c in data if c in b"0123456789ABCDEFabcdef")
    for p in range(2):
        part = digits[p:]
        assert "".join(windows_of(f"hex:{p}", data, window)) == bytes.fromhex(part[: len(part) // 2 * 2].decode()).decode("latin-1")
    for name, width in G._WIDE.items():
        for p in range(width):
            part = data[p:]
            got = "".join(windows_of(f"{name}:{p}", data, window))
            if width == 4:
                assert got == part[: len(part) // 4 * 4].decode(name, errors="replace")
            else:
                want = part[: len(part) // 2 * 2].decode(name, errors="replace")
                assert got.rstrip("�") == want.rstrip("�") or got.replace("�", "") == want.replace("�", "")


@pytest.mark.parametrize("name", ["gb18030", "shift_jis", "big5", "euc_kr", "iso2022_jp", "utf_7", "UTF-8", "cp037", "hz", "utf_16_le", "utf_32_be"])
def test_charsets(name):
    word = {"cp037": "text", "euc_kr": "한글", "hz": "汉字"}.get(name, "漢字")
    text = "".join(f"{word} {i} ab\n" for i in range(200))
    data = text.encode(name)
    for window in (40, 64, 1000):
        assert "".join(windows_of(f"{name}:0", data, window)) == text


def wrapped_file(phase, lines):
    """Artefacts wrapped in several codecs, each after a number of characters that shifts its phase."""
    secret = lambda i: hashlib.sha1(f"{i}".encode()).hexdigest()
    out = []
    for i in range(60):
        inner = f" {secret(i)} ".encode()
        b = base64.b64encode(inner).decode()
        b = "\n".join(b[k : k + 19] for k in range(0, len(b), 19)) if lines else b
        out.append(("-- " + "x" * ((i + phase) % 4) + b + " ." * 7 + "\n").encode())
        out.append(b"h: " + b"a" * ((i + phase) % 2) + inner.hex().encode() + b" zz\n")
        out.append(b"\0" * (i % 5) + f" {secret(i)} ".encode("utf-16-le") + b"\n")
    return b"".join(out), {(c, secret(i)) for c in ("base64", "hex", "utf_16_le") for i in range(60)}


@pytest.mark.parametrize("phase, lines, window", [(0, False, 100), (1, True, 131), (2, True, 256), (3, False, 1000)])
def test_wrapped_artefacts_are_found_once(spark, tmp_path, phase, lines, window):
    data, want = wrapped_file(phase, lines)
    (tmp_path / "a.bin").write_bytes(data)
    found = G.scan_files(spark, str(tmp_path), codecs_=["base64", "hex", "utf_16_le"], window=window, detectors=["sha1"]).collect()
    # digits that stand in the file as they are also are hex digits and base64 digits, so other matches may be there too
    got = [(r.codec, r.payload[0]) for r in found if (r.codec, r.payload[0]) in want]
    assert len(got) == len(set(got)) and set(got) == want


def test_codecs_without_state(spark, tmp_path):
    text = "".join(f"see {hashlib.sha1(str(i).encode()).hexdigest()} {i}\n" for i in range(50))
    (tmp_path / "r").write_text(codecs.encode(text, "rot13"))
    (tmp_path / "e").write_bytes(text.encode("cp037"))
    found = G.scan_files(spark, str(tmp_path), codecs_=["rot13", "cp037"], window=300, detectors=["sha1"]).collect()
    assert sum(r.codec == "rot13" and r.source.endswith("/r") for r in found) == 50 == sum(r.codec == "cp037" and r.source.endswith("/e") for r in found)


# Decompression


@pytest.mark.parametrize("name, pack", [("zlib_codec", zlib.compress), ("bz2_codec", bz2.compress)])
def test_decompressed(name, pack):
    data = random.Random(1).randbytes(300_000) + bytes(3_000_000)
    raw = pack(data)
    for tail in (b"", b"x", b"BZ", b"BZhxx"):
        for step in (999, 1 << 30):
            chunks = ((raw + tail)[i : i + step] for i in range(0, len(raw + tail), step))
            parts = list(G.decompressed(chunks, name))
            assert b"".join(parts) == data and max(map(len, parts)) <= G.STEP
    for bad in (raw[:-5], b"", b"abc", raw[:100]):
        with pytest.raises(ValueError):
            list(G.decompressed([bad], name))
    assert b"".join(G.decompressed([bz2.compress(b"a") + bz2.compress(b"b")], "bz2_codec")) == b"ab"


def test_bomb(spark, tmp_path):
    """200 MB in one cell and one file of some hundred kilobytes: everything is scanned, in pieces."""
    body = b"".join(b"." * 999_000 + b"\n%s\n" % hashlib.sha1(b"%d" % i).hexdigest().encode() for i in range(200))
    raw = zlib.compress(body)
    assert len(raw) < 300_000
    cell = spark.createDataFrame([(raw.decode("latin-1"),)], "text string")
    made = G.generated(cell, mode="decode").filter("codec = 'zlib_codec'")
    assert made.agg(F.max(F.length("text"))).first()[0] < 3_000_000
    found = scan(made, base_offset="base_offset", last="last", detectors=["sha1"])
    assert found.count() == found.select("location").distinct().count() == 200
    (tmp_path / "a.z").write_bytes(raw)
    (tmp_path / "b.z").write_bytes(raw[:-9])
    assert G.scan_files(spark, str(tmp_path), codecs_=["zlib_codec"], detectors=["sha1"]).groupBy("source").count().collect()[0]["count"] == 200


# Lines and pages


def test_lines_byte_for_byte(spark, tmp_path):
    data = b"a 555-1234\r\nb\r\n\xff\xfe\xe9\n\n" + b"x" * 500 + b"\nc 555-1234"
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    for window in (1, 7, 64, 1000):
        rows = readers.lines(spark, str(tmp_path), window=window).orderBy("base_offset").collect()
        assert [(r.base_offset, r.text.encode("latin-1")) for r in rows] == [(0, b"a 555-1234\r\n"), (12, b"b\r\n"), (15, b"\xff\xfe\xe9\n"), (19, b"\n"), (20, b"x" * 500 + b"\n"), (521, b"c 555-1234")]
        assert [(r.location, r.payload) for r in scan(readers.lines(spark, str(tmp_path), window=window), base_offset="base_offset", detectors=["phone"]).collect()] == [(2, ["555-1234"])]


def test_memory_image(spark, tmp_path):
    """A sparse image of 64 MB by many tasks: digests across the edges of pages and of tasks' ranges, each on the page where it begins."""
    path, at = tmp_path / "mem.raw", [0x1000 - 8, 0x5000 * 200 - 20, 999_424 - 8, 40_000_000, (64 << 20) - 45]
    with open(path, "wb") as f:
        f.truncate(64 << 20)
        for a in at:
            f.seek(a)
            f.write(b" " + hashlib.md5(b"%d" % a).hexdigest().upper().encode() + b" ")
    image = readers.image_pages(spark, str(path))
    assert image.count() == (64 << 20) // 0x1000
    found = pages.verdicts(image, ids=["vpage"], filters="win").filter("array_contains(likely, 'md5')").collect()
    assert sorted(r.vpage for r in found) == sorted({a // 0x1000 * 0x1000 for a in at} | {(a + 2) // 0x1000 * 0x1000 for a in at if (a + 1) % 0x1000 == 0})


# Command line


def test_command_line_on_files(spark, capsys, tmp_path):
    def run(*argv):
        assert cli.main(list(argv), spark) == 0
        return capsys.readouterr().out

    text = "".join(f"row {i} {hashlib.sha1(str(i).encode()).hexdigest()}\n" for i in range(30_000))
    data = b"".join(struct.pack("<5sI", text[i : i + 5].encode(), i) for i in range(0, len(text), 5))
    (tmp_path / "p.bin").write_bytes(data)
    assert len(data) > 2_500_000
    assert run("-f", str(tmp_path / "p.bin"), "-p", "<5sI", "-t", "other").count("SHA-1 digest") == 30_000
    assert "after decode hex: LM hash" in run("-f", str(_hexed(tmp_path)), "-t", "win", "-g", "decode")


def _hexed(tmp_path):
    path = tmp_path / "h.txt"
    path.write_text("note " + "563DE3D2F07D0747BBE4BA2697AE33AA".encode().hex() + " z")
    return path


def test_pieces_go_to_spark_together():
    """In lists of bounded length and size, not one by one."""
    rows = [(0, "a" * n) for n in (1, 5, P.TOGETHER_SIZE, 3, 4)] + [(1, "b")] * 3 * P.TOGETHER
    lists = list(P._together(iter(rows), lambda row: len(row[1])))
    assert [r for x in lists for r in x] == rows and [len(x) for x in lists] == [3, *[P.TOGETHER] * 3, 2]
