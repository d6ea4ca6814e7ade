"""Validators, reports, sources, the preprocessor, the generator, page verdicts and the stream."""

import base64
import codecs
import hashlib
import struct

import pytest
from pyspark.sql import functions as F
from tracelode.operators import codecs as G
from tracelode.operators import packed, pages, report
from tracelode.operators.scan import scan
from tracelode.operators.validators import validate
from tracelode.sources import readers
from tracelode.streaming import lines as stream

A32 = "563DE3D2F07D0747BBE4BA2697AE33AA"
B32 = "7db9d24c238b77af11b99f0a67e99abe"
S40 = hashlib.sha1(b"x").hexdigest()


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(0, f"{A32}"), (1, f"{B32}"), (2, "0000000000000000 x=a-b"), (3, S40)]
    return scan(spark.createDataFrame(rows, "id int, text string"), ids=["id"]).cache()


@pytest.mark.parametrize("validator, test", [
    ("all:NUMERIC", lambda s: all(c.isdigit() for c in s)), ("has:numeric", lambda s: any(c.isdigit() for c in s)), ("ALL:upper", lambda s: all(c.isupper() for c in s)),
    ("has:LOWER", lambda s: any(c.islower() for c in s)), ("all:ALPHA", lambda s: all(c.isalpha() for c in s)), ("all:alphanumeric", lambda s: all(c.isalnum() for c in s)),
    ("has:SYMBOL", lambda s: any(not c.isalnum() for c in s)), ("search:^7db", lambda s: s.startswith("7db")),
])
def test_validators(findings, validator, test):
    clean = lambda r: "".join(r.payload).replace("\n", "").replace("\r", "").replace("-", "")
    want = sorted(str(r) for r in findings.collect() if test(clean(r)))
    assert sorted(str(r) for r in validate(findings, [validator]).collect()) == want


def test_validator_combinations(findings):
    one, two = validate(findings, ["has:LOWER"]).count(), validate(findings, ["has:NUMERIC"]).count()
    both = validate(findings, ["has:LOWER", "has:NUMERIC"], combine="and").count()
    assert validate(findings, ["has:LOWER", "has:NUMERIC"]).count() == one + two - both
    assert validate(findings, ["has:LOWER", "has:NUMERIC"], strict=True).count() == one + two
    assert validate(findings, []) is findings
    for bad in ("some:UPPER", "all:NOTHING", "UPPER"):
        with pytest.raises(ValueError):
            validate(findings, [bad])


def test_reports(findings, spark):
    assert report.rollup(findings).agg(F.sum("n_findings")).first()[0] == findings.count()
    report.as_view(findings, "found")
    assert spark.sql("select count(distinct type) from found").first()[0] == len({r.type for r in findings.collect()})
    lines = [r.line for r in report.displayed(findings, details=True).collect()]
    assert all("[" in x and "%s" not in x for x in lines)
    assert report.catalogue(spark).count() == 38


def window_reads(n, window, overlap):
    """Where a reader that goes back by the overlap after each window that doesn't end the file begins its reads."""
    out, at = [], 0
    size = n if overlap > n else window
    while at != n:
        out.append(at)
        at = min(n, at + size)
        if at != n:
            at = max(0, at - overlap)
    return out


@pytest.mark.parametrize("window, overlap", [(1_000_000, 5_000), (100, 10)])
def test_window_starts(spark, window, overlap):
    sizes = [0, 1, overlap - 1, overlap, overlap + 1, window - 1, window, window + 1, 2 * window - overlap, 2 * window - overlap + 1, 5 * window + 7]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", readers.window_starts(F.col("n"), window, overlap).alias("s")).collect()
    for r in got:
        assert r.s == window_reads(r.n, window, overlap), r.n


def test_files_windows_and_duplicates(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    big = bytearray(b". " * 1250)
    for at in (10, 985, 2440):
        big[at : at + 42] = f" {S40} ".encode()
    (tmp_path / "big.bin").write_bytes(bytes(big))
    (tmp_path / "sub" / "b.txt").write_bytes(b"\xff\xfe " + S40.encode())
    (tmp_path / "sub" / "c.log").write_bytes(b"")
    flat = readers.file_windows(spark, str(tmp_path), recursive=False, window=1000, overlap=100)
    found = scan(flat, ids=["source"], base_offset="base_offset", detectors=["sha1"])
    assert sorted(r.location for r in report.without_overlaps(found).collect()) == [11, 986, 2441]
    owned = scan(flat, ids=["source"], base_offset="base_offset", keep=("keep_from", "keep_to"), detectors=["sha1"])
    assert sorted(r.location for r in owned.collect()) == [11, 986, 2441]
    deep = scan(readers.directory(spark, str(tmp_path), "*.txt"), ids=["source"], base_offset="base_offset", detectors=["sha1"]).collect()
    assert [(r.location, r.source.endswith("b.txt")) for r in deep] == [(3, True)]
    strict = scan(flat, ids=["source"], base_offset="base_offset", detectors=["sha1"], strict=True)
    assert {r.location for r in strict.collect()} != {11, 986, 2441}


def test_windows_give_what_the_whole_text_gives(spark, tmp_path):
    """Every cut position of digests, cookies, phone and card numbers; in files with odd names too."""
    line = f"  {S40}{S40} id={'x1' * 9};  (123) 456-7890 4111111111111111 {S40} "
    rows = [(f"s{k}", "." * k + " " + line * 3) for k in range(0, 330, 3)]
    names = ["sha1", "RipeMD320", "web-cookie", "phone", "credit", "md5"]
    whole = scan(spark.createDataFrame(rows, "source string, text string"), ids=["source"], detectors=names)
    content = spark.createDataFrame([(k, t.encode()) for k, t in rows], "source string, content binary")
    (tmp_path / "a b%20c.txt").write_bytes(rows[40][1].encode())
    key = lambda f: sorted((r.source, r.type, r.location, r.size, tuple(r.payload)) for r in f.collect())
    want = key(whole)
    assert want == key(scan(readers.windows(content, 500, 200), ids=["source"], base_offset="base_offset", keep=("keep_from", "keep_to"), detectors=names))
    read = key(scan(readers.file_windows(spark, str(tmp_path), window=500, overlap=200), ids=["source"], base_offset="base_offset", keep=("keep_from", "keep_to"), detectors=names))
    assert [r[1:] for r in read] == [r[1:] for r in want if r[0] == rows[40][0]]


def test_anchored_only_at_the_start(spark):
    df = spark.createDataFrame([("s", 0, f"{A32}:{A32}"), ("s", 995000, f"{A32}:{A32}")], "source string, base_offset long, text string")
    found = scan(df, ids=["base_offset"], base_offset="base_offset", detectors=["SAM(lm:ntlm)"])
    assert [r.base_offset for r in found.collect()] == [0]


def test_strings_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("000-000-0000\nnothing\n")
    assert scan(readers.strings(spark, ["000-000-0000"]), detectors=["phone"]).count() == 0
    assert [r.payload for r in scan(readers.lines(spark, str(tmp_path)), detectors=["phone"]).collect()] == [["000-0000"]]


def test_preprocessor(spark):
    data = [(0, struct.pack("<3I", 1, 70000, 5) + b"xy"), (1, b""), (2, None)]
    df = spark.createDataFrame(data, "id int, content binary")
    assert [r.text for r in packed.preprocess(df, "<I").orderBy("id").collect()] == ["1700005", "", None]
    assert packed.preprocess(df, "<HH").orderBy("id").first().text == "1" + str(70000 & 0xFFFF) + "5"
    assert packed.preprocess(df, "<HH", all_fields=True).orderBy("id").first().text == "10" + str(70000 & 0xFFFF) + "1" + "50"
    assert packed.preprocess(spark.createDataFrame([(b"abcdefgh",)], "content binary"), "4s").first().text == "abcdefgh"
    for bad in ("", "0s", "Q?!"):
        with pytest.raises((ValueError, struct.error)):
            packed.preprocess(df, bad)


def test_generator(spark):
    text = f"see {S40}"
    rows = [(0, base64.b64encode(text.encode()).decode()), (1, text.encode().hex()), (2, codecs.encode(text, "rot13")), (3, text.encode("utf-16-le").decode("latin-1")), (4, None), (5, "x"), (6, "漢")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = {(r.id, r.codec, r.direction) for r in G.scan_generated(df, ids=["id"], mode="decode", detectors=["sha1"]).collect()}
    assert found >= {(0, "base64", "decode"), (1, "hex", "decode"), (2, "rot13", "decode"), (3, "utf_16_le", "decode")}
    both = G.generated(df, ids=["id"], exotic=False).collect()
    assert {r.direction for r in both} == {"decode", "encode"}
    assert {(r.id, r.text) for r in both if r.codec == "hex" and r.direction == "encode"} >= {(5, "78")}
    assert G.generated(df, ids=["id"], mode="neither").count() == 0
    assert all(r.direction == "encode" for r in G.generated(df, ids=["id"], mode="encode").collect())


def test_page_verdicts(spark):
    rows = [(1, A32), (2, f"Bob:500:{A32}:{A32}:::"), (3, "nothing here"), (4, f"*{S40.upper()}"), (5, "$P$" + "B" * 31), (6, "550e8400-e29b-41d4-a716-446655440000"), (7, None), (8, "aaaa")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in pages.verdicts(df, ids=["id"], filters="web,win,db,other", uuids=True).collect()}
    assert set(got[1].confident) >= {"md5", "lm", "ntlm"} and got[1].possible[0] == "md4"
    assert "SAM(lm:ntlm)" in got[2].confident and "ntlm" in got[2].likely
    assert "MySQL4+" in got[4].likely and got[5].confident == ["md5-wordpress"] and got[6].confident == ["uuid"]
    assert 3 not in got and 7 not in got and got[8].possible == ["base64"]
    plain = {r.id: r for r in pages.verdicts(df, ids=["id"]).collect()}
    assert set(plain) == {1, 2} and plain[1].likely == ["md5"] and plain[1].details["md5"].endswith(A32)
    assert "Found md5 (likely)" in pages.shown(pages.verdicts(df, ids=["id"])).first().line
    memory = spark.createDataFrame([(4, "init", 0x1000, (b"\0" * 4090 + A32.encode() + b"\0" * 100)), (9, "idle", 0, b"")], "pid int, pname string, vpage long, content binary")
    cut = readers.pages(memory)
    assert [(r.vpage, len(r.text)) for r in cut.collect()] == [(0x1000, 0x1030), (0x2000, 126)]
    assert pages.of_processes(cut, pid=4).count() == 2 and pages.of_processes(cut, name="id").count() == 0 and pages.of_processes(cut).count() == 2
    assert [r.vpage for r in pages.verdicts(cut, ids=["vpage"]).collect()] == [0x1000]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text(f"one {S40}\n")
    (src / "b.txt").write_text("000-000-0000\n")
    found = stream.findings(stream.lines(spark, str(src)), detectors=["sha1", "phone"])
    stream.start(found, "parquet", str(out), str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r.type for r in spark.read.parquet(str(out)).collect()} == {"sha1", "phone"}
    (src / "c.txt").write_text(f"two {S40}\n")
    stream.start(found, "parquet", str(out), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(out)).filter("type = 'sha1'").count() == 2


def test_generator_scans_what_codecs_make_alike_once(spark):
    """By brute force, each codec on its own; and a text of which most codecs make the same isn't scanned for each of them."""
    texts = ["0" * 39 + "a", "", "é" + "b" * 40 + "é", "日本 " + "c" * 40, "+AGE-~{ \x1b$B", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    ways = [(n, d) for n in (*G.PYTHON_TEXT, *G.PYTHON_BYTES) for d in ("decode", "encode") if n not in G.COMPRESSED or d == "encode"]
    want = sorted((i, n, d, made) for i, t in enumerate(texts) if t is not None for n, d in ways if (made := G._python(t, n, d)) is not None)
    found = G.generated(df, ids=["id"]).filter(~F.col("codec").isin("base64", "hex", "rot13", "US-ASCII", "ISO-8859-1", "UTF-8")).collect()
    assert sorted((r.id, r.codec, r.direction, r.text) for r in found) == want
    digests = G.scan_generated(df, ids=["id"], detectors=["sha1"]).filter("codec in ('cp1252', 'gbk')")
    assert sorted((r.id, r.codec, r.direction) for r in digests.collect() if r.id == 0) == [(0, c, d) for c in ("cp1252", "gbk") for d in ("decode", "encode")]
    alike = G._python_texts(df.filter("id = 0"), "text", ["id"], ("decode", "encode")).collect()
    assert len(alike) == len({r.text for r in alike}) < len(ways) / 4 and sum(len(r._ways) for r in alike) == sum(w[0] == 0 for w in want)


def test_texts_of_codecs_are_held_within_bounds(monkeypatch):
    ways = [(n, "decode") for n in G.PYTHON_TEXT]
    whole = list(G._alike("abc", ways))
    monkeypatch.setattr(G, "HELD", 4)
    parts = list(G._alike("abc", ways))
    assert len(parts) > len(whole) and sorted((i, t) for t, of in parts for i in of) == sorted((i, t) for t, of in whole for i in of)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_looked_through_once(spark):
    """Also by the filter of those without anything; the sign of four types is looked for once."""
    df = spark.range(9).withColumn("text", F.concat(F.lit("x "), F.md5(F.col("id").cast("string"))))
    plan = _plan(pages.verdicts(df, ids=["id"], filters="win"))
    assert plan.count("(?<![0-9A-Fa-f])([0-9A-Fa-f]{32})(?![0-9A-Fa-f])") == 1


def test_guards_of_pages_hide_nothing(spark, monkeypatch):
    a, b, c = A32, S40, "ab./XYZ01" * 12
    texts = [a, f"u:1:{a}:{B32}:::", f"u:1:*:{a}", f"{a}:*", f"{b}", f"*{b}", f"{b}{b}", f"0x0100{a}{a[:16]}", b[:16], "0x1", c[:13], c[:31], f"sha1$s${c[:64]}", f"sha384$${c[:96]}",
             f"$5$saltsalt${c[:43]}", f"x$saltsalt${c[:22]}", f"$2a$10${c[:53]}", f"{B32}:{a}", f"{B32}:{a[:16]}", f"{a[:8]}-{a[:4]}-{a[:4]}-{a[:4]}-{a[:12]}", "QUJD", "", "none"]
    df = spark.createDataFrame([(i, f"{before}{t}{after}") for i, (t, before, after) in enumerate((t, x, y) for t in texts for x in ("", "\n ") for y in ("", " .\n"))] + [(-1, None)], "id int, text string")
    found = lambda: pages.verdicts(df, ids=["id"], filters="db,unix,web,win,other", uuids=True).collect()
    guarded = found()
    monkeypatch.setattr(pages, "GUARDS", {k: lambda s: s.isNotNull() for k in pages.GUARDS})
    assert len(guarded) > 40 and guarded == found()


def test_overlaps_are_removed_without_sorting(spark):
    text = spark.createDataFrame([("a", bytearray((S40 + " ").encode() * 20))], "source string, content binary")
    found = scan(readers.windows(text, 500, 300), ids=["source"], base_offset="base_offset", detectors=["sha1"])
    once = report.without_overlaps(found).select("source", "payload", "location")
    assert found.count() > 20 and sorted(r.location for r in once.collect()) == [41 * i for i in range(20)]
    assert "SortAggregate" not in once._jdf.queryExecution().executedPlan().toString()
