"""The generator: texts as other codecs would read or write them, so that wrapped artefacts can be scanned.

Of texts in cells: base64, hex, rot13 and the charsets that Spark knows are expressions; the others run over Arrow batches in Python's
codecs, which give each different text once with those that make it, but for decompression, which gives its output in pieces as it comes, however much there is. What a codec can't decode or
encode is left out. The list of codecs is fixed, so results don't depend on the interpreter.

Of files of any size: each codec is a view (sources/pieces.py), so that what is decoded goes on across windows of bytes.
* base64 and hex: all digits of a file in their order, whatever stands between them, decoded once for each place in a group at which
  they can begin (4 and 2 phases). Where a window's groups begin follows from how many digits are before it, a running sum. So what
  is wrapped is found at any place of the file, in one phase.
* UTF-16 and UTF-32: once for each place in a unit; what is no character becomes U+FFFD.
* charsets of more bytes a character: windows move to after a line feed, where all of these begin anew (without one, to after a
  character below 0x30, which no longer character contains); a window that a charset can't decode is left out.
* compressed files: one task a file, from its begin on, in pieces.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tracelode.functions import text as T
from tracelode.operators.scan import scan
from tracelode.sources import pieces as P
from tracelode.sources import readers

LETTERS, ROTATED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
#: The other codecs that Python has names for, but for those of one system only.
PYTHON_TEXT = tuple(
    """
    big5 big5hkscs cp037 cp1026 cp1125 cp1140 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 cp273 cp424 cp437 cp500 cp775 cp850 cp852
    cp855 cp857 cp858 cp860 cp861 cp862 cp863 cp864 cp865 cp866 cp869 cp932 cp949 cp950 euc_jis_2004 euc_jisx0213 euc_jp euc_kr gb18030 gb2312 gbk
    hp_roman8 hz iso2022_jp iso2022_jp_1 iso2022_jp_2 iso2022_jp_2004 iso2022_jp_3 iso2022_jp_ext iso2022_kr iso8859_10 iso8859_11 iso8859_13 iso8859_14
    iso8859_15 iso8859_16 iso8859_2 iso8859_3 iso8859_4 iso8859_5 iso8859_6 iso8859_7 iso8859_8 iso8859_9 johab koi8_r kz1048 mac_cyrillic mac_greek
    mac_iceland mac_latin2 mac_roman mac_turkish ptcp154 shift_jis shift_jis_2004 shift_jisx0213 tis_620 utf_16 utf_16_be utf_16_le utf_32 utf_32_be
    utf_32_le utf_7
    """.split()
)
PYTHON_BYTES = ("bz2_codec", "quopri_codec", "uu_codec", "zlib_codec")
#: Those whose output has no bound by their input's size.
COMPRESSED = ("bz2_codec", "zlib_codec")
DIRECTIONS = {"both": ("decode", "encode"), "decode": ("decode",), "encode": ("encode",)}
#: Bytes of one step of decompression.
STEP = 1 << 20


#: Characters of different texts that one row's codecs may make before they are handed on.
HELD = 1 << 24


def _python(s: str, name: str, way: str) -> str | None:
    """What one codec makes of a text; None where it can't."""
    try:
        if way == "encode" and name not in PYTHON_BYTES:
            return s.encode(name).decode("latin-1")
        raw = s.encode("latin-1", errors="replace")
        if name in PYTHON_BYTES:
            return (codecs.decode(raw, name) if way == "decode" else codecs.encode(raw, name)).decode("latin-1")
        return raw.decode(name)
    except Exception:
        return None


def _alike(s: str, ways: Sequence[tuple[str, str]]) -> Iterator[tuple[str, list[int]]]:
    """The different texts that codecs make of one, each with the places in `ways` of those that make it. What is held is bounded: a long
    text's may come in several rows."""
    held, size = {}, 0
    for i, (name, way) in enumerate(ways):
        made = _python(s, name, way)
        if made is None:
            continue
        if made in held:
            held[made].append(i)
            continue
        if size + len(made) > HELD:
            yield from held.items()
            held, size = {}, 0
        held[made], size = [i], size + len(made)
    yield from held.items()


def _python_texts(df: DataFrame, text: str, ids: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """ids, the array _ways of codecs and directions, and the text that these make, of all codecs in Python: most of them make the same of
    a text, which is scanned once for all of them."""
    ways = [(n, d) for n in (*PYTHON_TEXT, *PYTHON_BYTES) for d in wanted if n not in COMPRESSED or d == "encode"]
    schema = ST.StructType([*(df.schema[c] for c in ids), ST.StructField("_of", ST.ArrayType(ST.IntegerType())), ST.StructField("text", ST.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, made, size = [], [], [], 0

            def out(rows: list[int], of: list[list[int]], made: list[str], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                own = [pa.array(of, pa.list_(pa.int32())), pa.array(made, pa.string())]
                return pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows, pa.int64())) for c in ids), *own], [*ids, "_of", "text"])

            for i, value in enumerate(batch["_text"]):
                for found, places in _alike(value.as_py(), ways):
                    rows.append(i), of.append(places), made.append(found)
                    size += len(found)
                    if size > HELD or len(rows) >= 10_000:
                        yield out(rows, of, made)
                        rows, of, made, size = [], [], [], 0
            if rows:
                yield out(rows, of, made)

    made = df.filter(F.col(text).isNotNull()).select(*ids, F.col(text).alias("_text")).mapInArrow(each, schema)
    named = F.expr(f"array({', '.join(f"named_struct('codec', '{n}', 'direction', '{d}')" for n, d in ways)})") if ways else F.array().cast("array<struct<codec: string, direction: string>>")
    return made.select(*ids, F.transform("_of", lambda i: F.get(named, i)).alias("_ways"), F.lit(0).cast("long").alias("base_offset"), "text", F.lit(True).alias("last"))


def decompressed(chunks: Iterable[bytes], name: str) -> Iterator[bytes]:
    """What compressed bytes hold, in steps of STEP bytes at most; ValueError where they are wrong or end too soon. What follows the
    end of the data is ignored, but for further bz2 streams."""
    make = zlib.decompressobj if name == "zlib_codec" else bz2.BZ2Decompressor
    d, ended = make(), False
    try:
        for chunk in chunks:
            while chunk or not d.eof:
                if d.eof:
                    ended = True
                    if name == "zlib_codec" or not chunk.startswith(b"BZh"[: len(chunk)]):
                        return
                    d = make()
                out = d.decompress(chunk, STEP)
                if out:
                    yield out
                if d.eof:
                    chunk = d.unused_data
                    continue
                chunk = d.unconsumed_tail if name == "zlib_codec" else b""
                if not chunk and (len(out) < STEP if name == "zlib_codec" else d.needs_input):
                    break
    except (zlib.error, OSError, EOFError) as e:
        if not ended:  # something else after a whole stream
            raise ValueError(name) from e
        return
    if not (d.eof or ended):
        raise ValueError(name)


def _inflated(chunks: Callable[[], Iterable[bytes]], name: str) -> Iterator[tuple[int, str, bool]]:
    """The pieces of what compressed bytes hold; none if they can't be decoded. They are gone through twice, so that nothing is
    handed on of what turns out to be wrong, and never more than a piece is held."""
    try:
        for _ in decompressed(chunks(), name):
            pass
    except ValueError:
        return
    yield from P.streamed(b.decode("latin-1") for b in decompressed(chunks(), name))


def _decompressed_cells(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    names = [*ids, "codec", "direction", "base_offset", "text", "last"]
    schema = ST.StructType([*(df.schema[c] for c in ids), *(ST.StructField(c, t) for c, t in zip(names[len(ids) :], (ST.StringType(), ST.StringType(), ST.LongType(), ST.StringType(), ST.BooleanType())))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch["_text"]):
                raw = value.as_py().encode("latin-1", errors="replace")
                for name in COMPRESSED:
                    for found in _inflated(lambda raw=raw: [raw], name):
                        cells = (name, "decode", *found)
                        yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, 1) for c in ids), *(pa.array([x], t) for x, t in zip(cells, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())))], names)

    return df.filter(F.col(text).isNotNull()).select(*ids, F.col(text).alias("_text")).mapInArrow(each, schema)


def _native(df: DataFrame, text: str, ids: Sequence[str], mode: str, exotic: bool) -> DataFrame:
    """What expressions make of texts, and what is decompressed (if exotic). The names of codecs are exploded first, so that a row holds
    what one codec makes of one text."""
    s, codec = F.col(text), F.col("_codec")
    raw = F.encode(F.when(s.rlike(r"\A[\x00-\xFF]*\z"), s), "ISO-8859-1")
    latin: Column = s.rlike(r"\A[\x00-\xFF]*\z")
    ascii_: Column = s.rlike(r"\A[\x00-\x7F]*\z")
    hexed = s.rlike(r"\A(?:[0-9A-Fa-f]{2})+\z")
    rotated = F.translate(s, LETTERS, ROTATED)
    native = {
        "base64": (F.when(s.rlike("[A-Za-z0-9+/]"), T.base64_text(s)), F.when(latin, F.base64(raw))),
        "hex": (F.when(hexed, F.decode(F.unhex(F.when(hexed, s)), "ISO-8859-1")), F.when(latin, F.lower(F.hex(raw)))),
        "rot13": (rotated, rotated),
        "US-ASCII": (F.when(ascii_, s), F.when(ascii_, s)),
        "ISO-8859-1": (F.when(latin, s), F.when(latin, s)),
        "UTF-8": (F.when(latin & F.is_valid_utf8(raw.cast("string")), raw.cast("string")), F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")),
    }
    wanted = DIRECTIONS.get(mode, ())

    def rows(names: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("_codec"), F.lit(d).alias("_direction")) for n in names for d in wanted if n not in COMPRESSED or d == "encode"])
        return df.filter(s.isNotNull()).select(*ids, text, F.inline(pairs if wanted else F.array().cast("array<struct<_codec: string, _direction: string>>")))

    made = None
    for name, (decoded, encoded) in native.items():
        value = F.when((codec == name) & (F.col("_direction") == "decode"), decoded).when((codec == name) & (F.col("_direction") == "encode"), encoded)
        made = value if made is None else F.coalesce(made, value)
    out = rows(tuple(native)).select(*ids, codec.alias("codec"), F.col("_direction").alias("direction"), made.alias("text"))
    out = out.filter(F.col("text").isNotNull()).select(*ids, "codec", "direction", F.lit(0).cast("long").alias("base_offset"), "text", F.lit(True).alias("last"))
    if exotic and "decode" in wanted:
        out = out.unionByName(_decompressed_cells(df, text, ids))
    return out


def generated(df: DataFrame, text: str = "text", ids: Sequence[str] = (), mode: str = "both", exotic: bool = True) -> DataFrame:
    """ids, codec, direction ('decode' or 'encode') and the text that comes of it, with base_offset and last: what is decompressed comes
    in pieces. mode: decode, encode or both; others give none."""
    out, wanted = _native(df, text, ids, mode, exotic), DIRECTIONS.get(mode, ())
    return out.unionByName(_python_texts(df, text, ids, wanted).select(*ids, F.inline("_ways"), "base_offset", "text", "last")) if exotic else out


def scan_generated(df: DataFrame, text: str = "text", ids: Sequence[str] = (), mode: str = "both", exotic: bool = True, **options) -> DataFrame:
    """Findings in what every codec makes of the texts, with codec and direction. What several codecs in Python make alike is scanned once."""
    found = scan(_native(df, text, ids, mode, exotic), "text", [*ids, "codec", "direction"], base_offset="base_offset", last="last", **options)
    if not exotic:
        return found
    alike = scan(_python_texts(df, text, ids, DIRECTIONS.get(mode, ())), "text", [*ids, "_ways"], base_offset="base_offset", last="last", **options)
    others = [c for c in alike.columns if c not in (*ids, "_ways")]
    return found.unionByName(alike.select(*ids, F.inline("_ways"), *others))


# Files


def _grouped(alphabet: bytes, per: int, made: int, decode: Callable[[bytes], bytes], phase: int) -> type[P.View]:
    """The digits of an alphabet in groups of `per`, of which each gives `made` bytes, from the place `phase` among all digits on."""
    other = bytes(set(range(256)) - set(alphabet))

    class Grouped(P.View):
        measured = True

        def digits(self, k: int) -> bytes:
            return self.read(k * self.window, self.window).translate(None, other)

        def measure(self, k: int) -> int:
            return len(self.digits(k))

        def text(self, k: int) -> str:
            skip = (phase - self.sum(k)) % per
            data, m = self.digits(k)[skip:], k + 1
            while data and len(data) % per and m < self.windows:  # the rest of the last group that begins here
                data, m = data + self.digits(m)[: -len(data) % per], m + 1
            return decode(data[: len(data) // per * per]).decode("latin-1")

        def start(self, k: int) -> int:
            return (self.sum(k) + (phase - self.sum(k)) % per - phase) // per * made

    return Grouped


def _wide(codec: str, width: int, phase: int) -> type[P.View]:
    """UTF-16 or UTF-32 from a place in a unit on."""

    class Wide(P.View):
        unit, measured = 4, True

        def text(self, k: int) -> str:
            a, e = (b + (phase - b) % width for b in (k * self.window, min((k + 1) * self.window, self.size)))
            if width == 2:  # a pair belongs to the window of its first half
                a, e = (b + 2 if b > phase and self._second(b) else b for b in (a, e))
            data = self.read(a, e - a)
            return data[: len(data) // width * width].decode(codec, errors="replace")

        def _second(self, at: int) -> bool:
            """Whether the unit at a place is the second half of a pair that begins before it."""
            two = self.read(at - 2, 4)
            high = 1 if codec.endswith("le") else 0
            return len(two) == 4 and two[high] & 0xFC == 0xD8 and two[2 + high] & 0xFC == 0xDC

    return Wide


def _charset(codec: str) -> type[P.View]:
    several = codec in SEVERAL_BYTES

    class Charset(P.View):
        gaps, measured = True, True

        def begin(self, k: int) -> int:
            b = k * self.window
            if not several or k == 0:
                return min(b, self.size)
            data = self.read(b - 1, self.window)
            found = re.search(rb"\n", data) or re.search(rb"[\x00-\x2F](?=[\x00-\x7F])", data)
            return b - 1 + found.end() if found else b

        def text(self, k: int) -> str | None:
            a, e = self.begin(k), self.begin(k + 1) if k + 1 < self.windows else self.size
            try:
                return self.read(a, e - a).decode(codec)
            except UnicodeDecodeError:
                return None

    return Charset


#: The charsets with characters of several bytes.
SEVERAL_BYTES = frozenset(
    """
    big5 big5hkscs cp932 cp949 cp950 euc_jis_2004 euc_jisx0213 euc_jp euc_kr gb18030 gb2312 gbk hz iso2022_jp iso2022_jp_1 iso2022_jp_2 iso2022_jp_2004
    iso2022_jp_3 iso2022_jp_ext iso2022_kr johab shift_jis shift_jis_2004 shift_jisx0213 utf_7 utf_8
    """.split()
)
_WIDE = {"utf_16_le": 2, "utf_16_be": 2, "utf_32_le": 4, "utf_32_be": 4}
#: Views of files by codec, with their number of phases. UTF-16 and UTF-32 with a mark are the same as with the order that it says.
VIEWS = {"base64": 4, "hex": 2, **_WIDE, "UTF-8": 1, **{c: 1 for c in PYTHON_TEXT if c not in _WIDE and c not in ("utf_16", "utf_32")}}


def view(name: str) -> type[P.View]:
    """The view of a name: a codec, a colon and a phase."""
    codec, phase = name.rsplit(":", 1)
    if codec == "base64":
        return _grouped(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 4, 3, base64.b64decode, int(phase))
    if codec == "hex":
        return _grouped(b"0123456789ABCDEFabcdef", 2, 1, lambda b: bytes.fromhex(b.decode()), int(phase))
    if codec in _WIDE:
        return _wide(codec, _WIDE[codec], int(phase))
    return _charset("utf_8" if codec == "UTF-8" else codec)


def _file_chunks(get: Callable[[int, int], bytes], length: int) -> Iterator[bytes]:
    for at in range(0, length, STEP):
        yield get(at, min(STEP, length - at))


def _decompressed_files(listed: DataFrame) -> DataFrame:
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, length, codec in zip(*(batch[c].to_pylist() for c in ("source", "length", "codec"))):
                get = P.opened(source)
                for base, text, last in _inflated(lambda get=get, length=length: _file_chunks(get, length), codec):
                    yield pa.RecordBatch.from_pylist([{"source": source, "codec": codec, "phase": 0, "base_offset": base, "text": text, "last": last}], pa.schema([("source", pa.string()), ("codec", pa.string()), ("phase", pa.int32()), ("base_offset", pa.int64()), ("text", pa.string()), ("last", pa.bool_())]))

    rows = listed.select("source", "length", F.explode(F.array(*map(F.lit, COMPRESSED))).alias("codec")).repartition(tasks, "source", "codec")
    return rows.mapInArrow(each, "source string, codec string, phase int, base_offset long, text string, last boolean")


def file_generated(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, mode: str = "decode", codecs_: Sequence[str] | None = None, window: int = P.WINDOW) -> DataFrame:
    """source, codec, direction, phase, base_offset, text and last of what each codec (or those given) makes of files. base_offset is
    the place in what a codec makes of the whole file (of the piece, where it encodes one)."""
    listed = readers.sizes(spark, path, pattern, recursive)
    columns = ("source", "codec", "direction", "phase", "base_offset", "text", "last")
    parts = []
    if mode in ("both", "decode"):
        names = [(f"{c}:{p}", True) for c, n in VIEWS.items() if codecs_ is None or c in codecs_ for p in range(n)]
        if names:
            found = P.read(listed, view, names, window, unit=4)
            parts.append(found.withColumns({"codec": F.substring_index("view", ":", 1), "phase": F.substring_index("view", ":", -1).cast("int")}))
        if codecs_ is None or set(COMPRESSED) & set(codecs_):
            found = _decompressed_files(listed)
            parts.append(found if codecs_ is None else found.filter(F.col("codec").isin(*codecs_)))
        parts = [p.withColumn("direction", F.lit("decode")) for p in parts]
    # what works on characters alone, piece by piece
    made = generated(P.file_pieces(listed, window).withColumnRenamed("base_offset", "_base").withColumnRenamed("last", "_last"), ids=["source", "_base", "_last"], mode=mode)
    own = ~F.col("codec").isin(*VIEWS, *COMPRESSED) & (F.col("direction") == "decode") | (F.col("direction") == "encode")
    made = made.filter(own).withColumn("base_offset", F.col("_base")).withColumn("last", F.col("_last")).withColumn("phase", F.lit(0))
    parts.append(made if codecs_ is None else made.filter(F.col("codec").isin(*codecs_)))
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, mode: str = "decode", codecs_: Sequence[str] | None = None, window: int = P.WINDOW, **options) -> DataFrame:
    """Findings in what codecs make of files, with source, codec, direction and phase."""
    made = file_generated(spark, path, pattern, recursive, mode, codecs_, window)
    return scan(made, ids=["source", "codec", "direction", "phase"], base_offset="base_offset", last="last", **options)
