"""Files of any size as pieces that can be scanned on their own: each gives what the whole text gives in its place.

A view is the text of a file (its bytes, or what they are decoded to), window after window. Pieces aren't cut where windows end, but at
the first place of a window that nothing found reaches across (`safe`): beside a line break, unless a phone number goes on over
it. A window without such a place belongs to the piece before, whose task reads on until there is one. So the place of each cut depends
on the bytes around it alone, tasks agree on it without telling each other, and each byte is read about twice at most.

Only where SPAN aligned windows in a row (16 MB) have no such place, as in binary data, the first blank between two words among them is
a cut: only the parts of lines that mention secrets could reach across that. Where there is none either, the first window's begin is:
a run of over 16 MB without white space is taken in parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.plans.catalogue import CATALOGUE

WINDOW, SPAN, CONTEXT = 1_000_000, 16, 16
#: Windows of a file in a row that one task reads; a multiple of SPAN.
IN_A_ROW = 64
BLANKS = " \t\n\r\x0b\x0c"
_LINE_END = re.compile("[\r\n]")
_PHONE = re.compile(next(d.pattern for d in CATALOGUE if d.name == "phone"), re.ASCII)
#: No number goes on after a blank with what is no digit, blank or dash.
_BETWEEN_WORDS = re.compile(r"(?<=\S)[ \t\x0b\x0c](?=[^\s0-9\-])", re.ASCII)


def safe(text: str, c: int) -> bool:
    """Whether no match reaches across a place beside a line break. Only phone numbers go over line breaks; one begins at most ten
    characters before, but for blanks after an area code."""
    left, right = text[c - 1], text[c]
    if left in BLANKS and right in BLANKS or ")" in text[c - 2 : c] or left in BLANKS and text[c - 2] in BLANKS and right in "0123456789":
        return False
    return not any((m := _PHONE.match(text, s)) and m.end() > c for s in range(c - 10, c))


def line_cut(text: str, since: int = 0) -> int | None:
    """The first safe place, CONTEXT or more from both ends."""
    low, high = max(since, CONTEXT), len(text) - CONTEXT
    for m in _LINE_END.finditer(text, max(low - 1, 0), max(high, 0)):
        for c in (m.start(), m.start() + 1):
            if low <= c <= high and safe(text, c):
                return c
    return None


def word_cut(text: str, since: int = 0) -> int | None:
    """The first place after a blank between two words."""
    m = _BETWEEN_WORDS.search(text, max(since, CONTEXT), max(len(text) - CONTEXT, 0))
    return m.end() if m else None


class View:
    """The text of a file, window by window; this one takes each byte for a character. Other views say how windows are decoded. The
    texts of all windows, one after the other, are the whole text."""

    #: What a byte offset must be a multiple of for a window to begin there.
    unit = 1
    #: Whether windows may have no text (None); what is before one isn't joined with what is after it.
    gaps = False
    #: Whether places need a sum over the windows before.
    measured = False

    def __init__(self, read: Callable[[int, int], bytes], size: int, window: int = WINDOW) -> None:
        self.read, self.size, self.window = read, size, max(1, window // self.unit) * self.unit
        self.windows = -(-size // self.window)
        #: Sums over the windows before, as far as they are known.
        self.before: dict[int, int] = {0: 0}

    def text(self, k: int) -> str | None:
        return self.read(k * self.window, self.window).decode("latin-1")

    def measure(self, k: int) -> int:
        return len(self.text(k) or "")

    def start(self, k: int) -> int:
        """The place of text(k) in the whole text."""
        return self.sum(k) if self.measured else k * self.window

    def sum(self, k: int) -> int:
        m = k
        while m not in self.before:
            m -= 1
        for i in range(m, k):
            self.before[i + 1] = self.before[i] + self.measure(i)
        return self.before[k]


class Cutter:
    """The pieces of a view."""

    def __init__(self, view: View, span: int = SPAN) -> None:
        self.view, self.span = view, span
        self.text = lru_cache(4)(view.text)
        self.line = lru_cache(None)(self._line)
        self.fallback = lru_cache(None)(self._fallback)

    def _line(self, k: int) -> int | None:
        if k == 0 or self.view.gaps and self.text(k - 1) is None:
            return 0
        text = self.text(k) or ""
        found = line_cut(text)
        if found is None and text:  # places near the window's edges, for which its neighbours must be looked at
            left, right = (self.text(k - 1) or "")[-CONTEXT:], (self.text(k + 1) or "")[:CONTEXT] if k + 1 < self.view.windows else ""
            found = line_cut(left + text + right)
            found = found - len(left) if found is not None and 0 <= found - len(left) < len(text) else None
        return found

    def _fallback(self, first: int) -> tuple[int, int] | None:
        """The window and place of the cut of a span that has no safe one; None if it has."""
        span = range(first, min(first + self.span, self.view.windows))
        if any(self.line(m) is not None for m in span):
            return None
        found = ((m, word_cut(self.text(m) or "")) for m in span)
        return next(((m, c) for m, c in found if c is not None), (first, 0))

    def cut(self, k: int) -> int | None:
        """Where the first piece that begins in window k begins in its text; None if none does."""
        own = self.line(k)
        if own is not None:
            return own
        other = self.fallback(k // self.span * self.span)
        return other[1] if other is not None and other[0] == k else None

    def piece(self, k: int) -> tuple[int, str, bool] | None:
        """Place, text, and whether the whole text ends with it, of the piece that begins in window k."""
        begin = self.cut(k)
        if begin is None or self.text(k) is None:
            return None
        parts, m = [self.text(k)[begin:]], k + 1
        while m < self.view.windows:
            more = self.text(m)
            end = self.cut(m)
            if more is None or end is not None:
                parts.append((more or "")[: end or 0])
                break
            parts.append(more)
            m += 1
        whole = "".join(parts)
        return (self.view.start(k) + begin, whole, m >= self.view.windows) if whole else None


def streamed(chunks: Iterator[str], window: int = WINDOW, span: int = SPAN) -> Iterator[tuple[int, str, bool]]:
    """The pieces of a text that can only be had from its begin on, as it comes."""
    base, held, tried = 0, "", 0
    for chunk in chunks:
        held += chunk
        while len(held) >= window + 2 * CONTEXT:
            c = line_cut(held, max(window, tried))
            if c is None:
                tried = len(held) - CONTEXT
                if len(held) < span * window:
                    break
                c = word_cut(held, window) or len(held)
            yield base, held[:c], False
            base, held, tried = base + c, held[c:], 0
    yield base, held, True


# Files


def opened(source: str) -> Callable[[int, int], bytes]:
    """Reads n bytes of a file at a place."""
    system, inner = fs.FileSystem.from_uri(source if "://" in source else "file://" + quote(source.removeprefix("file:")))
    stream = system.open_input_file(inner)
    return lambda at, n: stream.read_at(n, at)


def dealt(rows: DataFrame, window: int, *names: str) -> DataFrame:
    """rows (source, length, further names) with a row for each window k, dealt out to tasks, IN_A_ROW windows together."""
    windows = rows.filter("length > 0").withColumn("k", F.explode(F.expr(f"sequence(0L, (length - 1) div {window}L)")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(tasks, "source", *names, F.floor(F.col("k") / IN_A_ROW)).sortWithinPartitions("source", *names, "k")


#: Rows, and characters of their texts, that go to Spark together.
TOGETHER, TOGETHER_SIZE = 4096, 1 << 22


def _together(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """Rows in lists of bounded length and size: a batch for each would cost more than what is in it."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= TOGETHER or total >= TOGETHER_SIZE:
            yield held
            held, total = [], 0
    if held:
        yield held


def read(listed: DataFrame, views: Callable[[str], Callable[..., View]], names: list[tuple[str, bool]], window: int = WINDOW, span: int = SPAN, unit: int = 1) -> DataFrame:
    """source, view, base_offset, text and last of all pieces of files (source, length), in each of the named views. names: the views and
    whether they are measured; views: what makes one, by name; unit: a multiple of all views' units."""
    window = max(1, window // unit) * unit
    spark = listed.sparkSession

    def found(batches: Iterator[pa.RecordBatch], act: Callable[[View, Cutter, int], dict | None]) -> Iterator[dict]:
        now, view, cutter = None, None, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("source", "length", "view", "k", "before") if c in batch.schema.names]
            for source, length, name, k, *before in zip(*columns):
                if (source, name) != now:
                    now, view = (source, name), views(name)(opened(source), length, window)
                    cutter = Cutter(view, span)
                if before:
                    view.before[k] = before[0]
                row = act(view, cutter, k)
                if row is not None:
                    yield {"source": source, "length": length, "view": name, "k": k} | row

    def each(batches: Iterator[pa.RecordBatch], act: Callable[[View, Cutter, int], dict | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for rows in _together(found(batches, act), lambda row: len(row.get("text", ""))):
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in rows], f.type) for f in schema], schema=schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("source", pa.string()), ("view", pa.string()), ("base_offset", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])
        yield from each(batches, lambda view, cutter, k: dict(zip(("base_offset", "text", "last"), found)) if (found := cutter.piece(k)) else None, out)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("source", pa.string()), ("length", pa.int64()), ("view", pa.string()), ("k", pa.int64()), ("n", pa.int64())])
        yield from each(batches, lambda view, cutter, k: {"n": view.measure(k)}, out)

    made = None
    for measured in (False, True):
        chosen = [n for n, m in names if m == measured]
        if not chosen:
            continue
        rows = dealt(listed.select("source", "length").withColumn("view", F.explode(F.array(*map(F.lit, chosen)))), window, "view")
        if measured:
            before = Window.partitionBy("source", "view").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.mapInArrow(sizes, "source string, length long, view string, k long, n long").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.drop("n").repartition(tasks, "source", "view", F.floor(F.col("k") / IN_A_ROW)).sortWithinPartitions("source", "view", "k")
        one = rows.mapInArrow(pieces, "source string, view string, base_offset long, text string, last boolean")
        made = one if made is None else made.unionByName(one)
    return made


def of_content(content: DataFrame, view: Callable[..., View], ids: tuple[str, ...] = ("source",), window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """ids, base_offset, text and last of the pieces of the binary column `content`, one piece after the other."""
    names = (*ids, "base_offset", "text", "last")

    def found(values: pa.Array) -> Iterator[tuple[int, int, str, bool]]:
        for i, value in enumerate(values):
            data = value.as_py()
            if data:
                made = view(lambda at, n, data=data: data[at : at + n], len(data), window)
                cutter = Cutter(made, span)
                for k in range(made.windows):
                    piece = cutter.piece(k)
                    if piece:
                        yield i, piece[0], piece[1], piece[2]

    schema = ", ".join(f"`{c}` {content.schema[c].dataType.simpleString()}" for c in ids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _together(found(batch["content"]), lambda row: len(row[2])):
                places, *own = zip(*rows)
                own = [pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(places, pa.int64())) for c in ids), *own], list(names))

    return content.select(*ids, "content").mapInArrow(each, f"{schema}, base_offset long, text string, last boolean")


def file_pieces(listed: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """source, base_offset, text and last of the pieces of files (source, length), a character for each byte."""
    return read(listed, lambda name: View, [("bytes", False)], window, span).drop("view")


def lines_of(spark: SparkSession, listed: DataFrame, window: int = WINDOW) -> DataFrame:
    """source, base_offset and text of each line of files (source, length): a character for each byte, its own line feed with it (the
    last line may have none). A window's lines are those that begin in it; its task reads on to the end of the last one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, length, k in zip(*(batch[c].to_pylist() for c in ("source", "length", "k"))):
                get = opened(source)
                at = k * window
                end = min(at + window, length)
                # from the byte before, which says whether a line begins with the window
                data = get(max(at - 1, 0), end - max(at - 1, 0))
                if k:
                    first = data.find(b"\n") + 1
                    if not first or at - 1 + first >= end:
                        continue
                    at, data = at - 1 + first, data[first:]
                parts = [data]
                while not parts[-1].endswith(b"\n") and end < length:
                    more = get(end, min(window, length - end))
                    stop = more.find(b"\n") + 1
                    parts.append(more[:stop] if stop else more)
                    end += len(more)
                rows = re.findall(rb"[^\n]*\n|[^\n]+", b"".join(parts))
                starts = [at]
                for r in rows:
                    starts.append(starts[-1] + len(r))
                for a in range(0, len(rows), 4096):
                    some = [r.decode("latin-1") for r in rows[a : a + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(some), pa.string()), pa.array(starts[a : a + len(some)], pa.int64()), pa.array(some, pa.string())], ["source", "base_offset", "text"])

    return dealt(listed.select("source", "length"), window).mapInArrow(each, "source string, base_offset long, text string")
