"""The preprocessor: bytes read as packed binary records, each record's first value (or all) written out as text.

Where the values are integers, they are Spark expressions; other formats take an Arrow UDF. Files are read in ranges of whole records,
and what is written out is cut into pieces as any other text is.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.sources import pieces as P
from tracelode.sources import readers

_FIELD = re.compile(r"\s*([0-9]*)([xcbBhHiIlLqQnNspPfdeFD?])")


def size_of(fmt: str) -> int:
    """Bytes of a record; fmt is checked here, so that a bad one fails before any job runs."""
    size = struct.calcsize(fmt)
    if size == 0:
        raise ValueError("the format has no size")
    return size


def written(data: bytes, fmt: str, all_fields: bool = False) -> str:
    """The values of all whole records of data, without a separator."""
    size = struct.calcsize(fmt)
    rows = struct.iter_unpack(fmt, data[: len(data) - len(data) % size])
    values = (v for row in rows for v in (row if all_fields else row[:1]))
    return "".join([v.decode("latin-1") if isinstance(v, bytes) else str(v) for v in values])


def integers(fmt: str, all_fields: bool = False) -> list[tuple[int, int, bool]] | None:
    """Place, bytes and sign of the integers that are written out of each record; None if other values are."""
    order = fmt.strip()[:1] if fmt.strip()[:1] in tuple("@=<>!") else ""
    done, out = order, []
    for count, code in _FIELD.findall(fmt.strip()[len(order) :]):
        for _ in range(int(count or 1) if code not in "sp" else 1):
            unit = count + code if code in "sp" else code
            size = struct.calcsize((order or "@") + unit)
            done += unit
            if code == "x":
                continue
            if code not in "bBhHiIlLqQnN":
                return None
            out.append((struct.calcsize(done) - size, size, code.islower()))
            if not all_fields:
                return out
    return out or None


def _little(fmt: str) -> bool:
    order = fmt.strip()[:1]
    return order == "<" or order not in (">", "!") and struct.pack("=H", 1)[0] == 1


def _native(content: Column, fmt: str, fields: list[tuple[int, int, bool]]) -> Column:
    """Integers as expressions: two hex digits a byte, turned round if the lowest byte comes first. Numbers with a sign are read as
    those of 16 digits, filled up with their sign."""
    size, little = size_of(fmt), _little(fmt)

    def value(at: Column, n: int, signed: bool) -> Column:
        digits = F.hex(F.substring(content, at, F.lit(n)))
        if little:
            digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])
        if not signed:
            return F.conv(digits, 16, 10)
        return F.conv(F.lpad(digits, 16, "0") if n == 8 else F.concat(F.when(F.substring(digits, 1, 1) >= "8", F.lit("F" * (16 - 2 * n))).otherwise(F.lit("0" * (16 - 2 * n))), digits), 16, -10)

    count = F.floor(F.length(content) / size).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(*[value(i * size + 1 + at, n, signed) for at, n, signed in fields]))
    return F.when(count > 0, F.array_join(each, "")).when(content.isNotNull(), F.lit(""))


def unpacked(content: Column, fmt: str, all_fields: bool = False) -> Column:
    """The values of successive records of a struct format, joined without a separator; a short rest is dropped."""
    size_of(fmt)
    fields = integers(fmt, all_fields)
    if fields:
        return _native(content, fmt, fields)

    @F.pandas_udf("string")
    def each(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else written(bytes(b), fmt, all_fields))

    return each(content)


def preprocess(df: DataFrame, fmt: str, content: str = "content", text: str = "text", all_fields: bool = False) -> DataFrame:
    """df with the column `text` unpacked from the binary column `content`."""
    return df.withColumn(text, unpacked(F.col(content).cast("binary"), fmt, all_fields))


def records(fmt: str, all_fields: bool = False) -> type[P.View]:
    """A view: what is written out of a file's records. Windows are whole records; only the last one's short rest is dropped."""

    class Records(P.View):
        unit, measured = size_of(fmt), True

        def __init__(self, read: Callable[[int, int], bytes], size: int, window: int = P.WINDOW) -> None:
            super().__init__(read, size // self.unit * self.unit, window)

        def text(self, k: int) -> str:
            return written(self.read(k * self.window, self.window), fmt, all_fields)

    return Records


def _viewed(listed: DataFrame, make: Callable[[], type[P.View]], unit: int, window: int) -> DataFrame:
    return P.read(listed, lambda name: make(), [("records", True)], window, unit=unit).drop("view")


def file_records(spark: SparkSession, path: str, fmt: str, pattern: str = "*", recursive: bool = False, all_fields: bool = False, window: int = P.WINDOW) -> DataFrame:
    """source, base_offset, text and last of what is written out of files' records; places are those in what is written out."""
    return _viewed(readers.sizes(spark, path, pattern, recursive), lambda: records(fmt, all_fields), size_of(fmt), window)
