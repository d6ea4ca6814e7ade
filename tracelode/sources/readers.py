"""Where texts come from: strings, files and directories, lines, pages of memory, windows.

All give the columns source, base_offset and text. Bytes are read as ISO-8859-1, one character per byte, so that locations are byte
offsets. Any table with a string column can be scanned as it is.

Files are read in pieces that nothing found reaches across (sources/pieces.py), which also have `last`. Overlapping windows of a
fixed size are there for `strict` scans, and for texts in cells; they have keep_from and keep_to: a window answers for the matches
that begin in it at least half the overlap from either edge (but for the edges of the file), so that each place belongs to one window
and has half the overlap around it. A match that a window cuts is then left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.sources import pieces as P

WINDOW, OVERLAP = 1_000_000, 5_000


def strings(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(str(i), 0, v) for i, v in enumerate(values)], "source string, base_offset long, text string")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """source, length and content of the files of a path; pattern is a glob on their names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern != "*":
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("source"), "length", "content")


def window_starts(length: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Where windows begin: one for a short file, then every window less the overlap, until one reaches the end; none if empty."""
    step = window - overlap
    many = F.sequence(F.lit(0).cast("long"), F.greatest(length - overlap - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    return F.when(length <= 0, F.array().cast("array<bigint>")).when(length < overlap, F.array(F.lit(0).cast("long"))).otherwise(many)


def _edges(rows: DataFrame, window: int, overlap: int) -> DataFrame:
    """rows (length, base_offset) with last, keep_from and keep_to (null in the last window), in characters of the window."""
    half = overlap // 2
    last = F.col("base_offset") + window >= F.col("length")
    return rows.withColumns({"last": last, "keep_from": F.when(F.col("base_offset") > 0, half).otherwise(0), "keep_to": F.when(~last, window - overlap + half)})


def windows(content: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Contents (source, content) as windows; only the bytes of one window are decoded at a time."""
    rows = content.withColumn("length", F.length("content").cast("long")).withColumn("base_offset", F.explode(window_starts(F.col("length"), window, overlap)))
    text = F.decode(F.substring("content", (F.col("base_offset") + 1).cast("int"), F.lit(window)), "ISO-8859-1")
    return _edges(rows.withColumn("text", text), window, overlap).select("source", "base_offset", "text", "last", "keep_from", "keep_to")


def file_windows(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Files of any size as windows. Only names and lengths are listed; the windows of a file are dealt to many tasks, each of which
    reads the bytes of its windows and no others, one window at a time."""
    listed = files(spark, path, pattern, recursive).select("source", "length").withColumn("base_offset", F.explode(window_starts(F.col("length"), window, overlap)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _edges(listed, window, overlap).select("source", "base_offset", "last", "keep_from", "keep_to").repartition(tasks, "source", F.floor(F.col("base_offset") / (64 * window)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, get = None, None
        for batch in batches:
            for i, (source, at) in enumerate(zip(batch["source"].to_pylist(), batch["base_offset"].to_pylist())):
                if source != name:
                    name, get = source, P.opened(source)
                text = get(at, window).decode("latin-1")
                yield pa.RecordBatch.from_arrays([batch["source"].slice(i, 1), batch["base_offset"].slice(i, 1), pa.array([text], pa.string()), *(batch[c].slice(i, 1) for c in ("last", "keep_from", "keep_to"))], ["source", "base_offset", "text", "last", "keep_from", "keep_to"])

    return dealt.mapInArrow(read, "source string, base_offset long, text string, last boolean, keep_from int, keep_to int")


def sizes(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """source and length of the files of a path; their contents aren't read."""
    return files(spark, path, pattern, recursive).select("source", "length")


def directory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, window: int = WINDOW) -> DataFrame:
    """The files of a path in pieces of about a window: source, base_offset, text, last."""
    return P.file_pieces(sizes(spark, path, pattern, recursive), window)


def lines(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, window: int = WINDOW) -> DataFrame:
    """Each line of files on its own, byte for byte, with its own line feed, if it has one, and its place in the file."""
    return P.lines_of(spark, sizes(spark, path, pattern, recursive), window)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where the input has fewer files than that (a small table with much to scan); a large input is left
    as it is."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def pages(content: DataFrame, page: int = 0x1000, over_read: int = 0x30) -> DataFrame:
    """Mappings (pid, pname, vpage, content...) cut into pages, each with the first bytes of the next one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(page))
    rows = content.filter(F.length("content") > 0).withColumn("_at", F.explode(starts))
    return rows.withColumn("text", F.decode(F.substring("content", F.col("_at") + 1, F.lit(page + over_read)), "ISO-8859-1")).withColumn("vpage", F.col("vpage") + F.col("_at")).drop("content", "_at")


def image_pages(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, page: int = 0x1000, over_read: int = 0x30, window: int = WINDOW) -> DataFrame:
    """Raw memory images of any size as pages: source, vpage (the place in the file) and text, with the first bytes of the next page.
    Each task reads its own ranges of whole pages, and so much of what follows as the last one reads over."""
    size = max(1, window // page) * page

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, length, k in zip(*(batch[c].to_pylist() for c in ("source", "length", "k"))):
                base = k * size
                data = P.opened(source)(base, size + over_read)
                places = range(0, min(size, length - base), page)
                texts = [data[a : a + page + over_read].decode("latin-1") for a in places]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(texts), pa.string()), pa.array([base + a for a in places], pa.int64()), pa.array(texts, pa.string())], ["source", "vpage", "text"])

    return P.dealt(sizes(spark, path, pattern, recursive), size).mapInArrow(read, "source string, vpage long, text string")
