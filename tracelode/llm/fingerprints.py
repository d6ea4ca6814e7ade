"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its lines (split at \\n; an empty line counts). Each line is hashed to a wide vector, and a
fingerprint is the sum of its lines' vectors, every lane modulo a power of two. So the order of lines doesn't matter, and a
line is inserted or deleted by adding or subtracting its vector, without the other lines.

The vector has two parts:
* EXACT lanes of 64 bits, from SHAKE-128 of the line: equality of multisets;
* SKETCH lanes of 32 bits, more than a text has shingles: each 3-word shingle of the line (its whole word sequence if it has fewer
  words) adds +1 or -1 to one lane chosen by its hash, and a shingle that repeats in its line to another lane each time. Inner
  products of sketches estimate those of the counts x and y of all shingles, so `likeness` estimates their Tanimoto coefficient
  xy / (xx + yy - xy): the shared part (Jaccard) where no line repeats. Equal fingerprints have likeness 1.

Neighbours: rows are in falling order of doc_id (a null as the smallest), then of a hash of the text, then of the text. Ranges of this
order are dealt to tasks, by cuts from a hash sample of ids and hashes; a range ends with the first row of the next one. So rows of
one doc_id are split too, but not equal rows.

Cases: null text is the empty text (one empty line). Repeated rows get equal fingerprints. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import common as C

EXACT, SKETCH, SHINGLE = 16, 512, 3
#: Sampled ids per range of the order.
PER_RANGE = 100
_PLACE, _SIGN = np.uint64(SKETCH - 1), np.uint64(40)


def _exact(line: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(line).digest(EXACT * 8), "<u8")


def _lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text without its line breaks, and where its lines begin (n + 1)."""
    data = np.frombuffer(text, np.uint8)
    cuts = np.flatnonzero(data == 10)
    return data, np.concatenate([[0], cuts + 1, [len(data) + 1]])


def _shingles(text: bytes) -> np.ndarray:
    """The hashes of all shingles of all lines; a line break is white space, so words() sees it as such."""
    data, begins = _lines(text)
    if not len(data):
        return np.zeros(0, np.uint64)
    starts, ends, _ = C.words(data, np.array([0, len(data)]))
    h = C.word_hashes(data, starts, ends)
    at = np.searchsorted(starts, np.minimum(begins, len(data)))
    at[-1] = len(starts)
    place, line = C.within(at, SHINGLE)
    parts, lines = ([C.runs(h, SHINGLE)[place]], [line]) if len(h) >= SHINGLE else ([], [])
    n = np.diff(at)
    for size in range(1, SHINGLE):
        few = np.flatnonzero(n == size)
        if len(few):
            first = at[few]
            x = h[first]
            for k in range(1, size):
                x = C.join_hashes(x, h[first + k])
            parts.append(x ^ np.uint64(size))
            lines.append(few)
    if not parts:
        return np.zeros(0, np.uint64)
    x, line = np.concatenate(parts), np.concatenate(lines)
    # how often the shingle has come in its line before
    key = C.join_hashes(x, line.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    again = np.empty(len(key), np.uint64)
    again[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    more = again > 0
    x[more] = C.join_hashes(x[more], again[more])
    return x


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The exact and the sketch lanes of a text: the sums over its lines."""
    exact = np.zeros(EXACT, np.uint64)
    for line in text.split(b"\n"):
        exact += _exact(line)
    x = _shingles(text)
    lane, up = (x & _PLACE).astype(np.int64), (x >> _SIGN & np.uint64(1)).astype(bool)
    sketch = np.bincount(lane[up], minlength=SKETCH) - np.bincount(lane[~up], minlength=SKETCH)
    return exact, sketch.astype(np.int32)


def pack(v: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<i4").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: EXACT * 8], "<u8"), np.frombuffer(raw[EXACT * 8 :], "<i4")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both texts' lines together; with sign -1, of a's lines without b's."""
    (x, p), (y, q) = unpack(a), unpack(b)
    return pack((x + y, p + q) if sign > 0 else (x - y, p - q))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The estimated Tanimoto coefficient of the counts of shingles; 1 exactly for equal fingerprints."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    p, q = a[1].astype(np.float64), b[1].astype(np.float64)
    n, m, both = float(p @ p), float(q @ q), float(p @ q)
    return min(1.0, both / (n + m - both)) if both > 0 else 0.0


# The distributed operator: neighbours by doc_id without a global order in one task


def _cuts(keys: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where all ranges but the first begin (columns down, h); the driver gets some PER_RANGE sampled keys per range."""
    share = min(1.0, PER_RANGE * ranges / max(1, keys.count()))
    some = keys.filter(F.pmod(F.xxhash64("down", "h"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("down", "h").count().toArrow()
    down, h, n = (some[c].to_numpy().astype(np.int64) for c in ("down", "h", "count"))
    order = np.lexsort((h, down))
    upto = np.cumsum(n[order])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)) if len(order) else np.zeros(0, np.int64)
    return down[order][at], h[order][at]


def range_of(down: np.ndarray, h: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cuts are at or before each key."""
    first, after = np.searchsorted(cuts[0], down, "left"), np.searchsorted(cuts[0], down, "right")
    for i in np.flatnonzero(first < after).tolist():  # the cuts of the same doc_id
        after[i] = first[i] + np.searchsorted(cuts[1][first[i] : after[i]], h[i], "right")
    return after


def _ordered(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Rows (bucket, last, down, h, doc_id, text): buckets are ranges of the order; each also has, marked as last, the first rows of
    the next one (or of the first bucket, after the last). The driver sees a row per bucket and the sampled keys."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("down", F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))))).withColumn("h", F.xxhash64("text"))
    sent = spark.sparkContext.broadcast(_cuts(docs.select("down", "h"), ranges))

    @F.pandas_udf("int")
    def bucket(down: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(down.to_numpy(), h.to_numpy(), sent.value))

    rows = docs.withColumn("bucket", bucket("down", "h"))
    firsts = sorted((r["bucket"], *r["first"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("down", "h")).alias("first")).collect())
    before = spark.createDataFrame([(down, h, firsts[i - 1][0]) for i, (_, down, h) in enumerate(firsts)], "down long, h long, before int")
    dealt = rows.join(F.broadcast(before), ["down", "h"], "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("last"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("last"))
    out = dealt.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return out.select("to.bucket", "to.last", "down", "h", "doc_id", "text"), len(sent.value[0]) + 1


def _edit(text: bytes, nxt: bytes) -> tuple[int, bytes]:
    """Code points of text, and text with its last half replaced by the start of the next one."""
    a = text.decode()
    half = len(a) // 2
    b = nxt.decode() if half >= len(nxt) else nxt[: 4 * half].decode(errors="ignore")
    return len(a), (a[: len(a) - half] + b[:half]).encode()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then in order, those marked last at the end of the bucket."""
    names = SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None  # bucket, doc_id, text, vector, fingerprint
    for batch in batches:
        out: list[tuple] = []
        for bucket, last, doc_id, text in zip(batch["bucket"].to_pylist(), batch["last"].to_pylist(), batch["doc_id"].to_pylist(), C.blobs(batch["text"])):
            if last and (held is None or held[0] != bucket):
                continue  # the bucket's last row has its next one already
            v = vector(text)
            now = (bucket, doc_id, text, v, pack(v))
            if held is not None and held[0] == bucket:
                n, edited = _edit(held[2], text)
                w = vector(edited)
                out.append((held[1], n, hashlib.sha256(edited).hexdigest(), held[4], pack(w), likeness(held[3], w), likeness(held[3], v)))
            held = None if last else now
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness. See the module for all cases."""
    C.bounded_batches(docs.sparkSession)
    rows, buckets = _ordered(docs, ranges or C.tasks(docs.sparkSession))
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("last", "down", "h", "text")
    return dealt.select("bucket", "last", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
