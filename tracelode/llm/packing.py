"""Packing of token ids into windows of at most WINDOW tokens, by non-negative least squares.

A document's ids are those of a public byte-level BPE, then id 1. Full windows are cut off first; what remains has a length below
WINDOW.
1. Every text is tokenized once, into a table in the shared folder, with its rank among the remains of its length in its partition.
2. The histogram of the remaining lengths of the whole table, WINDOW numbers, goes to the driver. All combinations of two or three
   lengths that fill a window exactly are enumerated, repeat counts x >= 0 that minimise |A x - histogram| are solved by coordinate
   descent (always the coordinate that lowers the error most, so that few are above zero), and rounded to the nearest.
3. Where windows of a combination begin among the remains of each length is broadcast (it depends on WINDOW, not on the table). With
   the number of remains of this length in the partitions before, each document finds its window and its place by itself.
4. The residual documents, those beyond the rounded counts, are packed greedily in blocks: the largest, then the largest that fits,
   and where none fits, one is cut to fill the window. The tokens of a block's last window go into windows whose lengths are powers
   of two, which need no padding. So no window is padded.
5. The pieces of each document are joined to its ids.
What is shuffled are numbers, and once the ids. sequence_id is unique.

Cases: null text is empty, so its only id is 1; repeated rows are packed each; an empty table gives no rows; other columns are
ignored. The tokenizer's own special string is the token that it stands for, as in the tokenizers library.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm import common as C

WINDOW, END, BLOCK_TOKENS = 2048, 1, 1 << 22
#: The least squares end when no count would change by one half, or by this part of the documents if that is more.
TOLERANCE = 2.0**-20
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
_LOADED: dict[str, tuple] = {}


def tokenizer(name: str = VOCABULARY):
    """text -> ids. The vocabulary's rank file gives the same ids as the tokenizers library, several times faster; texts with
    the special string go to that library."""
    if name not in _LOADED:
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        _LOADED[name] = fast.encode_ordinary, whole, "<u2" if max(whole.get_vocab_size(), *ranks.values()) < 1 << 16 else "<u4"
    fast, whole, _ = _LOADED[name]
    return lambda text: whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast(text)


def id_type(name: str = VOCABULARY) -> str:
    """Two bytes where the vocabulary allows it, else four."""
    tokenizer(name)
    return _LOADED[name][2]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of lengths that sum to the window; a is 0 in pairs."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    low = np.concatenate([[0], lengths])
    a, b = (x.ravel() for x in np.meshgrid(low, lengths, indexing="ij"))
    c = window - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """x >= 0 of least |A x - histogram|, by exact steps along single coordinates, each the one that lowers the error most."""
    least = max(0.5, tolerance * float(histogram.sum()))
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    left = histogram.astype(np.float64)
    left[0] = 0
    # per length: the combinations that have it, and how often
    flat, of = combos.ravel(), np.repeat(np.arange(len(combos)), combos.shape[1])
    keys, times = np.unique(flat * np.int64(len(combos)) + of, return_counts=True)
    length, of = keys // len(combos), keys % len(combos)
    cuts = np.searchsorted(length, np.arange(len(left) + 1))
    squares = np.bincount(of[length > 0], (times * times)[length > 0], len(combos))
    root = np.sqrt(squares)
    slope = left[combos].sum(1) / root  # the gain of a step is its square
    held = np.zeros(0, np.int64)
    while True:
        k = int(slope.argmax())
        step = most = max(0.0, slope[k] / root[k])
        if len(held):
            back = np.minimum(-slope[held] / root[held], x[held])
            most = max(most, float(back.max()))
            gain = -2 * back * slope[held] * root[held] - back * back * squares[held]
            i = int(gain.argmax())
            if gain[i] > max(0.0, slope[k]) ** 2:
                k, step = int(held[i]), -back[i]
        if most < least:
            break
        if x[k] == 0:
            held = np.append(held, k)
        x[k] += step
        for n in set(combos[k].tolist()) - {0}:
            a, b = cuts[n], cuts[n + 1]
            m = int((combos[k] == n).sum())
            left[n] -= step * m
            slope[of[a:b]] -= step * m * times[a:b] / root[of[a:b]]
    return x


class Plan:
    """Rounded repeat counts, and for each length where the windows of each combination begin among its documents."""

    def __init__(self, histogram: np.ndarray, window: int) -> None:
        combos = combinations(np.flatnonzero(histogram), window)
        x = repeat_counts(combos, histogram)
        order = np.argsort(-x, kind="stable")
        order = order[x[order] >= 0.5]
        left, rows, counts = histogram.copy(), [], []
        for k, n in zip(order.tolist(), np.floor(x[order] + 0.5).astype(np.int64).tolist()):
            parts = [p for p in combos[k].tolist() if p]
            n = min(n, *(int(left[p]) // parts.count(p) for p in parts))
            if n:
                rows.append(parts)
                counts.append(n)
                for p in parts:
                    left[p] -= n
        self.windows = sum(counts)  # sequence ids below this are planned ones
        self.planned = histogram - left
        # by length: first rank, first sequence, offset and number of its places in each combination
        table: dict[int, list[tuple[int, int, int, int]]] = {}
        used, first = np.zeros(window, np.int64), 0
        for parts, n in zip(rows, counts):
            at = 0
            for p in dict.fromkeys(parts):
                m = parts.count(p)
                table.setdefault(p, []).append((int(used[p]), first, at, m))
                used[p] += n * m
                at += m * p
            first += n
        self.table = {p: np.array(v, np.int64).T for p, v in table.items()}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the documents with these ranks among those of one length; all of them planned."""
        begin, first, at, m = self.table[length]
        k = np.searchsorted(begin, rank, "right") - 1
        within = rank - begin[k]
        return first[k] + within // m[k], at[k] + within % m[k] * length


def greedy(rest: list[tuple[int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) of the remains (length, document), cut where that fills a window."""
    out, rest = [], sorted((n, i, 0) for n, i in rest)
    while rest:
        n, i, s = rest.pop()
        row, gap = [(i, s, n)], window - n
        while gap and rest:
            k = bisect_right(rest, (gap, float("inf"), 0)) - 1
            if k < 0:  # none fits: the smallest is cut
                n, i, s = rest.pop(bisect_left(rest, (gap, -1, 0)))
                insort(rest, (n - gap, i, s + gap))
                n = gap
            else:
                n, i, s = rest.pop(k)
            row.append((i, s, n))
            gap -= n
        out.extend([row] if not gap else by_powers(row, window))
    return out


def by_powers(row: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A window that isn't full, as windows whose lengths are powers of two."""
    total, out, k = sum(n for _, _, n in row), [], 0
    row = list(row)
    for size in (1 << p for p in range(window.bit_length(), -1, -1)):
        if total & size:
            now, need = [], size
            while need:
                i, s, n = row[k]
                take = min(n, need)
                now.append((i, s, take))
                row[k] = (i, s + take, n - take)
                k += take == n
                need -= take
            out.append(now)
    return out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECES = "part int, row long, start int, length int, sequence_id long, offset int"


def tokenized(docs: DataFrame, window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """part, row (together a key), doc_id, ids (as id_type), n (how many), rest (the length that full windows leave), rank (how many
    documents of the partition had the same rest before) and windows (how many full windows they had)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = tokenizer(name), id_type(name)
        part, row, seen, full = TaskContext.get().partitionId(), 0, [0] * window, 0
        for batch in batches:
            ids, counts, rest, rank, windows = [], [], [], [], []
            for text in C.blobs(batch["text"]):
                x = np.array([*encode(text.decode()), END], kind)
                n = len(x) % window
                ids.append(x.tobytes())
                counts.append(len(x))
                rest.append(n)
                rank.append(seen[n])
                seen[n] += 1
                windows.append(full)
                full += len(x) // window
            rows = pa.array(range(row, row + len(ids)), pa.int64())
            row += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), rows, batch["doc_id"], pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(windows, pa.int64())], ["part", "row", "doc_id", "ids", "n", "rest", "rank", "windows"])

    C.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "part int, row long, doc_id long, ids binary, n long, rest int, rank long, windows long")


def _planned(ranked: DataFrame, plan) -> DataFrame:
    """ranked: part, row, rest, rank in the whole table -> PIECES of the planned documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            rest, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rest", "rank"))
            sequence, offset = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            order = np.argsort(rest, kind="stable")
            lengths, begin = np.unique(rest[order], return_index=True)
            for n, k in zip(lengths.tolist(), np.split(order, begin[1:])):
                sequence[k], offset[k] = p.place(n, rank[k])
            yield pa.RecordBatch.from_arrays([batch["part"], batch["row"], pa.array(np.zeros(len(rest), np.int32)), pa.array(rest.astype(np.int32)), pa.array(sequence), pa.array(offset.astype(np.int32))], ["part", "row", "start", "length", "sequence_id", "offset"])

    return ranked.mapInArrow(each, PIECES)


def _residual(left: DataFrame, window: int, block: int) -> DataFrame:
    """left: part, row, rest, in a fixed order within partitions -> PIECES, packed greedily block by block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, tokens = (1 << 62) + (TaskContext.get().partitionId() << 40), [], 0

        def packed() -> pa.RecordBatch:
            rows = greedy([(n, i) for i, (_, _, n) in enumerate(held)], window)
            cols: list[list] = [[] for _ in range(6)]
            for q, row in enumerate(rows):
                at = 0
                for i, start, n in row:
                    for c, v in zip(cols, (held[i][0], held[i][1], start, n, first + q, at)):
                        c.append(v)
                    at += n
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["part", "row", "start", "length", "sequence_id", "offset"]), len(rows)

        for batch in batches:
            for one in zip(*(batch[c].to_pylist() for c in ("part", "row", "rest"))):
                held.append(one)
                tokens += one[2]
                if tokens >= block:
                    out, n = packed()
                    yield out
                    first, held, tokens = first + n, [], 0
        if held:
            yield packed()[0]

    return left.mapInArrow(each, PIECES)


def assigned(tokens: DataFrame, window: int = WINDOW, block: int = BLOCK_TOKENS) -> DataFrame:
    """PIECES of what full windows leave of every document; only numbers are read and shuffled."""
    spark = tokens.sparkSession
    remains = tokens.filter("rest > 0").select("part", "row", "rest", "rank")
    counts = C.stored(remains.groupBy("part", "rest").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window, np.int64)
    for n, docs in counts.groupBy("rest").agg(F.sum("n")).collect():  # window rows at most
        histogram[n] = docs
    plan = Plan(histogram, window)
    sent = spark.sparkContext.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "rest", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = remains.join(offsets, ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    limits = spark.createDataFrame([(n, int(plan.planned[n])) for n in range(window)], "rest int, planned long")
    ranked = C.stored(ranked.join(F.broadcast(limits), "rest"), "ranks")
    left = ranked.filter("rank >= planned").select("part", "row", "rest").repartition(C.tasks(spark), "part", "row").sortWithinPartitions("part", "row")
    return _planned(ranked.filter("rank < planned"), sent).unionByName(_residual(left, window, block))


def pack(docs: DataFrame, window: int = WINDOW, name: str = VOCABULARY, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece; ids are little-endian unsigned 32-bit."""
    tokens = C.stored(tokenized(docs, window, name), "tokens")
    pieces = assigned(tokens, window, block).groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    both = tokens.select("part", "row", "doc_id", "ids", "n", "windows").join(pieces.hint("merge"), ["part", "row"], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for part, before, doc_id, ids, n, more in zip(*(batch[c].to_pylist() for c in ("part", "windows", "doc_id", "ids", "n", "pieces"))):
                ids, full = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes(), n // window
                found = [(k * window, window, (part + 1 << 40) + before + k, 0) for k in range(full)]
                found += [(full * window + x["start"], x["length"], x["sequence_id"], x["offset"]) for x in more or ()]
                for start, length, sequence, offset in found:
                    for c, v in zip(cols, (doc_id, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return both.mapInArrow(each, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
