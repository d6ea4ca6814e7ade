"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits, by a byte-position inverted
index with count filtering.

Fingerprints at 3 bits or fewer share at least 5 of their 8 positional bytes. A posting list of one positional byte would hold
1/256 of all rows, so the index keeps posting lists of four positional bytes: the 14 blocks of the Steiner system S(3,4,8), of
which every five positions contain one, so that each pair that can reach the minimum meets, and no pair that shares exactly five
bytes meets twice. For pairs of a list the shared positional bytes are tallied; pairs that reach the guaranteed minimum are
verified by their differing bits.

Equal fingerprints are one node from the start. Lists of one fingerprint end in the first, pre-aggregated count. A list of more
than BLOCK is first dealt by a fifth byte at each of the other four positions, of which linked pairs share one; what is longer still
is dealt into blocks of about BLOCK fingerprints and compared block by block, each in a task of its own, and each gives only a spanning
forest of its links. Components are found on the executors (components.py).

Cases: null text and texts without words have fingerprint zero; repeated rows are one node; component_id is the smallest doc_id
that is not null, null if there is none; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm import common as C
from tracelode.llm import similar
from tracelode.llm.components import components

SHINGLE, SEED, BITS, BLOCK = 3, 42, 3, 1024
#: Bytes that two fingerprints at BITS differing bits share at least.
SHARED = 8 - BITS


def steiner() -> list[tuple[int, ...]]:
    """The 14 blocks: both halves, and each pair of a perfect matching of one half with each pair of the like one of the other."""
    half = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *(a + (b[0] + 4, b[1] + 4) for m in half for a in m for b in m)]


POSTINGS = steiner()
assert all(any(set(b) <= set(five) for b in POSTINGS) for five in combinations(range(8), SHARED))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)])
    x = xxhash.xxh64_intdigest
    h = np.array([x(joined[a:b], SEED) for a, b in zip(at[: len(w) - size + 1].tolist(), (at[size:] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): a hash of the text, and the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in C.blobs(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(fp)], ["doc_id", "row", "fp"])

    C.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").mapInArrow(each, "doc_id long, row long, fp long")


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect what is connected among these fingerprints: tally of shared bytes, then verification."""
    x = fps.view(np.uint64)
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(0, len(x), 256):
        apart = x[i : i + 256, None] ^ x[None, :]
        shared = sum(((apart >> np.uint64(8 * k)) & np.uint64(255)) == 0 for k in range(8))
        a, b = np.nonzero(np.triu(shared >= 8 - bits, i + 1))
        close = np.bitwise_count(apart[a, b]) <= bits
        for p, q in zip((a[close] + i).tolist(), b[close].tolist()):
            u, v = find(p), find(q)
            if u != v:
                root[u] = v
                out.append((p, q))
    return out


def _held(postings: DataFrame) -> DataFrame:
    """postings (posting, fp) of lists with two or more, with their sizes n."""
    counts = postings.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    return postings.withColumn("key", C.own_key("posting")).join(counts.withColumn("key", C.own_key("posting")).drop("posting"), "key").drop("key")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), enough of them to connect all that are linked."""
    byte = lambda p: f"(shiftrightunsigned(fp, {56 - 8 * p}) & 255)"
    keys = ", ".join(f"{n}L << 32 | {' | '.join(f'{byte(p)} << {24 - 8 * i}' for i, p in enumerate(block))}" for n, block in enumerate(POSTINGS))
    held = _held(fps.select("fp", F.explode(F.expr(f"array({keys})")).alias("posting")))
    # a long list is dealt by a fifth byte: pairs at the minimum share one of the other four too
    others = " ".join(f"WHEN {n} THEN array({', '.join(f'xxhash64(posting, {p}, {byte(p)})' for p in range(8) if p not in block)})" for n, block in enumerate(POSTINGS))
    finer = held.filter(F.col("n") > BLOCK).select("fp", F.explode(F.expr(f"CASE shiftrightunsigned(posting, 32) {others} END")).alias("posting"))
    held = held.filter(F.col("n") <= BLOCK).unionByName(_held(finer))
    dealt = held.withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("b", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    dealt = dealt.select("posting", "fp", "b", F.explode(F.expr("sequence(0, blocks - 1)")).alias("c"))
    lists = dealt.groupBy("posting", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j")).agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("fps")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for one in batch["fps"]:
                x = np.asarray(one.values)
                for a, b in forest(x, bits):
                    u.append(int(x[a]))
                    v.append(int(x[b]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return lists.mapInArrow(each, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, similar_too: bool = False) -> DataFrame:
    """(doc_id, row, fp, root, component_id) of every document; root is the same in a whole component and differs between any two.
    similar_too: also links texts that share 0.8 of their 5-word shingles, of which most differ in more bits (similar.py)."""
    fps = C.stored(fingerprints(docs, size), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(classes.select("fp"), bits)
    if similar_too:
        of = fps.select("row", "fp").distinct()
        more = similar.links(docs.select(F.xxhash64("text").alias("row"), "text"))
        more = more.join(of.withColumnsRenamed({"row": "u", "fp": "a"}), "u").join(of.withColumnsRenamed({"row": "v", "fp": "b"}), "v")
        edges = edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(edges)
    with_root = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    members = with_root.select("fp", "root", C.own_key("root").alias("key")).join(ids.select(C.own_key("root").alias("key"), "component_id"), "key").select(C.own_key("fp").alias("key"), "root", "component_id")
    return fps.withColumn("key", C.own_key("fp")).join(members, "key").select("doc_id", "row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, similar_too: bool = False) -> DataFrame:
    """docs, with one document of each component left: that of the smallest doc_id (of several texts with this id: the one with the
    least hash; of equal rows: one)."""
    near = near_duplicates(docs, size, bits, similar_too)
    stay = near.filter("doc_id <=> component_id").groupBy("root").agg(F.first("doc_id").alias("_id"), F.min("row").alias("_row")).select("_id", "_row")
    stay = C.stored(stay, "stay")  # in a query of its own, since the driver's memory goes by the size of a plan
    C.tidy(docs.sparkSession)
    names = docs.columns
    kept = docs.withColumn("_own", F.xxhash64("text")).alias("d").join(stay.alias("s"), F.expr("d._own = s._row and cast(d.doc_id as long) <=> s._id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("_own", "doc_id").orderBy(F.lit(1)))
    return kept.withColumn("_n", first).filter("_n = 1").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
