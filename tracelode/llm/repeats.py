"""Substring dedup: words covered by a passage that also starts in a document with a smaller doc_id are removed.

A word is a run of [^\\x20\\x09-\\x0D]; a window is WINDOW consecutive words of one document. Windows are judged on the input.

1. Count-min prefilter. Each window is counted under its anchor, the least hash among its GRAM-word runs: equal windows have
   equal anchors, so an anchor's count is at least that of each of its windows, and one anchor serves some thirteen windows.
   Whole texts are counted in the same sketch, by their hash.
   Partitions make sketches of two rows of cells (per document each anchor counts once; counts stop at 2), in shards of SHARD
   cells; both cells of an anchor are in one shard. They grow with the corpus and are merged shard by shard on the executors.
   What is asked of them is one bit per cell, "2 or more". Up to SENT cells the bits are broadcast; beyond that anchors go to
   the shards: distinct ones are looked up there, and those estimated as repeated are joined to the documents that have them.
   A sketch overestimates only, so no repeated window is lost.
2. Second pass. Only windows whose anchor is estimated as repeated leave the scan, as 128-bit hashes, and are grouped exactly:
   the least doc_id of each window is aggregated map-side first, and joined back by a join that Spark can split when skewed.
   (Words are hashed twice by functions without structure, see common.word_hashes.)
   Texts estimated as repeated are grouped exactly first: of equal texts only that with the least doc_id has its windows taken,
   and the others lose all words, since each of their windows is in it too.
3. The places found are gathered per document and joined to its text; one text with all its places is the largest unit.

Cases: null text has no words; fewer than WINDOW words: nothing is removed; rows with the same doc_id don't remove each other's
words; a null doc_id counts as larger than all others; an empty table gives no rows. Only the columns named in `keep` are
carried, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import common as C

WINDOW, GRAM = 50, 25
#: Cells of the sketch: CELLS_PER_BYTE times the corpus, whole shards; so many are broadcast at most, as bits.
CELLS_PER_BYTE, SENT = 0.15, 1 << 29
SHARD = 1 << 20
#: Anchors that one task holds before it hands on a partial sketch.
HELD = 1 << 21
_SECOND = 0x2545F4914F6CDD1D


def _last_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _anchors(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Words, and for each window of each text: its first word, its text, its anchor."""
    starts, ends, at = C.words(data, offs)
    h = C.word_hashes(data, starts, ends)
    place, doc = C.within(at, window)
    a = C.sliding_min(C.runs(h, gram), window - gram + 1)[place]
    return starts, ends, at, h, place, doc, C.mix(a)


def _cells(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard of each anchor, and its cell in either row of the shard."""
    half = np.uint64(SHARD // 2 - 1)
    return (C.mix(anchor ^ np.uint64(0x2127599BF4325C37)) % np.uint64(shards)).astype(np.int64), (anchor & half).astype(np.int64), (anchor >> np.uint64(32) & half).astype(np.int64) + SHARD // 2


def _text_anchor(row: np.ndarray) -> np.ndarray:
    """What a whole text is counted under, from its hash."""
    return C.mix(row.view(np.uint64) ^ np.uint64(0x6A09E667F3BCC908))


def _twice(bits: np.ndarray, anchor: np.ndarray, shards: int) -> np.ndarray:
    """bits: of all shards, or with shards 1 of the anchors' own one."""
    shard, *both = _cells(anchor, shards)
    out = np.ones(len(anchor), bool)
    for cell in both:
        cell = cell + shard * SHARD
        out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _partial(anchors: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """Cells with a count of 1, and of 2 or more, by shard; stored as 1-bit counts and places within the shard."""
    shard, *rows = _cells(np.concatenate(anchors) if anchors else np.zeros(0, np.uint64), shards)
    cell, n = np.unique(np.concatenate([shard * SHARD + c for c in rows]), return_counts=True)
    x = ((cell % SHARD) << 1 | (n > 1)).astype("<u4")
    shard, begin = np.unique(cell // SHARD, return_index=True)
    cuts = [*begin.tolist(), len(x)]
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["shard", "cells"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard: one row per shard, the bits of the cells counted twice or more."""

    def done(shard: int, seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

    now, seen = None, np.zeros(0, np.uint8)
    for batch in batches:
        for shard, cells in zip(batch["shard"].to_pylist(), batch["cells"].to_pylist()):
            if shard != now:
                if now is not None:
                    yield done(now, seen)
                now, seen = shard, np.zeros(SHARD, np.uint8)
            x = np.frombuffer(cells, "<u4")
            seen[x >> 1] = np.minimum(seen[x >> 1] + 1 + (x & 1), 2)
    if now is not None:
        yield done(now, seen)


def _anchors_of(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row in the batch, and the anchor, of each distinct anchor of each text, that of the whole text with them."""
    data, offs = C.flat(batch["text"])
    yield np.arange(batch.num_rows), _text_anchor(batch["row"].to_numpy(zero_copy_only=False))
    for i, j in C.groups(offs):
        *_, doc, anchor = _anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, gram)
        once = np.ones(len(anchor), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        anchor, doc = anchor[once], doc[once]
        _, first = np.unique(C.join_hashes(anchor, doc.astype(np.uint64)), return_index=True)
        yield doc[first] + i, anchor[first]


def sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[int, DataFrame]:
    """The merged sketch: the number of shards, and (shard, bits: 2 or more documents)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size * CELLS_PER_BYTE) // SHARD

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, anchor in _anchors_of(batch, window, gram):
                held.append(anchor)
                n += len(anchor)
            if n >= HELD:
                yield _partial(held, shards)
                held, n = [], 0
        yield _partial(held, shards)

    found = docs.select("row", "text").mapInArrow(parts, "shard int, cells binary").repartition(min(shards, C.tasks(docs.sparkSession)), "shard").sortWithinPartitions("shard")
    return shards, found.mapInArrow(_merged, "shard int, bits binary")


class Sent:
    """The bits of all shards, broadcast."""

    def __init__(self, spark: SparkSession, shards: int, merged: DataFrame) -> None:
        bits = np.zeros(shards * SHARD // 8, np.uint8)
        for shard, b in merged.collect():  # at most SENT bits
            bits[shard * (SHARD // 8) : (shard + 1) * (SHARD // 8)] = np.frombuffer(b, np.uint8)
        self.shards, self.bits = shards, spark.sparkContext.broadcast(bits)

    def __call__(self, batch: pa.RecordBatch, i: int, j: int, anchor: np.ndarray) -> np.ndarray:
        return _twice(self.bits.value, anchor, self.shards)


class Joined:
    """The anchors estimated as repeated, in the column hot of the documents that have them."""

    def __call__(self, batch: pa.RecordBatch, i: int, j: int, anchor: np.ndarray) -> np.ndarray:
        return np.isin(anchor, batch["hot"].slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def with_hot(docs: DataFrame, shards: int, merged: DataFrame, window: int, gram: int) -> DataFrame:
    """docs with the column hot: those of their anchors that the sketch estimates as repeated. Nothing is broadcast."""
    spark = docs.sparkSession

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["doc_id"], batch["row"]
            for at, anchor in _anchors_of(batch, window, gram):
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([ids.take(at), rows.take(at), pa.array(anchor.view(np.int64)), pa.array(_cells(anchor, shards)[0].astype(np.int32))], ["doc_id", "row", "anchor", "shard"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, the bits of a shard before the anchors."""
        now, bits = None, None
        for batch in batches:
            shard, anchor, sent = batch["shard"].to_numpy(), batch["anchor"].fill_null(0).to_numpy(), batch["bits"]
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a < b and sent[a].is_valid:
                    now, bits, a = shard[a], np.frombuffer(sent[a].as_py(), np.uint8), a + 1
                if a < b and shard[a] == now:
                    x = anchor[a:b].view(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[_twice(bits, x, 1)].view(np.int64))], ["anchor"])

    each = C.stored(docs.select("doc_id", "row", "text").mapInArrow(asked, "doc_id long, row long, anchor long, shard int"), "anchors")
    both = each.select("shard", "anchor").distinct().withColumn("bits", F.lit(None).cast("binary")).unionByName(merged.withColumn("anchor", F.lit(None).cast("long")))
    hot = both.repartition(C.tasks(spark), "shard").sortWithinPartitions("shard", F.col("anchor").asc_nulls_first()).mapInArrow(answered, "anchor long")
    held = each.withColumn("key", C.own_key("anchor")).join(hot.select(C.own_key("anchor").alias("key")).hint("merge"), "key")
    lists = held.groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("hot"))
    joined = docs.withColumn("key", C.own_key("row")).join(lists.withColumn("key", C.own_key("row")).drop("row").hint("merge"), ["key", "doc_id"], "left").drop("key")
    return C.stored(joined, "hot")


def candidates(docs: DataFrame, twice, window: int = WINDOW, gram: int = GRAM, copies: bool = False) -> DataFrame:
    """(h1, h2, doc_id, row, place) of each window estimated as repeated; of texts that are estimated as repeated themselves only
    with `copies`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not copies:
                batch = batch.filter(pa.array(~twice(batch, 0, batch.num_rows, _text_anchor(batch["row"].to_numpy(zero_copy_only=False)))))
            data, offs = C.flat(batch["text"])
            ids, rows = batch["doc_id"].to_numpy(zero_copy_only=False), batch["row"].to_numpy(zero_copy_only=False)
            for i, j in C.groups(offs):
                body = data[offs[i] : offs[j]]
                starts, ends, at, h, place, doc, anchor = _anchors(body, offs[i : j + 1] - offs[i], window, gram)
                again = twice(batch, i, j, anchor)
                if again.any():
                    place, doc = place[again], doc[again]
                    other = C.word_hashes(body, starts, ends, _SECOND)
                    h1, h2 = (C.runs(x, window)[place].view(np.int64) for x in (h, other))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids[i:j][doc], rows[i:j][doc], (place - at[doc]).astype(np.int32))], ["h1", "h2", "doc_id", "row", "place"])

    return docs.mapInArrow(found, "h1 long, h2 long, doc_id long, row long, place int")


def maybe_copies(docs: DataFrame, twice) -> DataFrame:
    """Those of docs whose whole text is estimated as repeated."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(twice(batch, 0, batch.num_rows, _text_anchor(batch["row"].to_numpy(zero_copy_only=False)))))

    return docs.mapInArrow(found, docs.schema)


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, twice=None) -> DataFrame:
    """(doc_id, row, copy, places) of the windows that also start in a document with a smaller doc_id; row is a hash of the
    text. copy: the whole text is that of a smaller doc_id; places are those of the other documents. twice: an estimate of one's own
    instead of the sketch."""
    C.bounded_batches(docs.sparkSession)
    docs = docs.filter("text <> ''").select(_last_id().alias("doc_id"), F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("row2"), "text")
    shards, merged = (0, None) if twice else sketch(docs, window, gram)
    if twice:
        pass
    elif shards * SHARD <= SENT:
        twice = Sent(docs.sparkSession, shards, merged)
    else:
        docs, twice = with_hot(docs, shards, merged, window, gram), Joined()
    copies = maybe_copies(docs, twice)
    carried = [F.min_by(c, "doc_id").alias(c) for c in ("text", "hot") if c in docs.columns]  # equal texts have equal anchors
    leaders = copies.groupBy("row", "row2").agg(F.min("doc_id").alias("least"), *carried)
    wins = candidates(docs, twice, window, gram).unionByName(candidates(leaders.withColumnRenamed("least", "doc_id"), twice, window, gram, copies=True))
    least = wins.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    hit = wins.withColumn("key", C.own_key("h1")).join(least.withColumn("key", C.own_key("h1")).drop("h1").hint("merge"), ["key", "h2"]).filter("doc_id > least")
    places = hit.groupBy("doc_id", "row").agg(F.collect_list("place").alias("places")).withColumn("copy", F.lit(False))
    first = leaders.select(C.own_key("row").alias("key"), "row2", "least")
    later = copies.drop("text", "hot").withColumn("key", C.own_key("row")).join(first.hint("merge"), ["key", "row2"]).filter("doc_id > least")
    return places.unionByName(later.select("doc_id", "row").distinct().withColumn("copy", F.lit(True)), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, the columns of `keep`, n_words, n_removed, and kept: the words left, joined by one space (the empty string if
    none are left)."""
    carried = [c for c in dict.fromkeys(("doc_id", "text", *keep))]
    base = docs.select(*carried, _last_id().alias("_id"), F.xxhash64("text").alias("_row"))
    places = repeated(docs, window, gram).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "copy", "places")
    both = base.join(places.hint("merge"), ["_id", "_row"], "left").select(*(base[c] for c in carried), F.coalesce(places["copy"], F.lit(False)).alias("_copy"), places["places"].alias("_places"))
    out = T.StructType([both.schema[c] for c in carried] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, copy, places in zip(C.blobs(batch["text"]), batch["_copy"].to_pylist(), batch["_places"]):
                w = text.split()
                n.append(len(w))
                if copy and len(w) >= window:
                    gone.append(len(w))
                    kept.append(b"")
                    continue
                p = np.asarray(places.values) if places.is_valid else ()
                if len(p):
                    depth = np.zeros(len(w) + 1, np.int64)
                    np.add.at(depth, p, 1)
                    np.add.at(depth, p + window, -1)
                    left = np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()
                    gone.append(len(w) - len(left))
                    w = [w[i] for i in left]
                else:
                    gone.append(0)
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*carried, "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB; every window's words are joined and grouped as they are.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
 least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN least USING (h) WHERE m < doc_id),
 words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
