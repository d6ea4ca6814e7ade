"""Links between texts that share SIMILARITY of their SHINGLE-word shingles, by positional bytes with count filtering.

The signature of a text has POSITIONS bytes, each from the least of its shingles' hashes under another permutation, so two texts
share a byte with the probability of their Jaccard similarity (SimHash bytes would share one in four at 0.8, which no number of
matches guarantees). The inverted index keeps posting lists of four positional bytes each; pairs of a list are tallied over all
bytes, and those with MATCHES or more are candidates. Every link is verified exactly: the shingle sets of its texts are joined to
the pairs and compared.

Each pair is a matter of one list, that of the first four bytes that it shares. First each list gives a spanning forest of its
candidates, the largest tallies first, whose pairs are verified. Where one of them fails and candidates of the list were held
back, the list is settled in one step: its texts' shingle sets are brought to it, all its candidates are compared there, and it
gives a spanning forest of its links. So no row is made for a pair that is no link, but for that forest, and a dense group costs
rows in proportion to its texts, while each candidate is either verified or joined by verified links.
Lists are dealt into blocks of about BLOCK texts (and SET_BYTES of sets), as those of simhash.py.

Cases: equal texts are one row; a null text is one without words, as an empty one, and such texts are linked; repeated rows and ids
don't matter, since only hashes of texts are linked; an empty table has no links; only row and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import common as C

SHINGLE, SIMILARITY = 5, 0.8
POSITIONS, QUAD, BLOCK = 64, 4, 1024
#: A pair at SIMILARITY shares 51 bytes on average, less than MATCHES once in some 100,000 times.
MATCHES = 38
#: Bytes of shingle sets in a block; columns of one matrix product.
SET_BYTES, COLUMNS = 16 << 20, 4096
_RNG = np.random.default_rng(2024)
_XOR = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive texts, and where each text's begin (n + 1). Fewer words: the whole sequence; none: one
    shingle of its own."""
    data = _LOWER[data]
    starts, ends, at = C.words(data, offs)
    h = C.word_hashes(data, starts, ends)
    n = np.diff(at)
    count = np.maximum(n - size + 1, 1)
    out = np.zeros(count.sum(), np.uint64)
    begin = np.concatenate([[0], np.cumsum(count)])
    place, doc = C.within(at, size)
    if len(place):
        out[begin[doc] + place - at[doc]] = C.runs(h, size)[place]
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            x = h[at[few]]
            for j in range(1, k):
                x = C.join_hashes(x, h[at[few] + j])
            out[begin[few]] = x
    return out, begin


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row, sig, quads) of every document (columns row, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = C.flat(batch["text"])
            parts = []
            for i, j in C.groups(offs):
                h, begin = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                sig = np.empty((j - i, POSITIONS), np.uint8)
                for p in range(POSITIONS):
                    least = np.minimum.reduceat((h ^ _XOR[p]) * _MULTIPLY[p], begin[:-1])
                    sig[:, p] = (C.mix(least) & np.uint64(255)).astype(np.uint8)
                parts.append(sig)
            sig = np.concatenate(parts) if parts else np.zeros((0, POSITIONS), np.uint8)
            quads = np.ascontiguousarray(sig).view("<u4").astype(np.int64) | (np.arange(POSITIONS // QUAD) << 32)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(list(quads), pa.list_(pa.int64()))], ["row", "sig", "quads"])

    return docs.select("row", "text").mapInArrow(each, "row long, sig binary, quads array<long>")


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def forest(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Which of these pairs, in their order, make up a spanning forest."""
    root, out = list(range(n)), []
    for k, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
        u, v = _find(root, a), _find(root, b)
        if u != v:
            root[u] = v
            out.append(k)
            if len(out) == n - 1:
                break
    return np.array(out, np.int64)


def pairs_of(sigs: np.ndarray, posting: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates i, j of one list, or of two blocks of it (only those between them), the largest tallies first. Pairs that share
    an earlier four bytes are left to the list of those."""
    n, quads, own = len(sigs), np.ascontiguousarray(sigs).view("<u4"), posting >> 32
    inside = bool((block == block[0]).all())
    found = []
    for i in range(0, n, 64):
        tally = (sigs[i : i + 64, None, :] == sigs[None, :, :]).sum(2, dtype=np.uint8)
        a, b = np.nonzero(np.triu(tally >= MATCHES, i + 1))
        mine = ~(quads[a + i, :own] == quads[b, :own]).any(1) & (inside | (block[a + i] != block[b]))
        a, b = a[mine], b[mine]
        found.append(np.stack([tally[a, b].astype(np.int64), a + i, b]))
    t, p, q = np.concatenate(found, axis=1)
    order = np.lexsort((C.mix((p * n + q).astype(np.uint64)), -t))  # equal tallies in no order, so that no text gets most pairs
    return p[order], q[order]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many entries each two of these sets share, by products of their incidence matrix."""
    n = len(sets)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]  # what only one set has is shared by none
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((n, n), np.int64)
    for c in range(0, int((times > 1).sum()), COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[of[i:j], column[i:j] - c] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def enough(shared: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    """Whether sets of x and y entries that share so many are a link."""
    return shared >= similarity * (x + y - shared) - 1e-9


def links_of(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the candidates p, q. Many are counted all at once, few one by one."""
    size = np.array([len(x) for x in sets])
    many = 50 * len(p) >= len(sets) ** 2
    if many:
        ok = enough(shared_counts(sets)[p, q], size[p], size[q], similarity)
        p, q = p[ok], q[ok]
    root, out = list(range(len(sets))), []
    for a, b in zip(p.tolist(), q.tolist()):
        u, v = _find(root, a), _find(root, b)
        if u != v and (many or enough(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b]), similarity)):
            root[u] = v
            out.append((a, b))
    return out


def _lists(held: DataFrame, blocks: str, columns: list[str]) -> DataFrame:
    """held (posting, row, sig, ...) as lists of two or more, one row for each two blocks of a posting."""
    dealt = held.withColumn("blocks", F.expr(f"cast({blocks} as int)")).withColumn("b", F.expr("cast(pmod(xxhash64(row), blocks) as int)"))
    dealt = dealt.select("posting", *columns, "b", F.explode(F.expr("sequence(0, blocks - 1)")).alias("c"))
    lists = dealt.groupBy("posting", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j")).agg(F.sort_array(F.collect_list(F.struct(*columns, "b"))).alias("x"))
    return lists.filter("size(x) > 1").select("posting", *(f"x.{c}" for c in [*columns, "b"]))


def _given(sigs: DataFrame) -> DataFrame:
    """(u, v, posting) of the pairs that the lists give first; posting is null where the list holds nothing back."""
    postings = sigs.select("row", F.explode("quads").alias("posting"))
    counts = postings.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    held = postings.withColumn("key", C.own_key("posting")).join(counts.withColumn("key", C.own_key("posting")).drop("posting"), "key").select("posting", "row", "n")
    held = held.withColumn("key", C.own_key("row")).drop("row").join(sigs.select("row", "sig", C.own_key("row").alias("key")), "key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for posting, rows, sig, block in zip(*(batch[c].to_pylist() for c in ("posting", "row", "sig", "b"))):
                p, q = pairs_of(np.frombuffer(b"".join(sig), np.uint8).reshape(-1, POSITIONS), posting, np.array(block))
                given = forest(p, q, len(rows))
                a, b = np.array(rows, np.int64)[p[given]], np.array(rows, np.int64)[q[given]]
                u.append(np.minimum(a, b))
                v.append(np.maximum(a, b))
                of += [posting if len(given) < len(p) else None] * len(given)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(of, pa.int64())], ["u", "v", "posting"])

    return _lists(held, f"ceil(n / {BLOCK})", ["row", "sig"]).mapInArrow(each, "u long, v long, posting long")


def _settled(sigs: DataFrame, sets: DataFrame, again: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of a spanning forest of the links of each of these lists. sets: of all texts that have a candidate in a list of theirs."""
    postings = sigs.select("row", "sig", F.explode("quads").alias("posting")).join(again, "posting", "left_semi")
    held = postings.withColumn("key", C.own_key("row")).join(sets.select(C.own_key("row").alias("key"), F.length("set").alias("bytes")), "key").drop("key")
    counts = held.groupBy("posting").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter("n > 1")
    held = held.drop("bytes").withColumn("key", C.own_key("posting")).join(counts.withColumn("key", C.own_key("posting")).drop("posting"), "key").drop("key")
    held = held.withColumn("key", C.own_key("row")).join(sets.select(C.own_key("row").alias("key"), "set"), "key").drop("key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for posting, rows, sig, texts, block in zip(*(batch[c] for c in ("posting", "row", "sig", "set", "b"))):
                p, q = pairs_of(np.frombuffer(b"".join(sig.as_py()), np.uint8).reshape(-1, POSITIONS), posting.as_py(), np.array(block.as_py()))
                rows = rows.as_py()
                used = np.unique(np.concatenate([p, q]))  # only texts that have candidates
                sets_of = [np.frombuffer(texts[k].as_py(), np.uint64) for k in used.tolist()]
                for a, b in links_of(sets_of, np.searchsorted(used, p), np.searchsorted(used, q), similarity) if len(used) else []:
                    a, b = rows[used[a]], rows[used[b]]
                    u.append(min(a, b))
                    v.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _lists(held, f"ceil(greatest(n / {BLOCK}, bytes / {SET_BYTES}))", ["row", "sig", "set"]).mapInArrow(each, "u long, v long")


def _sets(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(row, set): the whole set of shingles of the text of each of these rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in C.blobs(batch["text"]):
                x = np.frombuffer(t, np.uint8)
                out.append(np.unique(shingles(x, np.array([0, len(x)]), size)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.binary())], ["row", "set"])

    # by a key of its own, so that the texts of a row with very many copies can be split, and are grouped only after that
    wanted = docs.select("row", "text", C.own_key("row").alias("key")).join(rows.select(C.own_key("row").alias("key")), "key", "left_semi")
    return C.stored(wanted.select("row", "text").mapInArrow(each, "row long, set binary").groupBy("row").agg(F.first("set").alias("set")), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(u, v, ok) of pairs of rows, by their texts' whole sets of shingles."""
    both = pairs.join(sets.withColumnsRenamed({"row": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"row": "v", "set": "b"}), "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                ok.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    return C.stored(both.select("u", "v", "a", "b").mapInArrow(compared, "u long, v long, ok boolean"), "checked")


def links(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) of rows: enough links to connect all texts that are linked. docs: row (a hash of the text) and text."""
    sigs = C.stored(signatures(docs, size).groupBy("row").agg(F.first("sig").alias("sig"), F.first("quads").alias("quads")), "signatures")
    given = C.stored(_given(sigs), "given")
    C.tidy(docs.sparkSession)
    sets = _sets(docs, given.select(F.explode(F.array("u", "v")).alias("row")).distinct(), size)
    checked = _verified(sets, given.select("u", "v"), similarity)
    linked = checked.filter("ok").select("u", "v")
    # whatever a forest holds back is joined by it, unless a pair of it has failed
    again = C.stored(given.filter("posting is not null").join(checked.filter("not ok"), ["u", "v"], "left_semi").select("posting").distinct(), "again")
    C.tidy(docs.sparkSession)
    linked = linked.unionByName(C.stored(_settled(sigs, sets, again, similarity), "settled"))
    C.drop_stored(sets)
    return linked
