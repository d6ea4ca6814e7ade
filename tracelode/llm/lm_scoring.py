"""LM scoring by masked pseudo-likelihood: each word is masked and predicted from SIDE words on either side by a window network
trained in numpy; a document's score is the sum of the conditional log-probabilities of all its words.

1. Counts. All words of all documents are counted, per task first, then by a shuffle of the distinct words, into a table in the
   shared folder. The most frequent, down to a count that at most WORDS words reach, are listed: they go to the driver.
2. Network. Each of the 2 * SIDE places around a word has a table of vectors (FREQUENT words, BUCKETS for all others, and the edge
   of the text); their sum gives a hidden layer, and this a softmax in two levels: OWN words, GROUPS groups of SIZE listed words
   with like endings, and all words that aren't listed; then the words of the group. So p(word | both sides) of each listed word is
   the network's own; that of another word is p(not listed | both sides) times its part of their counts in the whole corpus.
3. Training. Documents are dealt to parts of about PART_BYTES by a hash of id and text, so parts depend on the corpus only, not on
   partitions. Each part trains a copy of the network at every place of all its documents, in the order of the hash, by Adagrad; the
   copies are averaged block by block on the executors, in the order of parts, weighed by their places.
4. Scoring reads the whole of every text. Words that aren't listed are joined to the table of counts.
What is counted and trained on grows with the corpus; what the driver gets doesn't.

Cases: null texts and texts without words have 0 tokens, log_prob 0 and mean_log_prob null; rare_log_prob is null without words that
aren't listed; repeated rows get equal scores; an empty table gives no rows; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import common as C

SIDE, HIDDEN, FREQUENT, BUCKETS = 2, 16, 4096, 512
OWN, GROUPS, SIZE = 16, 64, 128
WORDS, FIRST, ROWS = OWN + GROUPS * SIZE, OWN + GROUPS + 1, FREQUENT + BUCKETS + 1
BATCH, RATE, BLOCKS, PART_BYTES = 8192, 0.3, 64, 1 << 25
#: Words that one task counts before it hands them on.
HELD = 1 << 22


def _ending(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of words, the last one first."""
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return data[ends - 1].astype(np.int64) * 256 + before


def _chunks(batch: pa.RecordBatch, endings: bool = False) -> Iterator[tuple]:
    """Rows i to j of a batch as hashes (and endings) of their words, and where each text's words begin."""
    data, offs = C.flat(batch["text"])
    for i, j in C.groups(offs):
        body = data[offs[i] : offs[j]]
        starts, ends, at = C.words(body, offs[i : j + 1] - offs[i])
        yield C.word_hashes(body, starts, ends), _ending(body, starts, ends) if endings else None, at


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, n) of every distinct word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list) -> pa.RecordBatch:
            h, e = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(e[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "ending", "n"])

        held, size = [], 0
        for batch in batches:
            for h, e, _ in _chunks(batch, True):
                held.append((h, e))
                size += len(h)
            if size >= HELD:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(each, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Vocabulary:
    """The listed words by hash: rank, place in the first softmax, and in the second (-1: none)."""

    def __init__(self, top: list[tuple[int, int, int]], rare: int) -> None:
        """top: (h, ending, n) by falling n; rare: how many words of the corpus aren't listed, counted with repeats."""
        h = np.array([x[0] for x in top], np.int64).view(np.uint64)
        ending = np.array([x[1] for x in top], np.int64)
        rank = np.arange(len(top))
        first, second = rank.copy(), np.full(len(top), -1)
        place = np.argsort(ending[OWN:], kind="stable")  # groups have like endings
        first[OWN + place] = OWN + np.arange(len(place)) // SIZE
        second[OWN + place] = np.arange(len(place)) % SIZE
        self.sizes = np.bincount(first[OWN:] - OWN, minlength=GROUPS)
        order = np.argsort(h)
        self.h, self.rank, self.first, self.second = h[order], rank[order], first[order], second[order]
        self.rare = rare

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places in this vocabulary, -1 for words not listed."""
        if not len(self.h):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[k] == h, k, -1)

    def inputs(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rows of the vector tables."""
        rank = np.where(k >= 0, self.rank[k] if len(self.rank) else 0, FREQUENT)
        return np.where(rank < FREQUENT, rank, FREQUENT + (h >> np.uint64(20)).astype(np.int64) % BUCKETS).astype(np.int16)

    def targets(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the first and in the second softmax."""
        if not len(self.h):
            return np.full(len(k), FIRST - 1, np.int16), np.full(len(k), -1, np.int16)
        return np.where(k >= 0, self.first[k], FIRST - 1).astype(np.int16), np.where(k >= 0, self.second[k], -1).astype(np.int16)


def _groups(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group among these targets, and which of them are in it."""
    some = np.flatnonzero(second >= 0)
    some = some[np.argsort(first[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(first[some], prepend=-1)).tolist() + [len(some)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(first[some[a]]) - OWN, some[a:b]


class Network:
    def __init__(self, sizes: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.tables = normal(2 * SIDE, ROWS, HIDDEN)
        self.out, self.bias = normal(HIDDEN, FIRST), np.zeros(FIRST, np.float32)
        self.inner, self.inner_bias = normal(GROUPS, HIDDEN, SIZE), np.zeros((GROUPS, SIZE), np.float32)
        self.inner_bias[np.arange(SIZE) >= sizes[:, None]] = -1e9  # no word there

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.out, self.bias, self.inner, self.inner_bias]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        x = self.tables[0][around[0]]
        for t, a in zip(self.tables[1:], around[1:]):
            x += t[a]
        return np.tanh(x, out=x)

    @staticmethod
    def _softmax(x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits and its sums; less the rows' maxima only where exp would overflow or vanish."""
        z = x @ w
        z += bias
        if z.max(initial=0) < 60:
            total = np.exp(z, out=z).sum(1, keepdims=True)
            if total.min(initial=1) > 1e-20:
                return z, total
            z = x @ w + bias
        z -= z.max(1, keepdims=True)
        return np.exp(z, out=z), z.sum(1, keepdims=True)

    def log_probability(self, around: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty(len(first))
        for i in range(0, len(first), 8192):
            y, s = first[i : i + 8192], second[i : i + 8192]
            x = self.hidden(around[:, i : i + 8192])
            z, total = self._softmax(x, self.out, self.bias)
            p = z[np.arange(len(y)), y] / total[:, 0]
            for g, some in _groups(y, s):
                z, total = self._softmax(x[some], self.inner[g], self.inner_bias[g])
                p[some] *= z[np.arange(len(some)), s[some]] / total[:, 0]
            out[i : i + 8192] = np.log(np.maximum(p, 1e-30))
        return out

    def train(self, around: np.ndarray, first: np.ndarray, second: np.ndarray, sums: list[np.ndarray]) -> None:
        """One Adagrad step; around: places x windows."""
        scale = np.float32(len(first) ** -0.5)

        def step(w: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
            s += g * g
            w -= RATE * g / np.sqrt(s + 1e-2)

        def slope(x: np.ndarray, w: np.ndarray, bias: np.ndarray, y: np.ndarray) -> np.ndarray:
            p, total = self._softmax(x, w, bias)
            p *= scale / total
            p[np.arange(len(y)), y] -= scale
            return p

        x = self.hidden(around)
        p = slope(x, self.out, self.bias, first)
        dx = p @ self.out.T
        for g, some in _groups(first, second):
            part = x[some]
            q = slope(part, self.inner[g], self.inner_bias[g], second[some])
            dx[some] += q @ self.inner[g].T
            step(self.inner[g], part.T @ q, sums[3][g])
            step(self.inner_bias[g], q.sum(0), sums[4][g])
        step(self.out, x.T @ p, sums[1])
        step(self.bias, p.sum(0), sums[2])
        dx *= 1 - x * x
        for t, s, rows in zip(self.tables, sums[0], around):
            order = np.argsort(rows, kind="stable")
            cuts = np.flatnonzero(np.diff(rows[order], prepend=-1))
            u, g = rows[order[cuts]], np.add.reduceat(dx[order], cuts)
            s[u] += g * g
            t[u] -= RATE * g / np.sqrt(s[u] + 1e-2)


def _around(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Table rows of the words around each place, the edge where a text ends."""
    n = np.diff(at)
    lo, hi, place = np.repeat(at[:-1], n), np.repeat(at[1:], n), np.arange(len(rows))
    out = np.full((2 * SIDE, len(rows)), ROWS - 1, np.int16)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        ok = (place + d >= lo) & (place + d < hi)
        out[k, ok] = rows[place[ok] + d]
    return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    size = F.floor(F.log2("n") * 32)  # some thousand steps at most
    cut, listed = None, 0
    for step, words in sorted(counts.groupBy(size.alias("step")).count().collect(), reverse=True):
        if listed + words > WORDS:
            break
        cut, listed = step, listed + words
    rows = [tuple(r) for r in counts.filter(size >= cut).select("h", "ending", "n").collect()] if cut is not None else []
    rows.sort(key=lambda r: (-r[2], r[0]))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return Vocabulary(rows, total - sum(n for _, _, n in rows))


def _trained(docs: DataFrame, words) -> Network:
    """The network: each part's copy, averaged block by block on the executors."""
    spark = docs.sparkSession
    sizes = words.value.sizes
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size // PART_BYTES)
    cuts = np.linspace(0, sum(p.size for p in Network(sizes).parameters()), BLOCKS + 1).astype(int)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        now, net, sums, held, seen = None, None, None, [], 0

        def learn(least: int) -> None:
            """Whole batches of what is held, whatever chunks it came in; with least 1 also the rest."""
            nonlocal held
            if sum(len(y) for _, y, _ in held) < least:
                return
            around, first, second = (np.concatenate([x[i] for x in held], axis=-1) for i in range(3))
            stop = len(first) if least == 1 else len(first) // BATCH * BATCH
            for i in range(0, stop, BATCH):
                k = slice(i, min(i + BATCH, stop))
                net.train(around[:, k], first[k], second[k], sums)
            held = [(around[:, stop:], first[stop:], second[stop:])]

        def done() -> pa.RecordBatch:
            learn(1)
            flat = np.concatenate([p.ravel() for p in net.parameters()])
            return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([now] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["block", "part", "places", "body"])

        for batch in batches:
            part = batch["part"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if part[a] != now:
                    if seen:
                        yield done()
                    now, net, held, seen = int(part[a]), Network(sizes), [], 0
                    sums = [np.zeros_like(p) for p in net.parameters()]
                for h, _, at in _chunks(batch.slice(a, b - a)):
                    k = v.look_up(h)
                    held.append((_around(v.inputs(h, k), at), *v.targets(k)))
                    seen += len(h)
                    learn(8 * BATCH)
        if seen:
            yield done()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "body"])
        for batch in batches:
            for block, n, body in zip(*(batch[c].to_pylist() for c in ("block", "places", "body"))):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total, weight = block, 0.0, 0
                total, weight = total + np.frombuffer(body, np.float32).astype(np.float64) * n, weight + n
        if now is not None:
            yield done()

    order = F.xxhash64("doc_id", "text")
    dealt = docs.filter("text <> ''").select("doc_id", "text", order.alias("h"), F.pmod(order, F.lit(parts)).cast("int").alias("part"))
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h", "doc_id", "text").select("part", "text")
    blocks = dealt.mapInArrow(each, "block int, part int, places long, body binary")
    found = dict(blocks.repartition(min(BLOCKS, C.tasks(spark)), "block").sortWithinPartitions("block", "part").mapInArrow(merged, "block int, body binary").collect())  # one network
    net = Network(sizes)
    if found:
        flat, at = np.concatenate([np.frombuffer(found[k], np.float32) for k in range(BLOCKS)]), 0
        for p in net.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
    return net


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Network]:
    """The counts of all words, the listed ones, and the network."""
    C.bounded_batches(docs.sparkSession)
    counts = C.stored(word_counts(docs), "words")
    words = vocabulary(counts)
    return counts, words, _trained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.sparkSession.sparkContext.broadcast(words))


def scored(docs: DataFrame, counts: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every document; n_rare and rare_log_prob: how many of its words aren't listed, and
    the mean log of their part of the corpus's words."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    sent = spark.sparkContext.broadcast((words, net))  # WORDS words and one network

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, network = sent.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, total, rare = [np.zeros(0, np.int64)], [np.zeros(0)], []
            for h, _, at in _chunks(batch):
                k = v.look_up(h)
                sums = np.concatenate([[0.0], np.cumsum(network.log_probability(_around(v.inputs(h, k), at), *v.targets(k)))])
                n.append(np.diff(at))
                total.append(sums[at[1:]] - sums[at[:-1]])
                # each text's other words once, with how often it has them
                other = np.flatnonzero(k < 0)
                text, x = np.searchsorted(at, other, "right") - 1, h[other]
                order = np.lexsort((x, text))
                text, x = text[order], x[order]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (x != np.roll(x, 1)))
                pairs = pa.StructArray.from_arrays([pa.array(x[new].view(np.int64)), pa.array(np.diff(np.append(new, len(x))).astype(np.int32))], ["h", "times"])
                rare.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(len(at))).astype(np.int32)), pairs))
            rows = pa.array(np.arange(key, key + batch.num_rows))
            key += batch.num_rows
            listed = pa.concat_arrays(rare) if rare else pa.array([], pa.list_(pa.struct([("h", pa.int64()), ("times", pa.int32())])))
            yield pa.RecordBatch.from_arrays([rows, batch["doc_id"], pa.array(np.concatenate(n)), pa.array(np.concatenate(total)), listed], ["key", "doc_id", "n_tokens", "log_prob", "rare"])

    base = C.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "key long, doc_id long, n_tokens long, log_prob double, rare array<struct<h: long, times: int>>"), "scores")
    rare = base.select("key", F.inline("rare"))
    part = F.log(F.coalesce("n", F.lit(1)) / F.lit(float(max(1, words.rare))))  # those that come once needn't be joined
    rare = rare.join(counts.filter("n > 1").select("h", "n").hint("merge"), "h", "left").groupBy("key").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * part).alias("rest"))
    both = base.drop("rare").join(rare, "key", "left").withColumn("n_rare", F.coalesce("n_rare", F.lit(0)))
    whole = F.col("log_prob") + F.coalesce("rest", F.lit(0.0))
    return both.select("doc_id", "n_tokens", whole.alias("log_prob"), F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_prob"), "n_rare", F.when(F.col("n_rare") > 0, F.col("rest") / F.col("n_rare")).alias("rare_log_prob"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return scored(docs, *fit(docs))
