"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

FILTERS filters of WIDTH bytes (one weight per place and byte value) slide over the whole text, STRIDE bytes at a time. Chunks of
CHUNK bytes overlap by CHUNK - HOP; each filter is max-pooled over a chunk and rectified, a hidden layer describes the chunk from
these and its length (so that few different responses in a short chunk aren't taken for repetition), and the means and maxima of all chunks' descriptions give one probability by logistic regression.

Training uses the whole texts of at most PER_CLASS labelled documents of each class outside the held-out fold (crc32(doc_id as text)
mod 5 = 0), drawn by a hash of the id; classes weigh the same. SPLIT of the texts in a step are taken apart into consecutive pieces,
all of them examples, which share the text's weight: no byte is left out, and neither class is the one with the short texts. lang, source and doc_id are no inputs. Scoring covers every byte of
every text, as each training step does.

Cases: null text is empty; a text shorter than a filter is padded with zero bytes; repeated rows get equal scores; ids without a
label, with a null label or with both labels aren't trained on; without labels of both classes the score is the share of class 1 (0.5 with none);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import common as C
from tracelode.llm.labelled import sample

FILTERS, WIDTH, STRIDE, CHUNK, HOP, HIDDEN = 48, 8, 2, 512, 256, 16
PER_CLASS, EPOCHS, LEAST_STEPS, BATCH, RATE = 2500, 7, 500, 32, 0.004
THRESHOLD = 0.3
#: Part of the documents that a step sees as a row of short texts, their pieces of one random length, so that being short says nothing.
SPLIT, SHORTEST, LONGEST = 0.3, 16, 240
#: Threads that convolve the texts of one training step; the result doesn't depend on it.
THREADS = 4


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, FILTERS**-0.5, (FILTERS + 1, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """Responses at every STRIDE-th place of padded bytes."""
        t = self.p["filters"]
        n = (len(data) - WIDTH) // STRIDE + 1
        out = t[0][data[0 : STRIDE * n : STRIDE]]
        buf = np.empty_like(out)
        for k in range(1, WIDTH):
            np.take(t[k], data[k : k + STRIDE * n : STRIDE], axis=0, out=buf)
            out += buf
        return out

    def head(self, pooled: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """pooled: chunks x FILTERS; size: places in each chunk; doc: where each document's chunks begin."""
        a = np.concatenate([np.maximum(pooled + self.p["bias"], 0), np.log2(size)[:, None].astype(np.float32) / 4], axis=1)
        h = np.tanh(a @ self.p["w1"] + self.p["b1"])
        n = np.diff(np.append(doc, len(h)))[:, None]
        mean, top = np.add.reduceat(h, doc) / n, np.maximum.reduceat(h, doc)
        return a, h, n, mean, top, np.concatenate([mean, top], axis=1) @ self.p["w2"] + self.p["b2"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = [self._score(texts[i : i + 64]) if sum(map(len, texts[i : i + 64])) < C.CHUNK_BYTES else np.concatenate([self._score([t]) for t in texts[i : i + 64]]) for i in range(0, len(texts), 64)]
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[bytes]) -> np.ndarray:
        pooled, size = zip(*(self.pool(t) for t in texts))
        doc = np.cumsum([0, *map(len, pooled[:-1])])
        z = self.head(np.concatenate(pooled), np.concatenate(size), doc)[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))

    def pool(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maxima and size."""
        top, size, _ = self.pool_at(np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8), False)
        return top, size

    def pool_at(self, data: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Each chunk's maxima and size, and where the maxima are; a chunk is two neighbouring steps, each worked out once. The
        text goes through in pieces of 1 << 18 bytes, which share their edges."""
        step = HOP // STRIDE
        tops, sizes, at = [], [], []
        for i in range(0, max(1, len(data) - WIDTH + STRIDE), 1 << 18):
            y = self.convolve(data[i : i + (1 << 18) + WIDTH - STRIDE])
            cuts = np.arange(0, len(y), step)
            sizes.append(np.diff(np.append(cuts, len(y))))
            if places:
                where = np.stack([y[c : c + step].argmax(0) + c for c in cuts.tolist()])
                tops.append(np.take_along_axis(y, where, axis=0))
                at.append(where + i // STRIDE)
            else:
                tops.append(np.maximum.reduceat(y, cuts))
        top, size = np.concatenate(tops), np.concatenate(sizes)
        where = np.concatenate(at) if places else None
        if len(top) > 1:
            if places:
                where = np.where(top[:-1] >= top[1:], where[:-1], where[1:])
            top, size = np.maximum(top[:-1], top[1:]), size[:-1] + size[1:]
        return top, size, where

    def pool_pieces(self, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As pool_at(), of consecutive pieces of this length (even, half a chunk at most), each as a text of its own; the last has
        what is left, less than twice as much."""
        n, half, m = max(1, len(data) // length), length // STRIDE, (length - WIDTH) // STRIDE + 1
        group = max(1, (1 << 18) // length)
        tops, where = [], []
        for k in range(0, n - 1, group):
            some = min(group, n - 1 - k)
            y = self.convolve(data[k * length : (k + some) * length + WIDTH])[: some * half].reshape(some, half, FILTERS)[:, :m]
            at = y.argmax(1)
            tops.append(np.take_along_axis(y, at[:, None], axis=1)[:, 0])
            where.append(at + (k + np.arange(some))[:, None] * half)
        y = self.convolve(data[(n - 1) * length :])
        at = y.argmax(0)
        tops.append(np.take_along_axis(y, at[None], axis=0))
        where.append(at[None] + (n - 1) * half)
        return np.concatenate(tops), np.append(np.full(n - 1, m), len(y)), np.concatenate(where)


def gradients(net: Network, seen: list[np.ndarray], y: np.ndarray, pool: ThreadPoolExecutor, lengths: list[int] | None = None) -> dict[str, np.ndarray]:
    """Of the cross-entropy of these texts (bytes, padded to WIDTH at least), in which both classes weigh the same; lengths: of the
    pieces that each text is taken apart into, which share its weight, 0 for the text as it is."""
    lengths = lengths or [0] * len(seen)
    tops, sizes, where = zip(*pool.map(lambda t, k: net.pool_pieces(t, k) if k else net.pool_at(t), seen, lengths))
    chunks = np.array([len(t) for t in tops])
    text = np.repeat(np.arange(len(seen)), chunks)
    n = np.where(np.array(lengths) > 0, chunks, 1)
    doc = np.concatenate([np.arange(k) + c for k, c in zip(n, np.cumsum([0, *chunks[:-1]]))])
    a, h, size, mean, top, z = net.head(np.concatenate(tops), np.concatenate(sizes), doc)
    p = 1 / (1 + np.exp(-z))
    weight = np.repeat(np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) / n, n)
    dz = ((p - np.repeat(y, n)) * weight).astype(np.float32)
    both = np.concatenate([mean, top], axis=1)
    of = np.repeat(np.arange(len(doc)), size[:, 0])
    dboth = dz[:, None] * net.p["w2"]
    dh = (dboth[:, :HIDDEN] / size)[of] + dboth[of, HIDDEN:] * (h == top[of])
    dpre = dh * (1 - h * h)
    da = ((dpre @ net.p["w1"].T) * (a > 0))[:, :FILTERS]
    # the bytes under each maximum, all texts in a row
    begin = np.cumsum([0, *map(len, seen[:-1])])
    under = np.concatenate(where) * STRIDE + begin[text][:, None]
    data, lane = np.concatenate(seen), np.arange(FILTERS)
    filters = [np.bincount((data[under + k].astype(np.int64) * FILTERS + lane).ravel(), da.ravel(), 256 * FILTERS) for k in range(WIDTH)]
    return {"w2": both.T @ dz, "b2": dz.sum(keepdims=True), "w1": a.T @ dpre, "b1": dpre.sum(0), "bias": da.sum(0), "filters": np.stack(filters).reshape(WIDTH, 256, FILTERS).astype(np.float32)}


def train(rows: list[tuple[int, bytes]], share: float, seed: int = 7) -> Network | float:
    """The trained network, or a constant where one class has no rows."""
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return share if len(y) else 0.5
    net, rng = Network(seed), np.random.default_rng(seed)
    texts = [np.frombuffer(t.ljust(WIDTH, b"\0"), np.uint8) for _, t in rows]
    by_class = [np.flatnonzero(y == k) for k in (0, 1)]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    total = max(LEAST_STEPS, EPOCHS * len(texts) // BATCH)
    with ThreadPoolExecutor(THREADS) as pool:
        for step in range(1, total + 1):
            some = np.concatenate([rng.choice(k, min(BATCH // 2, len(k)), replace=False) for k in by_class])
            lengths = [STRIDE * int(rng.integers(SHORTEST // STRIDE, LONGEST // STRIDE)) if rng.random() < SPLIT else 0 for _ in some]
            g = gradients(net, [texts[i] for i in some], y[some], pool, lengths)
            rate = RATE * min(1, 2 * (1 - step / total) + 0.05)
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    rows, share = sample(docs, labels, "quality", PER_CLASS)
    return train(rows, share)


def scored(docs: DataFrame, model: Network | float, column: str = "score") -> DataFrame:
    """docs with the probability of good quality as a further column; one of this name is replaced."""
    C.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 300 KB
    docs = docs.drop(column)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = C.blobs(batch["text"])
            s = np.full(len(texts), m) if isinstance(m, float) else m.score(texts)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s, pa.float64())], [*names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(each, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
