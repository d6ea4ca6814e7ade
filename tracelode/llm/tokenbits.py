"""Token ids in files of fixed-width bits.

A document's ids are those of a public tokenizer, then END. Every id takes the least bits that hold any id of the vocabulary
(`width`). A dataset is a folder with a file per range of the order of documents, and MANIFEST, a JSON text that names the files in
order. A file has

    MAGIC | blocks | block offsets | documents | footer

Blocks: BLOCK ids each, the last one fewer, padded to a multiple of 64 ids; 64 ids are `width` little-endian 64-bit words, id k in
the bits from k * width, low bits first. Block offsets: where in the file each block begins, and where the last ends, 64 bits each.
Documents: a record of RECORD each, with its id, whether it is known (not null), and where in the file's ids it begins. Footer: FOOTER.
So any document, or any run of ids, is read and unpacked from its own blocks, with vector operations over all the words at once.

How it is written: rows are range-partitioned by doc_id (then a hash of the text, then where they come from, so that a repeated id or row is
many tasks'), sorted, tokenized and packed in one pass; a task holds one block, one batch, and 17 bytes per document. Each attempt of a
task writes a file of its own name, and only those of the attempts whose results Spark took are in MANIFEST, which is written last: a
lost executor leaves files that nothing reads. Reading lists the files in MANIFEST and deals out documents, DEALT at a time.

The tokenizer drops white space and works word by word, so a text is cut at ASCII white space, and each worker encodes a word by the
library once and remembers its ids (words of up to LONG bytes, REMEMBERED at most), and no more memory than a word's is taken by a long text.
The ids are those of the whole text, which tests compare. A vocabulary that isn't of this kind encodes each text as a whole.

Cases: null text is empty, so its only id is END; a null doc_id comes first; documents of one doc_id are in the order of a hash of
their texts, and repeated rows are written each; an empty table gives files without documents. The tokenizer's special strings are
the tokens that they stand for, as in the library. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import common as C

VOCABULARY, END = "word_bpe_49k", 2
MAGIC, MANIFEST = b"TLBITS01", "MANIFEST.json"
#: Ids per block; a multiple of 64.
BLOCK = 1 << 16
LONG, REMEMBERED = 64, 1_000_000
#: Marks that may stand behind a word, and the first letter that isn't taken apart from them.
MARKS, BEYOND = b".,;:!?", "\u0530"
#: The one letter before BEYOND whose lower case is two characters.
DOTTED = "\u0130"
#: Words that are encoded together; bytes of text whose words are taken at once.
TOGETHER, TAKEN = 4096, 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")
RECORD = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<i8")])
FOOTER = np.dtype([("width", "<i8"), ("block", "<i8"), ("ids", "<i8"), ("documents", "<i8"), ("offsets_at", "<i8"), ("records_at", "<i8"), ("magic", "S8")])
#: Documents that are read at once, and bytes of ids in one batch of what is read.
DEALT, BATCH = 2048, 1 << 23
_U = np.uint64
_LOADED: dict[str, tuple] = {}


# Tokens


class _Words(dict):
    """Word -> its ids, four bytes each. A word of letters with marks behind it has the ids of both, since the tokenizer splits there, and
    those of its letters in lower case; letters with combining characters aren't taken apart, nor those beyond Cyrillic."""

    def __init__(self, encode: Callable[[str], list[int]], ends: np.ndarray) -> None:
        self.encode, self.ends, self.parts, self.unknown = encode, ends, {}, set()

    def __missing__(self, word: bytes) -> None:
        """A word that isn't known yet is remembered to be learnt."""
        self.unknown.add(word)

    def now(self, word: bytes) -> bytes:
        return self.get(word) or np.array(self.encode(word.decode()), "<u4").tobytes()

    def learn(self) -> None:
        """The ids of the words that weren't known; those of letters are encoded together, and told apart by the tokens that end a
        word."""
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        words = list(self.unknown)
        if not words:
            return
        # bytes in lower case are A to Z in lower case
        low = b"\n".join(words).lower().split(b"\n")
        stems = [x.rstrip(MARKS) for x in low]
        new = set()
        for k, stem in enumerate(stems):
            if len(words[k]) > LONG:
                stems[k] = None
            elif stem.isalpha() or _letters(stem):
                if stem not in self.parts:
                    new.add(stem)
            else:
                stems[k] = None
                self[words[k]] = np.array(self.encode(words[k].decode()), "<u4").tobytes()
        some = list(new)
        for a in range(0, len(some), TOGETHER):
            self._together(some[a : a + TOGETHER])
        parts = self.parts
        for word, stem, x in zip(words, stems, low):
            if stem is None:
                continue
            if len(stem) == len(x):
                self[word] = parts[stem]
                continue
            rest = x[len(stem) :]
            if rest not in parts:
                parts[rest] = np.array(self.encode(rest.decode()), "<u4").tobytes()
            self[word] = parts[stem] + parts[rest]
        self.unknown = set()

    def _together(self, stems: list[bytes]) -> None:
        ids = np.array(self.encode(b" ".join(stems).decode()), "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(stems):  # a letter that this version of the library doesn't take for one
            self.parts.update((x, np.array(self.encode(x.decode()), "<u4").tobytes()) for x in stems)
            return
        raw, begin = ids.tobytes(), 0
        for stem, end in zip(stems, (4 * cuts).tolist()):
            self.parts[stem] = raw[begin:end]
            begin = end


def _letters(stem: bytes) -> bool:
    text = stem.decode()
    return text.isalpha() and max(text) < BEYOND and DOTTED not in text


def _load(name: str) -> tuple:
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        largest = max(whole.get_vocab(with_added_tokens=True).values())
        encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        by_word = not encode(" \t\r\n") and encode("a \n b") == encode("a") + encode("b") and encode(" A,") == encode("a") + encode(",")
        ends = np.zeros(max(largest, END) + 1, bool)
        ends[[i for t, i in whole.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]] = True
        _LOADED[name] = encode, _Words(encode, ends) if by_word and ends.any() else None, max(largest, END).bit_length()
    return _LOADED[name]


def width_of(name: str = VOCABULARY) -> int:
    """The bits of the largest id."""
    return _load(name)[2]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about TAKEN bytes, cut at white space."""
    a = 0
    while len(text) - a > TAKEN and (m := _WHITE.search(text, a + TAKEN)):
        yield text[a : m.start()]
        a = m.end()
    yield text[a:] if a else text


def encoder(name: str = VOCABULARY) -> Callable[[list[bytes]], list[np.ndarray]]:
    """UTF-8 texts -> the ids of each, and END."""
    encode, words, _ = _load(name)
    end = np.array([END], "<u4").tobytes()

    def ids(texts: list[bytes]) -> list[bytes]:
        found = [t.split() for t in texts]
        known = [[*map(words.__getitem__, x)] for x in found]
        words.learn()
        return [b"".join([v or words.now(w) for v, w in zip(k, x)] if None in k else k) for k, x in zip(known, found)]

    def by_word(texts: list[bytes]) -> list[np.ndarray]:
        out, some, size = [], [], 0
        for text in [*texts, None]:
            if text is None or size + len(text) > TAKEN:
                out += ids(some)
                some, size = [], 0
            if text is not None and len(text) > TAKEN:
                out.append(b"".join(b"".join(ids([p])) for p in _pieces(text)))
            elif text is not None:
                some.append(text)
                size += len(text)
        return [np.frombuffer(x + end, "<u4") for x in out]

    if words is None:
        return lambda texts: [np.array([*encode(t.decode()), END], "<u4") for t in texts]
    return by_word


# Bits


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids, padded to a multiple of 64 with zeros, as width bits each."""
    rows = -(-len(ids) // 64)
    lanes = np.zeros((rows, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, width), np.uint64)
    for k in range(64):
        word, low = divmod(k * width, 64)
        out[:, word] |= lanes[:, k] << _U(low)
        if low + width > 64:
            out[:, word + 1] |= lanes[:, k] >> _U(64 - low)
    return out.astype("<u8").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    """The ids of packed bytes, the padding too."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), "<u4")
    mask = _U((1 << width) - 1)
    for k in range(64):
        word, low = divmod(k * width, 64)
        lane = words[:, word] >> _U(low)
        if low + width > 64:
            lane = lane | words[:, word + 1] << _U(64 - low)
        out[:, k] = lane & mask
    return out.reshape(-1)


# Files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(path.removeprefix("file:")))


class Writer:
    """One file; holds a block of ids and the records of its documents."""

    def __init__(self, path: str, width: int, block: int = BLOCK) -> None:
        system, inner = opened(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.block = system.open_output_stream(inner), width, block
        self.held: list[np.ndarray] = []
        self.waiting, self.ids, self.documents = 0, 0, 0
        self.at, self.offsets, self.records = len(MAGIC), [], []
        self.out.write(MAGIC)

    def _blocks(self, least: int) -> None:
        """Writes the ids held in whole blocks, while there are at least so many."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        a = 0
        while len(ids) - a >= least:
            data = packed(ids[a : a + self.block], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
            a += self.block
        self.held, self.waiting = [ids[a:]], max(0, len(ids) - a)

    def add(self, doc_ids: pa.Array, texts: list[np.ndarray]) -> None:
        """Documents with their ids."""
        records = np.zeros(len(texts), RECORD)
        records["known"] = ~doc_ids.is_null().to_numpy(zero_copy_only=False)
        records["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.array([len(t) for t in texts], np.int64)
        records["start"] = self.ids + np.cumsum(sizes) - sizes
        self.records.append(records.tobytes())
        self.documents += len(texts)
        for t in texts:
            self.held.append(t)
            self.waiting += len(t)
            self.ids += len(t)
            if self.waiting >= self.block:
                self._blocks(self.block)

    def close(self) -> None:
        self._blocks(1)
        self.offsets.append(self.at)
        body = np.array(self.offsets, "<i8").tobytes()
        footer = np.array([(self.width, self.block, self.ids, self.documents, self.at, self.at + len(body), MAGIC)], FOOTER)
        for part in (body, *self.records, footer.tobytes()):
            self.out.write(part)
        self.out.close()


class Reader:
    """Random access to one file: only the bytes asked for are read."""

    def __init__(self, path: str) -> None:
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        self.footer = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if self.footer["magic"] != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        self.width, self.block, self.n_ids, self.n_documents = (int(self.footer[c]) for c in ("width", "block", "ids", "documents"))

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of documents a to b, and where each begins, and the last ends."""
        n = min(b + 1, self.n_documents) - a
        records = np.frombuffer(self.file.read_at(n * RECORD.itemsize, int(self.footer["records_at"]) + a * RECORD.itemsize), RECORD)
        starts = records["start"].astype(np.int64)
        return records[: b - a], starts if n > b - a else np.append(starts, self.n_ids)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        offsets = np.frombuffer(self.file.read_at(8 * (last - first + 2), int(self.footer["offsets_at"]) + 8 * first), "<i8")
        # all blocks but the file's last hold a multiple of 64 ids without padding
        data = self.file.read_at(int(offsets[-1] - offsets[0]), int(offsets[0]))
        return unpacked(data, self.width)[start - first * self.block : end - first * self.block]


# The distributed operator


def write(docs: DataFrame, path: str, name: str = VOCABULARY, block: int = BLOCK) -> None:
    """Documents (doc_id, text), tokenized, as files below path. It is there once MANIFEST is."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    keys = ("doc_id", "_h", "text", "_from")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"_h": F.xxhash64("text"), "_from": F.monotonically_increasing_id()})
    ranges = rows.repartitionByRange(C.tasks(spark), "doc_id", "_h", "_from").sortWithinPartitions(*keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, encode, out = f"part-{part:06d}-{uuid.uuid4().hex}.ids", encoder(name), None
        for batch in batches:
            if out is None:
                out = Writer(f"{path}/{file}", width_of(name), block)
            out.add(batch["doc_id"], encode(C.blobs(batch["text"])))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([out.documents]), pa.array([out.ids])], ["part", "file", "documents", "ids"])

    # a row for each file, so as many as there are tasks
    files = ranges.select("doc_id", "text").mapInArrow(each, "part int, file string, documents long, ids long").collect()
    listed = {"vocabulary": name, "width": width_of(name), "end": END, "files": [r.asDict() for r in sorted(files)]}
    system, inner = opened(f"{path}/{MANIFEST}")
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(json.dumps(listed).encode())


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    C.bounded_batches(spark)
    system, inner = opened(f"{path}/{MANIFEST}")
    with system.open_input_stream(inner) as f:
        listed = json.loads(f.read())
    before, files = 0, []
    for one in listed["files"]:
        files.append((one["file"], before, one["documents"]))
        before += one["ids"]
    parts = spark.createDataFrame(files, "file string, base long, documents long").filter("documents > 0")
    parts = parts.withColumn("first", F.explode(F.expr(f"sequence(0L, documents - 1, {DEALT}L)"))).repartition(C.tasks(spark), "file", "first")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            for file, base, n, first in zip(*(batch[c].to_pylist() for c in ("file", "base", "documents", "first"))):
                if file != now:
                    now, reader = file, Reader(f"{path}/{file}")
                records, cuts = reader.documents(first, min(first + DEALT, n))
                for a, b in C.groups(cuts, BATCH // 4):
                    ids, own = reader.ids(int(cuts[a]), int(cuts[b])), cuts[a : b + 1] - cuts[a]
                    kept = records[a:b]
                    doc_id = pa.array(kept["doc_id"].astype(np.int64), pa.int64(), mask=kept["known"] == 0)
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((4 * own).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(base + cuts[a:b]), pa.array(np.diff(own)), column], ["doc_id", "start", "n_tokens", "ids"])

    return parts.mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.shared_path(spark, "token-ids")
    write(C.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
