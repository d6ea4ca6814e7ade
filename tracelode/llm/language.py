"""Language ID by compression: each text is encoded with every language's zstandard raw-content dictionaries; the smallest wins.

Sizes differ by a byte or two where texts are short, so each language has DICTIONARIES dictionaries (of different sample texts) or
more, whose sizes are averaged, at all lengths of text alike. zstandard takes up the end of a long dictionary only, so one of more than
LARGEST bytes is several, all of which are asked. The score is the share of the winner when the sizes saved over encoding without any
dictionary are compared (0 to 1); a text whose margin over the second language is below MARGIN of its size is marked as rejected, and
keeps the language of the smallest size.

Dictionaries are the whole texts of at most PER_LANGUAGE documents per language, drawn by a hash of the id from documents with a
language outside the held-out fold (crc32(doc_id as text) mod 4 = 2); source and doc_id are no inputs. The whole of every text is
encoded, in lower case and with one blank for whatever isn't a letter, in pieces of PIECE bytes, each on its own, so that it is the
dictionary that counts and not what the text repeats.

Cases: null texts and texts without a letter get `und` and score 0; repeated rows get equal results; of several documents with one
id and language the least text is learnt; rows without a language or an id aren't learnt from; without any, all texts get `und`; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import common as C

PER_LANGUAGE, DICTIONARIES, LEVEL = 160, 2, 3
PIECE, MARGIN = 512, 0.02
#: Bytes of one dictionary; all of it counts.
LARGEST = 1 << 19
LETTER, OTHER = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")


def examples(docs: DataFrame, folds: int = 4, held_out: int = 2) -> dict[str, list[bytes]]:
    """At most PER_LANGUAGE whole texts of each language, those of the least hashes of their ids. Languages are so many as the table has."""
    C.bounded_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (C.fold("doc_id", folds) != held_out) & (F.col("text") != "")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), "text")
    # only ids are ranked, and of a language with many rows only those whose hash is in its lowest part, some thrice as many as are taken
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    h = F.xxhash64("doc_id")
    low = (h.cast("double") + 2.0**63) * F.col("rows") < (3 * PER_LANGUAGE + 200) * 2.0**64
    first = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    chosen = known.select("doc_id", "lang").join(counts, "lang").filter(low).select("doc_id", "lang").distinct().withColumn("n", first).filter(F.col("n") <= PER_LANGUAGE)
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def letters_only(text: bytes) -> bytes:
    """Lower case, with one blank for whatever isn't a letter."""
    return OTHER.sub(" ", text.decode(errors="ignore").lower()).encode()


def even(content: bytes) -> list[bytes]:
    """As few parts of at most LARGEST bytes as there can be, of about one size."""
    n = max(1, -(-len(content) // LARGEST))
    cuts = [len(content) * k // n for k in range(n + 1)]
    return [content[a:b] for a, b in zip(cuts, cuts[1:])]


class Compressors:
    """Dictionaries of each language, ready to encode; made anew in each worker from the examples."""

    def __init__(self, found: dict[str, list[bytes]]) -> None:
        self.langs = sorted(found)
        self.sets = []
        for lang in self.langs:
            texts = found[lang]
            whole = [b"\n".join(letters_only(t) for t in texts[k::DICTIONARIES] or texts) for k in range(DICTIONARIES)]
            self.sets.append([self._one(part) for content in whole for part in even(content)])
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def _one(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def sizes(self, text: bytes) -> tuple[float, np.ndarray]:
        """Encoded bytes without a dictionary, and by language the mean of its dictionaries."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(self.plain.compress(p)) for p in pieces), np.array([sum(len(z.compress(p)) for z in zs for p in pieces) / len(zs) for zs in self.sets])

    def best(self, text: bytes) -> tuple[str, float, bool]:
        if not self.langs or not LETTER.search(text.decode()):
            return "und", 0.0, True
        text = letters_only(text)
        bare, size = self.sizes(text)
        order = np.argsort(size, kind="stable")
        margin = (size[order[1]] - size[order[0]]) / max(1, len(text)) if len(size) > 1 else 1.0
        k = int(order[0])
        saved = np.maximum(0, bare - size)
        score = float(saved[k] / saved.sum()) if saved.sum() > 0 else 1 / len(size)
        return self.langs[k], min(1.0, score), bool(margin < MARGIN)


def identified(docs: DataFrame, found: dict[str, list[bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document."""
    C.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(found)  # at most PER_LANGUAGE texts a language

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Compressors(sent.value)
        for batch in batches:
            rows = [z.best(t) for t in C.blobs(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = identified(docs, examples(docs))
    return out.select("doc_id", (C.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
