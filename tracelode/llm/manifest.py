"""A Merkle manifest of a dataset: a root digest, a digest of each source, and for each document a proof that it is part of them.

A digest is the lower-case hex SHA-256 of its inputs, one after the other, other digests as their hex text. A document's leaf is the
digest of its fields in the order of FIELDS, each `-` if null, else its UTF-8 byte count, a colon and its value. The leaves of a
source ascend by doc_id; every FANOUT consecutive nodes become one node of the next level (the last ones may be fewer, even one), until
one is left, the source's subroot. The subroots, in the order of sources, give the root in the same way. A proof has, for each level
from the leaf up to the root, where the node stands among its siblings and their digests from left to right.

How it is distributed: leaves are range-partitioned by source, doc_id and digest, so that no source, however large, is one task's, and
numbered within their source by the counts of the ranges. Blocks of FANOUT^LEVELS consecutive leaves are one matrix of 64-byte rows: a level is the hashes of its rows reshaped by FANOUT, and the siblings of all nodes are found by index arithmetic. The
top nodes of the blocks of a source of more than one block are numbered nodes again, so each round makes one row of 4,096 of the
one before (three rounds for 69 thousand million documents of one source), and the subroots go through the same rounds.
Then the rounds are gone through from the top: each block learns the proof of its own top node, and hands its members theirs.
Joins are on blocks, which are unique, and the driver sees the largest count only.

Cases: a null doc_id comes first in its source and is `-` in its leaf; documents of one doc_id are in the order of their leaves, and
repeated rows are leaves each; a null source is a source, before all others; an empty table gives no rows; a single document's leaf is
its subroot and the root, and its proof is empty. Other columns are ignored.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import common as C

FANOUT, LEVELS, HEX = 16, 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one batch of proofs, of some kilobytes each.
ROWS = 512
PROOF = "array<struct<at: int, siblings: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tampering reaches the documents whose crc32 this divides.
TAMPERED = 5


# One block: matrices of digests


def hashed(rows: np.ndarray) -> np.ndarray:
    """The digest of each row of bytes, as rows of 64 hex digits."""
    raw = b"".join([sha256(r).digest() for r in np.ascontiguousarray(rows)])
    return np.frombuffer(binascii.hexlify(raw), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, n: int, depth: int) -> list[np.ndarray]:
    """The levels of a block of a tree of n leaves: up to a single node if it is the whole tree, else `depth` above the leaves."""
    out = [leaves]
    while len(out[-1]) > 1 or n > FANOUT**depth and len(out) <= depth:
        below = out[-1]
        full = len(below) // FANOUT * FANOUT
        up = [hashed(below[:full].reshape(-1, FANOUT * HEX))]
        if full < len(below):
            up.append(hashed(below[full:].reshape(1, -1)))
        out.append(np.concatenate(up))
    return out


def siblings(tree: list[np.ndarray], members: np.ndarray) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """For each level below the top: the places of the members' nodes among their siblings, and these siblings' digests."""
    places, texts = [], []
    for level in tree[:-1]:
        run, at = members // FANOUT * FANOUT, members % FANOUT
        width = np.minimum(FANOUT, len(level) - run)
        found: list[bytes] = [b""] * len(members)
        for w in np.unique(width).tolist():  # FANOUT, and what the last run has
            rows = np.flatnonzero(width == w)
            others = np.arange(w - 1) + (np.arange(w - 1) >= at[rows, None])
            for k, one in zip(rows.tolist(), level[run[rows, None] + others].reshape(len(rows), -1)):
                found[k] = one.tobytes()
        places.append(at)
        texts.append(found)
        members = members // FANOUT
    return places, texts


def climb(node: bytes, proof: list[tuple[int, bytes]]) -> bytes:
    """What a node and its siblings, level by level, give at the top."""
    for at, others in proof:
        node = sha256(others[: HEX * at] + node + others[HEX * at :]).hexdigest().encode()
    return node


# Blocks of a table of numbered nodes


def _matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The digests of each row's members."""
    col = batch["members"]
    body, _ = C.flat(col.flatten().field("digest"))
    cuts = col.offsets.to_numpy() - col.offsets[0].as_py()
    nodes = body.reshape(-1, HEX)
    return [nodes[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes (group, i, n, digest, item), i from 0 below n in each group -> a row per block: group, block, n, its members (i, digest,
    item) in order, at most FANOUT^depth, and the digest of its top node."""
    rows = nodes.groupBy("group", F.floor(F.col("i") / FANOUT**depth).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "digest", "item"))).alias("members"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [levels(m, n, depth)[-1].tobytes().decode() for m, n in zip(_matrices(batch), batch["n"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "digest"])

    return rows.mapInArrow(top, T.StructType([*rows.schema.fields, T.StructField("digest", T.StringType())]))


def _risen(nodes: DataFrame, name: str, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, the documents' first, and (group, digest) of the top of each group's tree."""
    block = FANOUT**depth
    most = nodes.agg(F.max("n")).first()[0] or 0
    tables = [C.stored(_blocks(nodes, depth), name)]
    while most > block:
        more = tables[-1].filter(F.col("n") > block)
        more = more.select("group", F.col("block").alias("i"), F.ceil(F.col("n") / block).alias("n"), "digest", F.lit(None).cast("string").alias("item"))
        tables.append(C.stored(_blocks(more, depth), name))
        most = -(-most // block)
    tops = None
    for t in tables:
        done = t.filter(F.col("n") <= block).select("group", "digest")
        tops = done if tops is None else tops.unionByName(done)
    return tables, tops


ABOVE = f"proof {PROOF}, subroot string, root string"


def _members(blocks: DataFrame, schema: str, values: tuple[str, ...], depth: int) -> DataFrame:
    """blocks, each with the proof, subroot and root of its top node -> a row per member with its own: the fields `values` of its item (or the
    item itself), its digest, and the columns of ABOVE."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper = zip(batch["proof"].to_pylist(), batch["subroot"].to_pylist(), batch["root"].to_pylist())
            cuts = batch["members"].offsets.to_pylist()
            held = batch["members"].flatten()
            base = cuts[0]
            for row, (nodes, n, (above, subroot, root)) in enumerate(zip(_matrices(batch), batch["n"].to_pylist(), upper)):
                tree = levels(nodes, n, depth)
                for a in range(0, len(nodes), ROWS):
                    some = np.arange(a, min(a + ROWS, len(nodes)))
                    places, texts = siblings(tree, some)
                    steps = len(places) + len(above)
                    at = np.empty((len(some), steps), np.int32)
                    for k, p in enumerate(places):
                        at[:, k] = p
                    at[:, len(places) :] = [x["at"] for x in above]
                    rest = [x["siblings"].encode() for x in above]
                    others = pa.array([x for own in zip(*texts) for x in (*own, *rest)] if texts else rest * len(some), pa.binary()).cast(pa.string())
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * steps, pa.int32()), pa.StructArray.from_arrays([pa.array(at.ravel(), pa.int32()), others], ["at", "siblings"]))
                    members = held.slice(cuts[row] - base + a, len(some))
                    item = members.field("item")
                    own = [members.field(v) if v in ("i", "digest") else item if v == "item" else item.field(v) for v in values]
                    group = pa.array([batch["group"][row].as_py()] * len(some), pa.string())
                    yield pa.RecordBatch.from_arrays([group, *own, proof, pa.array([subroot] * len(some), pa.string()), pa.array([root] * len(some), pa.string())], ["group", *values, "proof", "subroot", "root"])

    return blocks.select("group", "n", "members", "proof", "subroot", "root").mapInArrow(each, f"group string, {schema}, {ABOVE}")


def _sunk(tables: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The blocks of the first round with the proofs of their top nodes; tops: the proof of each group's top (group and ABOVE)."""
    above, block = None, FANOUT**depth
    for t in reversed(tables):
        single = t.filter(F.col("n") <= block).alias("t").join(tops.alias("a"), F.expr("t.group <=> a.group"))
        joined = single.select("t.*", "a.proof", "a.subroot", "a.root")
        if above is not None:
            more = t.filter(F.col("n") > block).alias("t").join(above.alias("a"), F.expr("t.group <=> a.group AND t.block = a.i"))
            joined = joined.unionByName(more.select("t.*", "a.proof", "a.subroot", "a.root"))
        if t is tables[0]:
            return joined
        above = _members(joined, "i long", ("i",), depth)


def _numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """rows with i, their place in the order of their group, and n, how many it has. Ranges of the order are sorted and stored, so that
    places stay what they were if a task is run again. Equal rows are told apart by where they come from, so that ranges split them too."""
    keys = ("group", *order, "_from")
    ranges = rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(C.tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = C.stored(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_from"), name)
    counts = placed.groupBy("group", "_part").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    parts = Window.partitionBy("group")
    before = F.coalesce(F.sum("_m").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(parts).alias("n"))
    out = placed.alias("p").join(counts.alias("c"), F.expr("p.group <=> c.group AND p._part = c._part"))
    return out.select("p.*", (F.col("p._at") + F.col("c._shift")).alias("i"), "c.n").drop("_at", "_part")


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row with the columns FIELDS; with another text, if given."""
    return F.sha2(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]).cast("binary"), 256)


def manifest(docs: DataFrame, changed: Column | None = None, depth: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, changed, subroot, root and proof of each document. changed: a column worked out beside the leaf and carried
    along, for instance the leaf of another version of the row. depth: levels of a block above its leaves; results don't depend on it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")
    C.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("source").alias("group"), "doc_id", leaf().alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    numbered = _numbered(rows, ("doc_id", "digest"), "leaves")
    tables, subroots = _risen(numbered.select("group", "i", "n", "digest", F.struct("doc_id", "changed").alias("item")), "blocks", depth)
    sources = _numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("item"), "digest"), ("item",), "subroots")
    upper, root = _risen(sources.select("group", "i", "n", "digest", "item"), "upper", depth)
    top = root.select("group", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    # a member of the upper tree is a source's subroot
    tops = _members(_sunk(upper, top, depth), "item string, digest string", ("item", "digest"), depth).select(F.col("item").alias("group"), "proof", F.col("digest").alias("subroot"), "root")
    out = _members(_sunk(tables, C.stored(tops, "proofs"), depth), "doc_id long, changed string, digest string", ("doc_id", "changed", "digest"), depth)
    return out.select("doc_id", F.col("group").alias("source"), F.col("digest").alias("leaf"), "changed", "subroot", "root", "proof")


def folded(proofs: DataFrame, leaf: str, name: str = "folded_root") -> DataFrame:
    """proofs with the root that the column `leaf` and the siblings of each row's proof give."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch["proof"]
            base, cuts, parts = col.offsets[0].as_py(), col.offsets.to_pylist(), col.flatten()
            steps = list(zip(parts.field("at").to_pylist(), C.blobs(parts.field("siblings"))))
            tops = [climb(node, steps[a - base : b - base]).decode() for node, a, b in zip(C.blobs(batch[leaf]), cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, name])

    return proofs.mapInArrow(each, T.StructType([*proofs.schema.fields, T.StructField(name, T.StringType())]))


def audit(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """The manifest of docs, and what each proof says of the row as tampering leaves it."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    proofs = manifest(docs, F.when(hit, leaf(F.translate("text", UPPER, LOWER))), depth)
    proofs = proofs.withColumn("now", F.coalesce("changed", "leaf")).withColumn("proof_sha256", F.sha2(F.array_join("proof.siblings", "").cast("binary"), 256))
    return folded(proofs, "now").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB's version, for trees of at most 16^5 nodes: levels are unrolled."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join([*map(field, FIELDS[:-1]), field(text)])})"
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    table = "SELECT range AS v, range AS c FROM range(256)"
    for _ in range(8):
        table = f"SELECT v, {step.format('c')} AS c FROM ({table})"
    parts = [
        f"crc AS (SELECT list(c ORDER BY v) AS t FROM ({table}))",
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS other, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        "e AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS k FROM d, crc)",
        f"a0 AS (SELECT doc_id, source, leaf, CASE WHEN k % {TAMPERED} = 0 THEN other ELSE leaf END AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e)",
    ]

    depth = 5

    def climb(name: str, key: str) -> str:
        """Levels name0.. of a forest by key; a tree stays as it is at its single node."""
        for k in range(depth):
            parts.append(
                f"{name}{k + 1} AS (SELECT {key} AS g, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY {key}, i // {FANOUT})"
            )
        return f"{name}{depth}"

    def others(name: str, place: str, k: int, what: str) -> str:
        return f"(SELECT {what} FROM {name}{k} x WHERE x.g IS NOT DISTINCT FROM {'p.source' if name == 'b' else "''"} AND x.i // {FANOUT} = {place} // {FANOUT ** (k + 1)} AND x.n > 1)"

    parts.append("b0 AS (SELECT source AS g, i, leaf AS h, n FROM a0)")
    climb("b", "g")
    parts.append("c0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS source FROM b5)")
    climb("c", "g")
    parts.append("p AS (SELECT a0.*, c0.i AS j, c0.h AS subroot, (SELECT h FROM c5) AS root FROM a0 JOIN c0 ON a0.source IS NOT DISTINCT FROM c0.source)")
    # siblings and folds, level by level
    proof, last = [], "p"
    for name, at in (("b", "i"), ("c", "j")):
        for k in range(depth):
            here = f"q{name}{k}"
            own = f"p.{at} // {FANOUT**k}"
            parts.append(
                f"{here} AS (SELECT p.* EXCLUDE (now), coalesce({others(name, f'p.{at}', k, f"string_agg(CASE WHEN x.i = {own} THEN '' ELSE x.h END, '' ORDER BY x.i)")}, '') AS s{name}{k}, "
                f"coalesce({others(name, f'p.{at}', k, f"sha256(string_agg(CASE WHEN x.i = {own} THEN p.now ELSE x.h END, '' ORDER BY x.i))")}, now) AS now FROM {last} p)"
            )
            proof.append(f"s{name}{k}")
            last = here
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, now AS folded_root, now = root AS verified FROM {last}"


SQL = _sql()
