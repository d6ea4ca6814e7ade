"""Benchmark decontamination by template canonicalisation.

In documents and benchmark items alike, numbers, names (capitalised words) and units (after numbers) become typed placeholders, and
all other words are lower-cased without outer punctuation. Windows of WINDOW template words (an item of fewer words is one window)
are hash-joined, once as templates, if LITERAL words or more are no placeholders, and once as they are (lower-cased, with numbers and
names), so that no copy is missed for being full of numbers or in capitals, whose words all look like names.
What stood in the slots is then compared: along one diagonal of an item in a document, each slot value of the item must always stand
for the same value in the document, as it does in copies and in re-parameterised questions, but not in texts that share a phrase by
chance. A window weighs the less the more items have it as it is (WEIGHT by their number), so that a prompt that many items share is
no evidence of any of them. A document is contaminated by an item if such diagonals match COVERAGE of the weight of the item's
windows, or as templates COVERAGE of the weight of those that are templates, if these are COVERAGE of the item.
An item of fewer than LEAST words is found where a document has it, as it is, as a whole line: such a phrase within a line says
nothing.

Before the join a bitmap of CELLS bits, filled with the benchmark's windows and of that size whatever the tables, keeps windows that
no item has inside the scan. Pairs of a document and an item are then looked for by the item's rarest windows only, as many as leave
less than COVERAGE to all others: whatever reaches COVERAGE has one of these. All windows are compared for such pairs. So windows that
documents and items share by the thousand aren't joined, and nothing is lost. The joins are joins of two tables that Spark can split
when one item is in very many documents; what is added up is at most one document's windows of one item.

Cases: null texts have no words; items without a word match nothing; repeated documents and items are matched each (rows with the
same doc_id and text count as one); an empty table of either kind gives no rows; null ids are carried; only doc_id, item_id and text
are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm import common as C

WINDOW, LEAST, LITERAL, COVERAGE = 8, 5, 0.5, 0.5
#: What a window weighs that one item has; integers, so that sums don't depend on their order.
WEIGHT = 1_000_000
CELLS, SHARD = 1 << 24, 1 << 17
MEMO = 1 << 20
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph km/h m/s hz khz mhz ghz w kw kwh v a j kj n pa kpa k c f °c °f % percent percents usd eur gbp dollar dollars euro euros cent cents pesos francs marks degree degrees people items times".split()
)
#: Template codes: number, name, unit, number with its unit; below FIRST_UNIT all else is a hash.
NUMBER, NAME, UNIT, MEASURE = 1, 2, 3, 4
FIRST_UNIT = 2**64 - 4096
_UNIT_CODE = {u: FIRST_UNIT + i for i, u in enumerate(sorted(UNITS))}
_OUTER = ".,;:?!\"'()[]{}<>*#&|=-_~^/\\`«»“”‘’¿¡…"


def core(word: bytes) -> str:
    s = word.decode(errors="ignore")
    return s.strip(_OUTER) or s


def code(word: bytes) -> int:
    return _code(core(word))


def _code(s: str) -> int:
    if not s.isalpha() and any(c.isdigit() for c in s):
        tail = s.lstrip("+-.,0123456789€$£")
        return MEASURE if tail and tail.lower() in UNITS else NUMBER
    if s[:1].isupper():
        return NAME
    low = s.lower()
    return _UNIT_CODE.get(low) or max(16, xxhash.xxh64_intdigest(low.encode(), 11) % (FIRST_UNIT - 16) + 16)


def plain(word: bytes) -> int:
    """The code of a word as it is: lower case, without outer punctuation."""
    return _plain(core(word))


def _plain(s: str) -> int:
    return xxhash.xxh64_intdigest(s.lower().encode(), 12)


class Numbers(dict):
    """word -> its number, the place of its two codes, code() and plain(), in two arrays; worked out once while it is remembered."""

    def __init__(self) -> None:
        self.codes, self.plains = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        s = core(word)
        self.codes.append(_code(s))
        self.plains.append(_plain(s))
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """code() and plain() of each word."""
        if len(self) >= MEMO:
            self.clear()
            self.codes, self.plains = array("Q"), array("Q")
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.codes, np.uint64)[at], np.frombuffer(self.plains, np.uint64)[at]


class Codes(dict):
    """word -> its code, while it is remembered."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        v = self[word] = self.of(word)
        return v


def template(words: list[bytes], codes: Codes, begins: np.ndarray) -> np.ndarray:
    """The template words of consecutive texts; a unit is one only after a number of the same text."""
    return with_units(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), begins)


def with_units(t: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The codes t with those of units after numbers; changes t in place."""
    unit = np.flatnonzero(t >= np.uint64(FIRST_UNIT))
    if len(unit):
        first = np.isin(unit, begins)
        after = (unit > 0) & ~first & (t[unit - 1] == NUMBER)
        t[unit[after]] = UNIT
    return t


def windows(at: np.ndarray, t: np.ndarray, same: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """First word, text and hash of the windows of this size, and whether they are hashed as templates: those with enough literal
    words, and again all of them as they are. t: the template words; same: the words as they are."""
    place, doc = C.within(at, size)
    literal = np.concatenate([[0], np.cumsum(t >= 16)])
    enough = literal[place + size] - literal[place] >= LITERAL * size if size >= LEAST else np.zeros(len(place), bool)
    as_template = C.mix(C.runs(t, size)[place[enough]] ^ np.uint64(size))
    as_is = C.mix(C.runs(same, size)[place] ^ np.uint64(size + 64))
    return np.concatenate([place[enough], place]), np.concatenate([doc[enough], doc]), np.concatenate([as_template, as_is]), np.arange(len(as_template) + len(place)) < len(as_template)


def line_starts(text: bytes) -> dict[int, int]:
    """Where lines of fewer than LEAST words begin: first word -> number of words."""
    out, k = {}, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if 0 < n < LEAST:
            out[k] = n
        k += n
    return out


def _found(docs: DataFrame, ids: list[str], sizes: list[int], bits=None) -> DataFrame:
    """(ids, h, place, size, slotted, slots) of windows (slotted: as a template); with bits only of those that the bitmap has. Items: each its own size."""
    schema = ", ".join(f"{c} long" for c in ids) + ", h long, place int, size int, slotted boolean, slots array<string>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        on = bits.value if bits is not None else None
        for batch in batches:
            texts = C.blobs(batch["text"])
            columns = [batch[k].to_pylist() for k in ids]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            for i, j in C.groups(offs):
                split = [x.split() for x in texts[i:j]]
                words = list(chain.from_iterable(split))
                at = np.concatenate([[0], np.cumsum([len(x) for x in split])])
                own = np.minimum(np.diff(at), WINDOW)
                t, same = numbers.of(words)
                t = with_units(t, at)
                lines = [line_starts(x) for x in texts[i:j]] if on is not None and min(sizes, default=LEAST) < LEAST else None
                rows: list[list] = [[] for _ in range(5 + len(ids))]
                for size in sizes:
                    place, doc, h, templates = windows(at, t, same, size)
                    if on is None:
                        ok = own[doc] == size
                    else:
                        cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
                        ok = (on[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                        if size < LEAST:
                            ok &= np.fromiter((lines[d].get(p) == size for d, p in zip(doc.tolist(), (place - at[doc]).tolist())), bool, len(doc))
                    for p, d, x, slotted in zip(place[ok].tolist(), doc[ok].tolist(), h[ok].view(np.int64).tolist(), templates[ok].tolist()):
                        for c, k in zip(rows, columns):
                            c.append(k[i + d])
                        for c, v in zip(rows[-5:], (x, p - int(at[d]), size, slotted)):
                            c.append(v)
                        rows[-1].append([core(words[q]) for q in range(p, p + size) if t[q] < 16] if slotted else [])
                kinds = [pa.int64()] * len(ids) + [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [*ids, "h", "place", "size", "slotted", "slots"])

    return docs.mapInArrow(each, schema)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """CELLS bits, set for these hashes (column h); filled on the executors."""
    cells = hashes.select((F.col("h").bitwiseAND(CELLS - 1)).alias("cell")).distinct().withColumn("shard", F.expr(f"cast(cell div {SHARD} as int)"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])
        for batch in batches:
            for shard, cell in zip(batch["shard"].to_pylist(), batch["cell"].to_pylist()):
                if shard != now:
                    if now is not None:
                        yield pack()
                    now, seen = shard, np.zeros(SHARD, bool)
                seen[cell % SHARD] = True
        if now is not None:
            yield pack()

    out = np.zeros(CELLS // 8, np.uint8)
    for shard, bits in cells.repartition(C.tasks(hashes.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(each, "shard int, bits binary").collect():
        out[shard * (SHARD // 8) : (shard + 1) * (SHARD // 8)] = np.frombuffer(bits, np.uint8)
    return out


def _same(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The join by equal columns, nulls included, which are there once."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c.endswith("_id") else F.col(c) == F.col(f"_{c}") for c in columns]
    return left.join(other, on).drop(*(f"_{c}" for c in columns))


def weighed(theirs: DataFrame) -> DataFrame:
    """The windows of items with the weight of their place, the sums of it over the item's places (total) and over those with a
    template (of_templates), and whether they are among the rarest, by which pairs are looked for."""
    item = ["item_id", "item_row"]
    spread = theirs.groupBy("h").agg(F.count_distinct("item_row").alias("items"))
    known = theirs.join(spread, "h")
    at = Window.partitionBy(*item, "place")
    known = known.withColumn("weight", F.max(F.expr(f"if(slotted, 0, greatest(1, {WEIGHT} div items))")).over(at)).withColumn("reach", F.max("items").over(at))
    last = Window.partitionBy(*item).orderBy(F.desc("reach"), F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of_kind = Window.partitionBy(*item, "slotted")
    last_template = of_kind.orderBy(F.desc("items"), F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # each place has one window as it is, so these add up every place once
    once = F.when(~F.col("slotted"), F.col("weight")).otherwise(0)
    sums = {
        "total": F.sum(once).over(Window.partitionBy(*item)), "of_templates": F.sum(F.when(F.col("slotted"), F.col("weight")).otherwise(0)).over(Window.partitionBy(*item)),
        "left": F.sum(once).over(last), "left_templates": F.sum("weight").over(last_template),
    }
    known = known.withColumns(sums)
    by_template = F.col("slotted") & (F.col("of_templates") >= COVERAGE * F.col("total")) & (F.col("left_templates") >= COVERAGE * F.col("of_templates"))
    return known.withColumn("rare", (F.col("left") >= COVERAGE * F.col("total")) | by_template).drop("left", "left_templates", "reach", "items")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, matched, n_windows, coverage, reparameterised) of documents and the items that they hold; row is a
    hash of the text. reparameterised: some slot's value differs."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    docs = docs.filter("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    items = items.filter("text <> ''").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_row"), "text").dropDuplicates(["item_id", "item_row"])
    theirs = C.stored(_found(items, ["item_id", "item_row"], list(range(1, WINDOW + 1))), "windows")
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # WINDOW values at most
    bits = spark.sparkContext.broadcast(bitmap(theirs))
    mine = C.stored(_found(docs, ["doc_id", "row"], sizes, bits).drop("size", "slotted").withColumnsRenamed({"place": "doc_place", "slots": "doc_slots"}), "hits")
    weights = C.stored(weighed(theirs), "weights")
    n = weights.groupBy("item_id", "item_row").agg(F.count_distinct("place").alias("n_windows"), F.max("total").alias("total"), F.max("of_templates").alias("of_templates"))
    of_item, of_doc = ("item_id", "item_row"), ("doc_id", "row")
    candidates = mine.select("doc_id", "row", "h").distinct().join(weights.filter("rare").select(*of_item, "h").distinct(), "h").select(*of_doc, *of_item).distinct()
    compared = _same(candidates, weights.select(*of_item, "h", "place", "slotted", "slots", "weight"), of_item)
    pairs = _same(compared, mine, (*of_doc, "h")).filter("size(slots) = size(doc_slots)").withColumn("diagonal", F.col("doc_place") - F.col("place"))
    pairs = pairs.withColumn("slots", F.expr("arrays_zip(slots, doc_slots)")).withColumn("place", F.struct("place", "weight"))
    key = ["doc_id", "row", "item_id", "item_row"]
    lines = pairs.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("slotted"), F.col("place"))).alias("templates"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    lines = lines.filter("size(slots) = size(array_distinct(slots.slots))").withColumn("changed", F.expr("exists(slots, x -> x.slots <> x.doc_slots)"))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    weight = lambda c: F.aggregate(F.array_distinct(F.flatten(F.collect_list(c))), F.lit(0).cast("long"), lambda a, x: a + x.weight)
    sums = lines.groupBy(*key).agg(distinct("places").alias("matched"), weight("places").alias("weight"), weight("templates").alias("weight_templates"), F.every("changed").alias("reparameterised"))
    both = sums.alias("s").join(n.alias("n"), F.expr("s.item_id <=> n.item_id and s.item_row = n.item_row"))
    # of all windows, or of those that are templates (if these tell enough of the item), whichever is more
    coverage = F.greatest(F.col("s.weight") / F.col("n.total"), F.when(F.col("n.of_templates") >= COVERAGE * F.col("n.total"), F.try_divide(F.col("s.weight_templates"), F.col("n.of_templates"))))
    both = both.select("s.doc_id", "s.row", "s.item_id", "s.matched", "n.n_windows", coverage.alias("coverage"), "s.reparameterised")
    return both.filter(F.col("coverage") >= COVERAGE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("row")
