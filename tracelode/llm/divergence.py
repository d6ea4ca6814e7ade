"""How the sources of a language differ in their words: a plain relational audit.

A term is a match of TERM, with A to Z in lower case. Each language keeps the V terms that at least LEAST of its documents have. A
group is a language's source; each group, and each language as a whole, gives each kept term the smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where N is its number of occurrences of kept terms. Two shares differ by
f = floor((p - q)^2 / (p + q)).

`pair` rows: for each group all other sources of its language, with f summed over the kept terms. `term` rows: for each group the TOP
terms that it has more often than its language as a whole, with their f.

How it is distributed: occurrences are counted before they are shuffled, by language, source and term. What belongs to a language or a
group is joined to terms by the language and a salt of the term, so that a language with most of the rows is many tasks'. The kept
vocabulary times the groups of its language fills in zeros; these cells are shuffled once, by language and term, added up there with
the counts, and joined with themselves in the same partitions: a key has one row per source. Sums over terms begin inside tasks, so
that only pairs of sources are shuffled. The driver sees nothing.

Cases: null text, lang and source are ''. A group without kept terms still has a share of each; a language that keeps none gives pairs
with value 0 and no terms. Repeated rows are documents each, also under one doc_id. Equal values rank by item, in UTF-8 order. An empty
table gives no rows; other columns are ignored. Shares are exact for counts up to 10^18.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm import common as C

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same characters, said by what they are, of texts whose letters A to Z are in lower case; Java is ten times faster at these.
LETTERS = r"[a-z\x{80}-\x{10FFFF}]+"
LEAST, TOP, UNIT, SMOOTH = 10, 10, 1_000_000_000, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    rows = docs.select("lang", "source", terms.alias("terms"))
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("docs")))
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("docs")))
    # "outer", since Spark would else find all terms once more, to leave out texts without any before they are exploded
    exploded = rows.select("lang", "source", F.inline_outer(F.concat(once, each))).filter(F.col("term").isNotNull())
    return exploded.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, denominator: str) -> Column:
    """1 + floor(UNIT (n + SMOOTH) / denominator), in decimals, since the product has more than 64 bits."""
    return F.expr(f"1 + (cast({UNIT} AS decimal(10, 0)) * cast({n} + {SMOOTH} AS decimal(20, 0))) div cast({denominator} AS decimal(20, 0))")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def by_term(terms: DataFrame, other: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """terms joined with what `other` has for the columns `on`, dealt out by terms too: each row of `other` goes to every salt."""
    salts = C.tasks(terms.sparkSession)
    left = terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows (lang, source, part, item, value) with rank, in groups and parts."""
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank; see the module."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = counted(rows)
    of_lang = Window.partitionBy("lang", "term")
    kept = counts.withColumn("docs", F.sum("docs").over(of_lang)).withColumn("all", F.sum("n").over(of_lang)).filter(F.col("docs") >= least)
    kept = C.stored(kept.select("lang", "source", "term", "n", "all"), "kept")

    vocabulary = kept.select("lang", "term").distinct()
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = langs.join(sums.groupBy("lang").agg(F.sum("n").alias("n_lang")), "lang")
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left")
    # v is null where nothing is kept
    groups = groups.select("lang", "source", "v", (F.coalesce("n", F.lit(0)) + SMOOTH * F.col("v")).alias("d"), (F.col("n_lang") + SMOOTH * F.col("v")).alias("d_lang"))
    groups = C.stored(groups, "groups")

    cells = by_term(kept, groups, ("lang", "source")).withColumn("p", share("n", "d")).withColumn("q", share("all", "d_lang"))
    terms = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))

    zeros = by_term(vocabulary, groups.select("lang", "source", "d"), ("lang",)).select("lang", "term", "source", F.lit(0).cast("long").alias("n"), "d")
    filled = zeros.unionByName(kept.select("lang", "term", "source", "n", F.lit(None).cast("long").alias("d"))).repartition(C.tasks(docs.sparkSession), "lang", "term")
    dense = filled.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.max("d").alias("d")).select("lang", "term", "source", share("n", "d").alias("p"))
    # f is the same both ways round
    pairs = dense.alias("a").join(dense.alias("b").hint("merge"), ["lang", "term"]).filter("a.source < b.source")
    added = pairs.select("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), difference("a.p", "b.p").alias("f")).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    none = groups.filter("v IS NULL").select("lang", "source")
    added = added.unionByName(none.select("lang", F.col("source").alias("a")).join(none.select("lang", F.col("source").alias("b")), "lang").filter("a < b").withColumn("value", F.lit(0).cast("long")))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    both = added.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(both).unionByName(ranked(terms, top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')), '{UPPER}', '{LOWER}') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n FROM z GROUP BY ALL),
p AS (SELECT z.lang, z.source, z.term, z.n, CAST(1 + {UNIT}::HUGEINT * (z.n + {SMOOTH}) // (s.n + {SMOOTH} * l.v) AS HUGEINT) AS p, CAST(1 + {UNIT}::HUGEINT * (z.n_lang + {SMOOTH}) // (l.n + {SMOOTH} * l.v) AS HUGEINT) AS q
 FROM z JOIN s USING (lang, source) JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
