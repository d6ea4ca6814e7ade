"""Connected components of links between long keys: each task joins up the links that it has and hands on only stars, and what
several tasks have of a component is joined by alternating large-star and small-star rounds, each stored in the shared folder.
Nothing but a count per round reaches the driver; hubs are aggregated before they are shuffled. Repeated links, links of a key to
itself and null keys (which link nothing) are left out; without links there are no rows.

A round is a plan of six exchanges, of which the driver keeps more (threads, plans, events) than of the links; most tables of links
are joined up by the tasks alone, and need none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import common as C

#: Links that a task gathers before it joins them up.
GATHERED = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of these links but the roots, which are the least keys of their components."""
    keys, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(keys))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    others = np.flatnonzero(root != np.arange(len(keys)))
    return keys[others], keys[root[others]]


def _joined_up(links: DataFrame) -> DataFrame:
    """Stars of what each task has of the links (u, v)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, more, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            more.append((batch["u"].to_numpy(zero_copy_only=False), batch["v"].to_numpy(zero_copy_only=False)))
            n += len(batch)
            if n >= max(GATHERED, len(u)):
                u, v = stars(*(np.concatenate(x) for x in zip((u, v), *more)))
                more, n = [], 0
        u, v = stars(*(np.concatenate(x) for x in zip((u, v), *more)))
        for i in range(0, len(u), C.BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + C.BATCH_ROWS]), pa.array(v[i : i + C.BATCH_ROWS])], ["u", "v"])

    return links.mapInArrow(each, "u long, v long")


def _hooked(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("key", C.own_key("u")).drop("u")
    return pairs.withColumn("key", C.own_key("u")).join(least, "key").select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _hooked(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hooked = _hooked(down)
    return hooked.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()


def _unsettled(pairs: DataFrame) -> int:
    """Keys with two roots, with a root and nodes of their own, or listed twice, of pairs (u, v) with u > v; stars have none."""
    roles = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root"), F.lit(1).alias("listed")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"), F.lit(0).alias("listed")))).alias("e")).select("e.*")
    return roles.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("listed").alias("n")).filter("a <> b or n > 1").count()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs -> (node, root) of every linked node but the roots: root is the least key that it reaches."""
    spark = links.sparkSession
    C.bounded_batches(spark)
    C.tidy(spark)
    now = C.stored(_joined_up(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "links")
    C.tidy(spark)
    while _unsettled(now):
        nxt = C.stored(_round(now), "links")
        C.drop_stored(now)
        now = nxt
        C.tidy(spark)
    C.tidy(spark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
