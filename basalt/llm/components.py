"""Connected components of a table of links: forests of bounded parts, then alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, hot_keys, written

#: Links a task reduces to a forest at once.
PART = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of every node that is not the least of its component."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def contracted(edges: DataFrame, n: int, part: int) -> DataFrame:
    """edges (n rows) with those of each part replaced by links of its nodes to the least they reach in it.

    Tasks take about part rows each, and reduce at most part at a time beside the forest they hold, which is emitted
    once it has part links; if n is at most part there is one task, whose forest is the whole graph's.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        waiting: list[pa.RecordBatch] = []

        def reduce() -> None:
            u, v = (np.concatenate([h, *(x.column(c).to_numpy() for x in waiting)]) for h, c in zip(held, "uv", strict=True))
            held[:] = forest(u, v)
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(x.num_rows for x in waiting) >= part:
                reduce()
                if len(held[0]) > part:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["u", "v"])
                    held[:] = [np.zeros(0, np.int64)] * 2
        reduce()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["u", "v"])

    return edges.coalesce(-(-n // part)).mapInArrow(work, "u long, v long")


def components(links: DataFrame, rounds: int = 60, part: int = PART) -> DataFrame:
    """(node, component): the least node that each node of links (columns a, b) reaches.

    Nulls and links of a node to itself are passed over; repeated links count once; nodes without links have no row.
    A round replaces the links of each part by a forest; where there are several parts, stars then join these: every
    step of theirs is an aggregation and a join by node; a hub's links are spread over tasks.  Each step is a written
    table, so nothing is held in one place but a part.
    """
    edges = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("a <> b").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    for _ in range(rounds):
        if not (n := state[0]):
            break
        edges = written(contracted(edges, n, part), "forests")
        if n <= part:
            break
        edges = edges.distinct()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = hot_join(both.where("v > u"), least.select("u", "m"), ["u"], hot_keys(least, "u", 2 * n)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's smaller neighbours are the least of as many nodes, each seen from its other neighbours
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = written(small, "small-star")
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
