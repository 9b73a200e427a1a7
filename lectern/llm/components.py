"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) on DataFrames. Each round is two
grouped minima and two joins; the number of rounds grows with the logarithm of
the longest chain. Before the first round the edges of a node meet, and every
batch replaces its edges by a spanning forest, which is what it can add at most. Lineage is cut with
``checkpoint()`` in the shared folder, so a lost executor costs a task, not a
round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import width

_SCHEMA = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: edges (node, least node of its tree)."""
    for b in batches:
        u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(u):
            continue
        names, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = forest_roots(len(names), flat[: len(u)], flat[len(u) :])
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["u", "v"])


def forest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, by repeated hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


#: A node with more than this share of the edges (and ``LEAST`` of them) is a hub. There are at most 2 / SHARE hubs.
SHARE, LEAST = 0.001, 1000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its least node."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def large_star(e: DataFrame, hubs: list[int]) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if hubs:  # their edges stay where they are; of the others, a node's meet in one task
            at_hub = F.col("u").isin(hubs)
            rows, rest = both.filter(at_hub), both.filter(~at_hub)
            linked = rest.join(least(rest), "u").union(rows.join(F.broadcast(least(rows)), "u"))
        else:
            linked = both.join(least(both), "u")
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(down)
        return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    at = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    at = at.repartition(width(at), "u").mapInArrow(_forest, _SCHEMA).distinct().checkpoint()
    seen = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == seen:
            break
        seen = tuple(now)
        hubs = at.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").count().filter(F.col("count") > max(LEAST, SHARE * now[0])).select("u").collect()
        at = small_star(large_star(at, [r["u"] for r in hubs])).checkpoint()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
