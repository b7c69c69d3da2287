"""Connected components of an edge table: forests of its parts, and alternating large and small stars beyond a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

ship(__name__)

#: Edges that a task takes from parts' forests; it holds the forest of what it has read and BATCH edges more.
TASK_EDGES, BATCH = 1 << 20, 1 << 18


def _contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least one. Every round at least halves the roots that aren't least."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    some = np.flatnonzero(root != np.arange(len(ids)))
    return ids[some], ids[root[some]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, n = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += len(us[-1])
        if n >= BATCH:
            u, v = _contract(np.concatenate(us), np.concatenate(vs))
            us, vs, n = [u], [v], 0
    if us:
        u, v = _contract(np.concatenate(us), np.concatenate(vs))
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], names=["u", "v"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _stars(edges: DataFrame) -> DataFrame:
    """Rounds grow with the logarithm of a component's size. Both sides of the joins are plain shuffles, so that adaptive execution can split a hub's edges by their bytes."""
    now = materialise(edges.distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns u, v: each node but the least of its component, and that least one.

    Each partition's edges become a forest of at most one edge a node; forests
    are put together in fewer and fewer tasks as long as a task gets TASK_EDGES
    edges at most and the tasks halve at least. Forests too large for that go on
    as stars. Nothing but counts and a checksum reaches the driver, and nothing
    is broadcast: it would build and keep each table."""
    schema = "u long, v long"
    now = materialise(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forest, schema))
    parts = now.rdd.getNumPartitions()
    while parts > 1:
        n = now.count()
        fewer = max(1, -(-n // TASK_EDGES))
        if 2 * fewer > parts:
            return _stars(now)
        now, parts = materialise(now.coalesce(fewer).mapInArrow(_forest, schema)), fewer
    return now
