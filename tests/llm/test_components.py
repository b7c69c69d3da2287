"""Connected components and what near duplicates send to the driver."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, jaccard
from lodestar.llm.common import table


def least_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize(("task_edges", "batch"), [(1 << 20, 1 << 18), (1000, 16), (1, 1)])
def test_components_by_forests_and_by_stars(spark, monkeypatch, task_edges, batch):
    """A chain in any order, a hub, random edges, loops and repeats; put together in one task, in two steps, and by stars."""
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    monkeypatch.setattr(components, "BATCH", batch)
    rnd = random.Random(4)
    ids = rnd.sample(range(-(10**12), 10**12), 300)
    edges = list(zip(ids, ids[1:], strict=False)) + [(7 * 10**12, 8 * 10**12 + k) for k in range(300)]
    edges += [(10**13 + rnd.randrange(300), 10**13 + rnd.randrange(300)) for _ in range(200)] + [(5, 5)]
    edges += edges[:50]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(8)
    assert Counter(tuple(r) for r in components.components(df).collect()) == Counter(least_of(edges).items())
    assert components.components(df.where("u = v")).count() == 0


def test_near_duplicates_broadcast_little(spark, monkeypatch):
    """The driver builds and keeps each broadcast: only what texts are joined to is broadcast beyond SMALL bytes."""
    docs, calls, mark = table(spark, "/root/testdata/sf0.001", "documents"), [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: calls.append(df.columns) or mark(df))
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = rows(jaccard.one_of_each(docs))
    assert len(calls) <= 11
    calls.clear()
    monkeypatch.setattr(jaccard, "SMALL", -1)  # empty tables too
    assert rows(jaccard.one_of_each(docs)) == kept and calls == [["_some"], ["_d", "_t", "_repeats"]]
