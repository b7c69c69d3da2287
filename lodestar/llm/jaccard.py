"""N-gram Jaccard join: documents whose sets of five-word shingles are at least 0.8 alike.

MinHash LSH forest. A signature has TREES keys of FULL_DEPTH minima; the sorted
keys of a tree are a trie, and the texts below one of its nodes share a prefix.
All texts search at full depth first. Of the trees in which a text has company
at a depth, k of TREES, its recall is estimated as 1 - (1 - k/TREES)^TREES, the
chance that its partners would be met in one tree at least; texts below the
target shorten their prefix by a level and search again among all texts, down
to the last of LEVELS (depth 3), where a pair at the threshold is missed with
probability (1 - threshold^3)^TREES, 1 in 100,000. Texts that met are connected and
verified exactly, in blocks of a component, banded by the number of shingles, so
that no group meets in one task.

Texts of equal shingle sets are one node, keyed by a 128-bit digest of the set,
whatever their ids; it carries a number of copies. Shingles are compared by
64-bit digests.

Cases. Rows are judged by their texts: rows that share a doc_id, repeat, or
have none keep the links of their own text. A class is named by its least
doc_id, null if no row of it has one. Null, empty and blank texts have no
shingles and no links; a text of one to four words is one shingle. Very long
texts are hashed whole; blocks are bounded by shingles too. Pairs exactly at
the threshold are links. No rows: no result. Columns beside doc_id and text
don't matter to join(), and one_of_each() returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, counted, materialise, numbered, same, ship, text_digest
from .components import components

ship(__name__)

WIDTH, THRESHOLD = 5, 0.8
#: Trees, minima of a key, depths searched, and the recall at which a text stops shortening.
TREES, FULL_DEPTH, LEVELS, RECALL = 16, 8, (8, 6, 4, 3), 0.9999
#: Distinct texts of a block, and their shingles; a task verifies two blocks, so long texts don't raise its memory.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Bytes up to which a table is broadcast to rows without texts. Beyond, both sides are shuffled: they are numbers and digests, while the driver builds every broadcast and keeps it until its garbage is collected.
SMALL = 4 << 20

_SPLIT = re.compile(f"[{SPACE}]+")
_P = np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    """Digests of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, digests: dict, width: int = WIDTH) -> np.ndarray:
    """The sorted digests of the distinct shingles."""
    words = [w for w in _SPLIT.split(text or "") if w]
    w = np.fromiter(map(digests.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1) if len(w) else 0
    h = np.full(n, np.uint64(min(len(w), width)))
    for k in range(min(width, len(w))):
        h = _mix(h * _P + w[k : k + n])
    return np.unique(h)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def forest(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The keys of all trees: of each permutation's least shingle two bytes, in the order of trees and depths."""
    least = np.full(len(a), np.uint32(2**32 - 1))
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        y = x[at : at + 512, None] ^ b[None, :]
        y *= a[None, :]
        np.minimum(least, y.min(axis=0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, width: int = WIDTH, trees: int = TREES, depth: int = FULL_DEPTH) -> DataFrame:
    """doc_id, text_id (a digest of the text), n_shingles, k1, k2 (a 128-bit digest of the shingle set; null without shingles), forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digests, (a, b) = _Digests(), _permutations(trees * depth)
        for batch in batches:
            n, k1, k2, out = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), digests, width)
                n.append(len(s))
                d = xxhash.xxh128_digest(s.tobytes()) if len(s) else None
                k1.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
                k2.append(int.from_bytes(d[8:], "little", signed=True) if d else None)
                out.append(forest(s, a, b) if d else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "text_id", "n_shingles", "k1", "k2", "forest"])

    rows = docs.select("doc_id", text_digest(F.col("text")).alias("text_id"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_id string, n_shingles long, k1 long, k2 long, forest binary")


def met(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = FULL_DEPTH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Edges u, v between texts that share a node of the forest: reps has rep and forest; a node's members are tied to its least."""
    tree = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("forest", t * (2 * depth) + 1, F.lit(2 * depth)).alias("key")))
    keys = reps.select("rep", F.explode(tree).alias("x")).select("rep", "x.*")
    # The trees with company that estimate the target recall; a text stays in the tries for others when it has stopped.
    enough = next(k for k in range(1, trees + 1) if 1 - (1 - k / trees) ** trees >= recall)
    edges, done = None, None
    for d in levels:
        at = keys.select("rep", F.xxhash64("tree", F.substring("key", 1, 2 * d)).alias("node"))
        size = F.count(F.lit(1))
        if done is None:
            nodes = at.groupBy("node").agg(size.alias("n"), F.min("rep").alias("least")).where("n > 1")
        else:
            at = at.join(done, at["rep"] == done["_done"], "left").select("rep", "node", F.col("_done").isNull().alias("open"))
            nodes = at.groupBy("node").agg(size.alias("n"), F.min("rep").alias("least"), F.max("open").alias("open")).where("n > 1 and open")
        nodes = counted(nodes.select("node", "least"), size=SMALL)
        members = materialise(at.select("rep", "node").join(nodes, "node"))
        tied = members.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
        edges = tied if edges is None else edges.unionByName(tied)
        if d == levels[-1]:
            break
        stop = members.groupBy("rep").agg(size.alias("k")).where(F.col("k") >= enough).select(F.col("rep").alias("_done"))
        done = stop if done is None else done.unionByName(stop).distinct()
        done = counted(done, size=SMALL)
    return edges


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of left (numbers of sets) are at the threshold with which of right: overlaps counted by products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    column, owner = renumber[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both, step = np.zeros((len(left), len(right)), np.float32), 1 << 12
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m[left] @ m[right].T
    return both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6


def _verify(width: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _Digests()
        sets = [shingles(t, digests, width) for t in pdf["text"]]
        side, i, j = pdf["side"].to_numpy(), pdf["i"].iat[0], pdf["j"].iat[0]
        left = np.flatnonzero(side == i)
        right = np.flatnonzero(side == j) if i != j else left
        copies, reps = pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        if len(left) and len(right):
            linked = _linked(sets, left, right, threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            links[left] += linked @ copies[right]
            if i != j:
                links[right] += linked.T @ copies[left]

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(*np.nonzero(linked), strict=True):
                p, q = find(left[x]), find(right[y])
                if p != q:
                    p, q = (p, q) if reps[p] < reps[q] else (q, p)
                    root[q] = p
            root = np.array([find(x) for x in range(len(sets))])
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": reps[some], "links": links[some], "root": reps[root[some]]}, columns=["rep", "links", "root"])

    return run


def _blocks(member: DataFrame, threshold: float) -> DataFrame:
    """member (rep, comp, size) with side (its block), and others (the blocks to verify it against).

    Sizes of linked texts differ by the threshold at most, so blocks are made
    within bands of sizes, and a band meets only itself and its neighbours."""
    member = member.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(-float(np.log(threshold)))).cast("int"))
    bands = materialise(member.groupBy("comp", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    near = bands.select("comp", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct(F.col("band").alias("of"), "blocks").alias("x"))
    near = near.groupBy("comp", "band").agg(F.collect_list("x").alias("near"))  # three entries at most
    near = bands.join(near, ["comp", "band"])
    member = member.join(counted(near, size=SMALL), ["comp", "band"])  # a row a band: texts of one component stay where they are
    side = F.struct("band", F.expr("cast(pmod(xxhash64(rep), blocks) as int)").alias("k"))
    others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: F.struct(x["of"].alias("band"), k.alias("k")))))
    return member.select("rep", "comp", "copies", "text_id", side.alias("side"), others.alias("others"))


def _classes(docs: DataFrame, sigs: DataFrame, width: int, threshold: float, recall: float, trees: int) -> DataFrame:
    """One row a distinct shingle set: k1, k2, copies, links, class (the rep that names its class)."""
    reps = sigs.where("n_shingles > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("text_id").alias("text_id"), F.first("n_shingles").alias("size"), F.first("forest").alias("forest"))
    # The ids are fixed by being written.
    reps = materialise(materialise(reps).withColumn("rep", F.monotonically_increasing_id()))
    near = components(met(reps.select("rep", "forest"), threshold, recall, trees))
    member = near.unionByName(near.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    member = materialise(_blocks(member.join(reps.select("rep", "copies", "size", "text_id"), "rep"), threshold))
    # The texts that have met, once each: only a hash of their digests is sent to all texts.
    some = counted(member.select(F.xxhash64("text_id").alias("_some")).distinct())
    texts = docs.select(text_digest(F.col("text")).alias("text_id"), "text").join(some, F.xxhash64("text_id") == F.col("_some"), "left_semi")
    texts = texts.groupBy("text_id").agg(F.first("text").alias("text")).join(member, "text_id")
    pairs = texts.withColumn("other", F.explode("others"))
    pairs = pairs.select("comp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "copies", "text")
    name = lambda c: F.concat_ws(":", F.col(f"{c}.band"), F.col(f"{c}.k"))
    pairs = pairs.select("comp", name("i").alias("i"), name("j").alias("j"), name("side").alias("side"), "rep", "copies", "text")
    found = materialise(pairs.groupBy("comp", "i", "j").applyInPandas(_verify(width, threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"u": "_u", "v": "_v"})
    links = links.withColumnRenamed("rep", "_rep")
    full = reps.select("k1", "k2", "rep", "copies").join(links, F.col("rep") == F.col("_rep"), "left").join(named, F.col("rep") == F.col("_u"), "left")
    return full.select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("_v", "rep").alias("class"))


def _joined(docs: DataFrame, width: int, threshold: float, recall: float, trees: int) -> DataFrame:
    """doc_id, text_id, n_shingles, class (null without shingles), n_links."""
    sigs = materialise(signatures(docs, width, trees))
    full = _classes(docs, sigs, width, threshold, recall, trees)
    # Only sets with company need looking up; that of a text without any is itself.
    some = counted(full.where("copies > 1 or links > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "class", (F.col("copies") - 1 + F.col("links")).alias("n_links")), size=SMALL)
    out = sigs.select("doc_id", "text_id", "n_shingles", "k1", "k2").join(some, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return materialise(out.select("doc_id", "text_id", "n_shingles", "k1", "k2", "class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """One row a row of docs: doc_id, class_id (the least doc_id that links lead to), n_links (rows at the threshold or over, copies too), copy_id (the least doc_id of its copies), n_shingles."""
    rows = _joined(docs, width, threshold, recall, trees)
    # Classes of a single text need no name from elsewhere.
    met_any = rows.where("class is not null")
    names = counted(met_any.groupBy("class").agg(F.min("doc_id").alias("class_id")).withColumnRenamed("class", "_class"), size=SMALL)
    copies = counted(met_any.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), size=SMALL)
    rows = rows.join(names, F.col("class") == F.col("_class"), "left").join(copies, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    alone = F.col("class").isNull()
    named = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c))
    return rows.select("doc_id", named("class_id").alias("class_id"), "n_links", named("copy_id").alias("copy_id"), "n_shingles")


def _place(doc_id: Column, text_id: Column) -> Column:
    """The order in which a class's rows stand: by doc_id, those without one last."""
    return F.struct(doc_id.isNull().alias("_none"), doc_id.alias("_id"), text_id.alias("_text"))


def one_of_each(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """The rows of docs with one row of each class: that of the least doc_id (rows without one last). Texts without shingles stay."""
    rows = _joined(docs, width, threshold, recall, trees).where("class is not null")
    kinds = rows.groupBy("class", "doc_id", "text_id").agg(F.count(F.lit(1)).alias("_rows"))
    kinds = materialise(kinds.withColumn("_place", _place(F.col("doc_id"), F.col("text_id"))))
    best = kinds.groupBy("class").agg(F.min("_place").alias("_best")).withColumnRenamed("class", "_class")
    kinds = kinds.join(best, F.col("class") == F.col("_class"))
    wins = F.col("_place") == F.col("_best")
    key = [F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")]
    # Rows that go, and those that repeat a row that stays.
    marked = counted(kinds.where(~wins | (F.col("_rows") > 1)).select(*key, wins.alias("_repeats")))
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    fits = F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (text_digest(F.col("_row.text")) == F.col("_t"))
    kept = whole.join(marked, fits, "left")
    out = kept.where("_t is null").select("_row.*")
    if marked.where("_repeats").isEmpty():
        return out
    again = numbered(kept.where("_repeats").select("_row", "_d", "_t"), ["_d", "_t"]).where("_nth = 0")
    return out.unionByName(again.select("_row.*"))
