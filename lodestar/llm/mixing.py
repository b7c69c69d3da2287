"""Mixing sources to target weights.

Temperature mixing: a source's share of the tokens is raised to an exponent
between 0 (all sources alike) and 1 (as they come). The exponent is bisected
to the largest that meets a target entropy, or the smallest that keeps every
source within a limit of repetitions. Weights become whole token quotas of a
block; each block takes its quota from each source, in an order that is a fresh
permutation of the source in every epoch.

Equal rows (source, doc_id and text) are one row with a count until the end, so
that a source of repeated rows meets in no task.

Cases. A null source is a source of its own. A document without words (null,
empty, blank) counts as one token, so that no block is unbounded; a null text
counts as an empty one. Very long texts are counted whole and only their digest
is moved. Equal rows follow each other in a permutation, and other ties are
broken by doc_id and tokens. No rows: no plan, no output. Columns beside doc_id,
source and text don't matter to mix(); mixed_rows() returns them as they are,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialise, n_words, numbered, running_totals, same, text_digest

STEPS = 50
#: Exponents tried in one pass over the sources, and passes, for a target entropy; equal rows that one task writes.
TRIED, PASSES, CHUNK = 31, 10, 10_000
_ROW = ["doc_id", "source", "text_id", "tokens"]


def token_table(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_id, tokens and n (equal rows), materialised: the texts are read once."""
    text = F.col("text")
    rows = docs.select("doc_id", "source", text_digest(text).alias("text_id"), F.greatest(n_words(text), F.lit(1).cast("long")).alias("tokens"))
    return materialise(rows.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n")))


def _bisect(extremes: DataFrame, max_repeats: float) -> Column:
    """The smallest exponent e with (most / least) ** (1 - e) <= max_repeats, of a row with most and least."""

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        good = F.pow(F.col("_most") / F.col("_least"), 1 - mid) <= F.lit(float(max_repeats))
        return F.struct(F.when(good, a["lo"]).otherwise(mid).alias("lo"), F.when(good, mid).otherwise(a["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["hi"])


def _entropic(shares: DataFrame, entropy_share: float) -> float:
    """The largest exponent whose weights have this share of the highest entropy; each pass narrows it to a 32nd, so any number of sources will do."""
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        tried = [lo + (hi - lo) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        z = [F.sum(F.pow("p", F.lit(e))).alias(f"z{k}") for k, e in enumerate(tried)]
        logs = [F.sum(F.pow("p", F.lit(e)) * F.ln("p") * e).alias(f"l{k}") for k, e in enumerate(tried)]
        row = shares.agg(F.count(F.lit(1)).alias("n"), *z, *logs).first()
        if not row["n"]:
            return 0.0
        # The entropy of p**e / z is ln z - sum(p**e ln p**e) / z.
        good = [e for k, e in enumerate(tried) if math.log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"] >= entropy_share * math.log(row["n"])]
        width = (hi - lo) / (TRIED + 1)
        lo = max(good, default=lo)
        hi = min(hi, lo + width)
    return lo


def plan(tokens: DataFrame, max_repeats: float | None = 2.0, entropy_share: float | None = None, block_tokens: int = 65_536, budget_tokens: int | None = None) -> DataFrame:
    """One row a source: source, tokens, weight, exponent, quota (tokens of a block), total (tokens of the budget).

    Give either max_repeats (times that any source may be seen, the largest
    source being seen once) or entropy_share (target entropy over the log of
    the number of sources). budget_tokens None: the least budget at which every
    source is seen at least once, so that nothing is left out. Sources are
    rows throughout, of any number; one row of totals is joined to them."""
    if (max_repeats is None) == (entropy_share is None):
        raise ValueError("give one of max_repeats and entropy_share")
    by = materialise(tokens.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens")))
    one = by.agg(F.sum("tokens").alias("_all"), F.max("tokens").alias("_most"), F.min("tokens").alias("_least"))  # one row
    rows = by.join(F.broadcast(one), how="left").withColumn("p", F.col("tokens") / F.col("_all"))
    if entropy_share is None:
        one = one.select(*one.columns, _bisect(one, max_repeats).alias("exponent"))
        rows = by.join(F.broadcast(one), how="left").withColumn("p", F.col("tokens") / F.col("_all"))
    else:
        rows = rows.withColumn("exponent", F.lit(_entropic(materialise(rows.select("p")), entropy_share)))
    rows = materialise(rows.withColumn("_raised", F.pow("p", "exponent")))
    z = rows.agg(F.sum("_raised").alias("_z"), F.max(F.col("tokens") / F.col("_raised")).alias("_least_budget"))  # one row
    rows = rows.join(F.broadcast(z), how="left").withColumn("w", F.col("_raised") / F.col("_z"))
    rows = rows.withColumn("budget", F.lit(float(budget_tokens)) if budget_tokens else F.col("_least_budget") * F.col("_z"))
    return materialise(rows.select(
        "source", "tokens",
        F.round("w", 9).alias("weight"),
        F.round("exponent", 9).alias("exponent"),
        F.greatest(F.round(F.col("w") * block_tokens), F.lit(1)).cast("long").alias("quota"),
        F.round(F.col("w") * F.col("budget")).cast("long").alias("total"),
    ))


def order_key(seed: int, epoch: Column, doc_id: Column, text_id: Column) -> Column:
    """The place of a row in the permutation of this epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_id))


def _epochs(tokens: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Equal rows once for each epoch that their source is seen in: _all, quota, total, epoch, _key, _at (their place on the source's axis of tokens)."""
    p = counted(planned.select("source", F.col("tokens").alias("_all"), "quota", "total"))
    rows = same(tokens, p, ["source"])
    last = F.expr("greatest(0, cast(ceil(total / _all) as bigint) - 1)")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("_key", order_key(seed, F.col("epoch"), F.col("doc_id"), F.col("text_id"))).withColumn("_size", F.col("tokens") * F.col("n"))
    rows = running_totals(rows, ["source", "epoch"], "_key", ["doc_id", "tokens"], {"_size": "_before"})
    rows = rows.withColumn("_at", F.col("epoch") * F.col("_all") + F.col("_before")).where(F.col("_at") < F.col("total"))
    # Of equal rows, those that start before the budget's end.
    return rows.withColumn("seen", F.least(F.col("n"), F.expr("(total - _at + tokens - 1) div tokens")))


def schedule(tokens: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each time that a document is seen: doc_id, source, tokens, epoch, block, slot (gapless from 0 in a block).

    tokens is that of token_table(), and planned that of plan()."""
    rows = _epochs(tokens, planned, seed)
    # Many equal rows are written by many tasks.
    single = rows.where(F.col("seen") <= CHUNK).withColumn("_from", F.lit(0).cast("long"))
    many = rows.where(F.col("seen") > CHUNK).withColumn("_from", F.explode(F.expr(f"sequence(0L, seen - 1, {CHUNK}L)"))).repartition("_key", "_from")
    rows = single.unionByName(many).withColumn("_i", F.explode(F.expr(f"sequence(_from, least(seen, _from + {CHUNK}) - 1)")))
    rows = rows.withColumn("block", F.expr("(_at + _i * tokens) div quota"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("_key", "source", "doc_id", "epoch", "tokens")) - 1
    return rows.withColumn("slot", slot.cast("long")).select("doc_id", "source", "tokens", "epoch", "block", "slot")


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy_share: float | None = None, block_tokens: int = 65_536, budget_tokens: int | None = None, seed: int = 0) -> DataFrame:
    tokens = token_table(docs)
    planned = plan(tokens, max_repeats, entropy_share, block_tokens, budget_tokens)
    return schedule(tokens, planned, seed)


def mixed_rows(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The rows of docs as often as mix() sees them, with all their columns.

    Each source is seen in whole epochs and, in the last, up to the key where
    its budget ends: the cut keys (one a source) go to the rows, so that no
    text is shuffled. Of equal rows at the cut, as many are taken as fit."""
    tokens = token_table(docs)
    planned = plan(tokens, **how)
    last = _epochs(tokens, planned, seed)
    ends = last.groupBy("source").agg(F.max(F.struct("epoch", "_key", "doc_id", "tokens", "text_id", "n", "seen")).alias("_end"))
    ends = counted(ends.select(F.col("source").alias("_source"), F.col("_end.epoch").alias("_epoch"), F.col("_end._key").alias("_cut"), F.col("_end.n").alias("_n"), F.col("_end.seen").alias("_seen")))
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    rows = whole.join(ends, F.col("_row.source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_key", order_key(seed, F.col("_epoch"), F.col("_row.doc_id"), text_digest(F.col("_row.text"))))
    cut = (F.col("_key") == F.col("_cut")) & (F.col("_seen") < F.col("_n"))
    times = F.col("_epoch") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)
    out = rows.where(~cut).select("_row", times.alias("_times"))
    if not ends.where("_seen < _n").isEmpty():
        some = numbered(rows.where(cut).select("_row", "_source", "_epoch", "_seen"), ["_source"])
        out = out.unionByName(some.select("_row", (F.col("_epoch") + F.when(F.col("_nth") < F.col("_seen"), 1).otherwise(0)).alias("_times")))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select("_row.*")
