"""Sharding into contiguous shards of near equal bytes.

A row's size is its text's UTF-8 bytes and a fixed overhead. Rows stand in one
global order (a digest of doc_id and text, so that a shard is a fair sample of
the corpus and the order doesn't depend on how the input was split); totals of
each part of that order are summed to global offsets, and the byte axis is cut
at equal targets. A row goes where its middle byte lies, so shards differ from
the target by half the largest row at each end at most.

Equal rows (doc_id and text) follow each other and are one row with a count
until the end, so that they meet in no task; a cut may part them.

Cases. A null text has no bytes and the CRC of no bytes; a very long text is a
row like others and may be larger than a shard's share. No rows: no shards. Columns
beside doc_id and text stay out of shard(); sharded_rows() returns them as they
are, whatever their names, but for a column `shard`, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, materialise, numbered, running_totals

OVERHEAD = 16
#: Equal rows that one task writes.
CHUNK = 10_000


def _measures(text: Column) -> tuple[Column, Column]:
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(text.cast("binary"))


def _key(doc_id: Column, size: Column, crc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), crc.cast("string"), size.cast("string")))


def _placed(docs: DataFrame, n_shards: int) -> DataFrame:
    """Equal rows once: doc_id, size, text_crc32, _key, _n (of them), _bytes and _rank (before them), _total."""
    size, crc = _measures(F.col("text"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), _key(F.col("doc_id"), size, crc).alias("_key"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_n"))
    rows = materialise(rows.withColumn("_sum", F.col("size") * F.col("_n")))  # texts are read once
    placed = running_totals(rows, [], "_key", ["doc_id", "text_crc32"], {"_sum": "_bytes", "_n": "_rank"})
    total = rows.agg(F.sum("_sum").alias("_total"))
    placed = placed.join(F.broadcast(total), how="left")  # one row
    at = lambda i: _shard(F.col("_bytes") + i * F.col("size"), n_shards)
    return materialise(placed.withColumns({"_first": at(F.lit(0)), "_last": at(F.col("_n") - 1)}))


def _shard(before: Column, n_shards: int) -> Column:
    """Where a row's middle byte lies, of the rows before it in bytes."""
    middle = (2 * before + F.col("size")).cast("decimal(38)") * n_shards
    return F.least(F.lit(n_shards - 1), F.call_function("div", middle, 2 * F.col("_total")).cast("int"))


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null under this law)."""
    placed = _placed(docs, n_shards)
    single = placed.where(F.col("_n") <= CHUNK).withColumn("_from", F.lit(0).cast("long"))
    many = placed.where(F.col("_n") > CHUNK).withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {CHUNK}L)"))).repartition("_key", "_from")
    rows = single.unionByName(many).withColumn("_i", F.explode(F.expr(f"sequence(_from, least(_n, _from + {CHUNK}) - 1)")))
    rows = rows.withColumn("shard", _shard(F.col("_bytes") + F.col("_i") * F.col("size"), n_shards)).withColumn("_at", F.col("_rank") + F.col("_i"))
    first = rows.groupBy("shard").agg(F.min("_at").alias("_start"))  # n_shards rows at most
    rows = rows.join(F.broadcast(first), "shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_rows(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The rows of docs, all their columns, with shard; each shard has the rows that shard() gives it.

    A shard is an interval of digests, so its first digest is all that the rows
    need: no text is shuffled but those of equal rows that a cut parts (of
    n_shards - 1 digests at most), which are numbered."""
    placed = _placed(docs, n_shards)
    firsts = placed.groupBy(F.col("_first").alias("shard")).agg(F.min("_key").alias("_from"))
    cuts = firsts.agg(F.sort_array(F.collect_list(F.struct("_from", "shard"))).alias("_cuts"))  # n_shards entries at most
    parted = counted(placed.where("_first <> _last").select(F.col("_key").alias("_cut"), "size", "_bytes", "_total"))  # fewer than n_shards rows
    size, crc = _measures(F.col("_row.text"))
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c != "shard")).alias("_row"))
    whole = whole.withColumn("_key", _key(F.col("_row.doc_id"), size, crc)).join(F.broadcast(cuts), how="left")
    rows = whole.join(parted, F.col("_key") == F.col("_cut"), "left")
    at = F.element_at(F.filter("_cuts", lambda c: c["_from"] <= F.col("_key")), -1)["shard"]
    out = rows.where("_cut is null").select("_row", at.alias("shard"))
    if not parted.isEmpty():
        some = numbered(rows.where("_cut is not null").select("_row", "_cut", "size", "_bytes", "_total"), ["_cut"])
        out = out.unionByName(some.select("_row", _shard(F.col("_bytes") + F.col("_nth") * F.col("size"), n_shards).alias("shard")))
    return out.select("_row.*", "shard")
