"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, inside a character class (Java and Python spelling).
SPACE = r"\x20\x09-\x0D"


def ship(module: str) -> None:
    """Send this module's functions to the executors with the tasks, so that they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_digest(text: Column) -> Column:
    """Tells texts apart, 128 bits; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, that of ``spark.checkpoint.dir``. Without one a local session gets a temporary folder, a cluster an error: a folder of one machine would lose rows."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there.

    Losing executors doesn't lose the rows, and what made them isn't run again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table is broadcast up to so many rows and bytes, both measured; beyond it is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def _bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def counted(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df written and measured; marked for broadcast up to `rows` and `size` bytes, so that the texts it is joined to aren't shuffled."""
    df = materialise(df)
    each = sum((_bytes(f) for f in df.schema), F.lit(16)).cast("long")
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()
    small = n["rows"] <= (BROADCAST_ROWS if rows is None else rows) and n["bytes"] <= (BROADCAST_BYTES if size is None else size)
    return F.broadcast(df) if small else df


def running_totals(df: DataFrame, group: list[str], key: str, ties: list[str], values: dict[str, str]) -> DataFrame:
    """Add to each row the sums of values over the rows before it in its group.

    key is a column of hexadecimal digests and gives the order, ties breaks
    equal digests; values maps a column to the name of its running sum.
    Totals of the 2**20 cells of equal leading five digits are summed by 4096
    top cells, these within a group, so that no task sorts more than a cell's
    rows or 4096 totals, however many rows a group holds. Rows of an equal
    digest lie in one cell: give equal rows as one with a count. df is read
    twice: give it materialised."""
    cell = df.withColumns({"_top": F.substring(key, 1, 3), "_sub": F.substring(key, 4, 2)})
    sums = [F.sum(v).alias(f"_s_{v}") for v in values]
    cells = cell.groupBy(*group, "_top", "_sub").agg(*sums)
    tops = cells.groupBy(*group, "_top").agg(*(F.sum(f"_s_{v}").alias(f"_t_{v}") for v in values))

    def before(by: list, order: list, what: str) -> Column:
        return F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = tops.select(*group, "_top", *(before(group or [F.lit(0)], ["_top"], f"_t_{v}").alias(f"_b_{v}") for v in values))
    on = [*group, "_top"]
    cells = cells.select(*on, "_sub", *(before(on, ["_sub"], f"_s_{v}").alias(f"_c_{v}") for v in values))
    starts = same(cells, tops, on).select(*on, "_sub", *((F.col(f"_c_{v}") + F.col(f"_b_{v}")).alias(f"_o_{v}") for v in values))
    on = [*on, "_sub"]
    rows = cell.withColumns({out: before(on, [key, *ties], v) for v, out in values.items()})
    rows = same(rows, starts, on).withColumns({out: F.col(out) + F.col(f"_o_{v}") for v, out in values.items()})
    return rows.drop("_top", "_sub", *(f"_o_{v}" for v in values))


def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns where null equals null; keeps a's columns and b's others."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        eq = a[c].eqNullSafe(b[f"_r_{c}"])
        cond = eq if cond is None else cond & eq
    return a.join(b, cond, how).drop(*(f"_r_{c}" for c in on))


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """df with _nth: the rows of a group counted from 0, in any order.

    A group is counted part by part and the parts' totals are summed, so that no
    task holds more of it than one partition of df has, however large it is."""
    df = materialise(df.withColumn("_part", F.spark_partition_id()))
    parts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_start"))
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(F.lit(0))) - 1)
    return same(df, parts, [*by, "_part"]).withColumn("_nth", F.col("_nth") + F.col("_start")).drop("_part", "_start")
