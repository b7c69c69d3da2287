"""Upserts of a stream of documents, batch by batch, into a store of hash buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import EntityStore

BUCKETS = 256


class BucketStore:
    """Rows by a hash of their iri. A batch writes the buckets it touches, under its own number, and then a
    manifest that says which number each bucket has; buckets without a row of the batch aren't read or written.

    A batch that runs again starts from the manifest before it, so each counts once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket: the number of the batch that wrote it, as of the last manifest (before a batch)."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest")
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return {}
            raise
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r["bucket"]: r["number"] for r in rows.where(F.col("batch") == last).collect()}  # a row a bucket

    def _rows(self, of: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/{n}/_bucket={b}" for b, n in sorted(of.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._rows(self._manifest())

    def put(self, df: DataFrame, number: int, before: dict[int, int]) -> None:
        """Write these rows, whole buckets of them, as the batch of this number."""
        rows = df.withColumn("_bucket", F.expr(f"cast(pmod(xxhash64(iri), {self.buckets}) as int)")).repartition("_bucket")
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        wrote = self.spark.read.parquet(f"{self.path}/data/{number}").select("_bucket").distinct().collect()  # a row a bucket
        known = before | {r["_bucket"]: number for r in wrote}
        self.spark.createDataFrame(sorted(known.items()), "bucket int, number long").write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def start(self, df: DataFrame) -> BucketStore:
        """Fill a new store with what there is already."""
        self.put(df, -1, {})
        return self

    def upsert(self, batch: DataFrame, number: int, order: str) -> None:
        if batch.isEmpty():
            return
        before = self._manifest(number)
        touched = {r[0] for r in batch.select(F.expr(f"cast(pmod(xxhash64(iri), {self.buckets}) as int)")).distinct().collect()}  # a row a bucket
        old = self._rows({b: n for b, n in before.items() if b in touched})
        store = EntityStore(batch.drop(order).limit(0) if old is None else old)
        self.put(store.upsert(batch, order).df, number, before)


def upsert_batches(spark: SparkSession, path: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of several rows of one iri in a batch the last by order counts."""
    store = BucketStore(spark, path, buckets)
    return lambda batch, number: store.upsert(batch, number, order)
