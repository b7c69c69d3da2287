"""Entity stores and the registry that routes IRIs to them by prefix.

A store is a DataFrame keyed by `iri`: typed columns, or one `doc` column of
JSON. Reads are lazy; a request joins the store, broadcast only while it is a
list that the caller gave (bounded by REQUEST_ROWS).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import Node, compile_condition, fields
from ..functions.jsonfn import field as json_field
from ..functions.jsonfn import prefix_of

REQUEST_ROWS = 100_000


def request(spark: SparkSession, iris: list[str]) -> DataFrame:
    return _asked(spark, list(enumerate(iris)))


def _asked(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    df = spark.createDataFrame(rows, "pos int, iri string")
    return F.broadcast(df) if len(rows) <= REQUEST_ROWS else df


class Source:
    """What a store may offer; hooks that a kind of store lacks raise."""

    def resolve(self, iris: DataFrame | list[str], missing: str = "null") -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} resolves no IRIs")

    def query(self, n: Node, mode: str = "store") -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} answers no conditions")

    def upsert(self, new: DataFrame, order: str | None = None) -> Source:
        raise NotImplementedError(f"{type(self).__name__} stores nothing")


class EntityStore(Source):
    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_json_file(cls, spark: SparkSession, path: str, lines: bool = False) -> EntityStore:
        """A file of one object {iri: document}, read by one task; lines: files of such an object a line, which are split, as export_json() writes them."""
        raw = spark.read.text(path, wholetext=not lines)
        return cls(raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("iri", "doc")))

    @classmethod
    def from_dict(cls, spark: SparkSession, docs: dict[str, dict | None]) -> EntityStore:
        rows = [(k, None if v is None else json.dumps(v)) for k, v in docs.items()]
        return cls(spark.createDataFrame(rows, "iri string, doc string"))

    @classmethod
    def from_sqlite(cls, spark: SparkSession, path: str, table: str = "entities") -> EntityStore:
        """Read by Spark tasks through a Python data source; the file must be where executors see it."""
        from .sqlite import SqliteSource

        spark.dataSource.register(SqliteSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # lookups go to the table's key
        return cls(spark.read.format("lodestar-sqlite").option("path", path).option("table", table).load())

    def resolve(self, iris: DataFrame | list[str], missing: str = "null") -> DataFrame:
        """The request's rows with the store's columns; missing ones null or dropped."""
        req = request(self.df.sparkSession, iris) if isinstance(iris, list) else iris
        return req.join(self.df, "iri", "left" if missing == "null" else "inner")

    def get(self, iri: str) -> DataFrame:
        return self.df.where(F.col("iri") == iri).limit(1)

    def _with_fields(self, n: Node) -> DataFrame:
        if "doc" not in self.df.columns:
            return self.df
        return self.df.withColumns({k: json_field(F.col("doc"), k) for k in sorted(fields(n)) if k != "iri"})

    def query(self, n: Node, mode: str = "store") -> DataFrame:
        df = self._with_fields(n)
        return df.where(compile_condition(n, df.schema, mode)).select(*self.df.columns)

    def upsert(self, new: DataFrame, order: str | None = None) -> EntityStore:
        """Rows of new replace those of their iri; of several in new the last by order. Without an order, different rows of one iri raise an error when the store is read."""
        w = Window.partitionBy("iri")
        if order:
            new = new.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
        else:
            many = F.count(F.lit(1)).over(w) > 1
            new = new.distinct().withColumn("iri", F.when(many, F.raise_error(F.concat(F.lit("several rows, and no order, for "), "iri"))).otherwise(F.col("iri")))
        return EntityStore(self.df.join(new.select("iri"), "iri", "left_anti").unionByName(new, allowMissingColumns=True))

    def export_json(self, path: str, single: bool = False) -> None:
        """An object {iri: document} a line, by as many tasks as the store has. single: one file with one object over all lines, by one task that holds a row at a time."""
        quoted = F.to_json(F.array("iri"))
        pair = F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), F.coalesce(F.col("doc"), F.lit("null")))
        if not single:
            self.df.select(F.concat(F.lit("{"), pair, F.lit("}")).alias("value")).write.mode("overwrite").text(path)
            return
        spark = self.df.sparkSession
        rows = self.df.select("iri", pair.alias("value")).coalesce(1).sortWithinPartitions("iri")
        rows = rows.select(F.when(F.monotonically_increasing_id() > 0, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
        ends = [spark.createDataFrame([(x,)], "value string").coalesce(1) for x in "{}"]
        ends[0].unionByName(rows).unionByName(ends[1]).coalesce(1).write.mode("overwrite").text(path)

    def to_sqlite(self, path: str, table: str = "entities") -> None:
        """Insert or replace the rows in a table that is made if it isn't there; the file must be where executors see it."""
        from .sqlite import SqliteSource

        spark = self.df.sparkSession
        spark.dataSource.register(SqliteSource)
        self.df.select("iri", "doc").write.format("lodestar-sqlite").mode("append").option("path", path).option("table", table).save()


class Registry:
    """Prefix: store."""

    def __init__(self):
        self.stores: dict[str, EntityStore] = {}

    def register(self, prefix: str, store: EntityStore | DataFrame) -> Registry:
        self.stores[prefix] = store if isinstance(store, EntityStore) else EntityStore(store)
        return self

    def store(self, iri: str) -> EntityStore:
        prefix = iri.split(":", 1)[0]
        if prefix not in self.stores:
            raise KeyError(f"no store for prefix {prefix!r}")
        return self.stores[prefix]

    def resolve(self, spark: SparkSession, iris: list[str], columns: list[str], missing: str = "null") -> DataFrame:
        """Each IRI by its own prefix; only the stores of prefixes that occur are read. Repeats keep their first place."""
        by: dict[str, list[tuple[int, str]]] = {}
        for k, i in enumerate(dict.fromkeys(iris)):
            self.store(i)
            by.setdefault(i.split(":", 1)[0], []).append((k, i))
        parts = [EntityStore(self.stores[p].df.select("iri", *columns)).resolve(_asked(spark, rows), missing) for p, rows in by.items()]
        return reduce(DataFrame.unionByName, parts)

    def upsert(self, new: DataFrame, order: str | None = None) -> Registry:
        """A registry with each row in the store of its IRI's prefix; a null IRI, or one without a store, raises an error when a store is read."""
        prefix_here = prefix_of(F.col("iri"))
        # The comparison itself raises, so that no order of predicates can skip it.
        routed = F.when(prefix_here.isin(*self.stores), prefix_here).otherwise(F.raise_error(F.concat(F.lit("no store for "), F.coalesce("iri", F.lit("a null IRI")))))
        out = Registry()
        for prefix, store in self.stores.items():
            out.register(prefix, store.upsert(new.where(routed == prefix), order))
        return out

    def query(self, n: Node, columns: list[str]) -> DataFrame:
        """Over all stores, as a bag."""
        return reduce(DataFrame.unionByName, [s.query(n).select(*columns) for s in self.stores.values()])

    def union(self, columns: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.df.select(*columns) for s in self.stores.values()])


def first_found(req: DataFrame, stores: list[EntityStore], column: str) -> DataFrame:
    """Of several stores, the first whose value isn't null."""
    out = req
    for k, s in enumerate(stores):
        out = out.join(s.df.select("iri", F.col(column).alias(f"_{k}")), "iri", "left")
    return out.select(*req.columns, F.coalesce(*(F.col(f"_{k}") for k in range(len(stores)))).alias(column))


def resolve_type(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """classes: type, model, controller (null or one a row). A type's controller if it has exactly one, else its model."""
    known = classes.groupBy("type").agg(F.when(F.count("controller") == 1, F.max("controller")).otherwise(F.max("model")).alias("cls"))
    return docs.join(known, "type", "left")
