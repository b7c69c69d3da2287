"""RDF graphs as a table of triples, a set: s, p, o, o_kind (iri, bnode, literal), datatype, lang."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.context import RDF_TYPE, XSD, Context

COLUMNS = ["s", "p", "o", "o_kind", "datatype", "lang"]
_DATATYPES = {T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "double", T.FloatType: "double", T.BooleanType: "boolean"}


def _row(s: Column, p: str, o: Column, kind: str, datatype: str | None = None, lang: str | None = None, reverse: bool = False) -> Column:
    a, b = (o, s) if reverse else (s, o)
    return F.struct(a.cast("string").alias("s"), F.lit(p).alias("p"), b.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def _rower(s: Column, *rest):
    p, kind, datatype, lang, reverse = rest
    return lambda x: _row(s, p, x, kind, datatype, lang, reverse)


def predicates(df: DataFrame, context: Context, types: list[str] | None = None) -> set[str]:
    """The predicates that to_triples() may make of these columns."""
    named = {RDF_TYPE if t.kind == "type" else t.iri for n, t in context.terms.items() if n in df.columns and t.kind != "id"}
    return named | ({RDF_TYPE} if types else set())


def to_triples(df: DataFrame, context: Context, types: list[str] | None = None, iri: str = "iri", only: str | None = None) -> DataFrame:
    """One pass: each row becomes an array of its triples. Fields without a term are left out; rows without an IRI get a blank node of their content.

    only: a predicate; then just its fields are read."""
    s = F.coalesce(F.col(iri), F.concat(F.lit("_:"), F.sha2(F.to_json(F.struct(*df.columns)), 256)))
    rows = [F.array(_row(s, RDF_TYPE, F.lit(t), "iri")) for t in types or () if only in (None, RDF_TYPE)]
    for name, t in context.terms.items():
        if name not in df.columns or t.kind == "id" or only not in (None, RDF_TYPE if t.kind == "type" else t.iri):
            continue
        c, dt = F.col(name), df.schema[name].dataType
        values = c if isinstance(dt, T.ArrayType) else F.array(c)
        element = dt.elementType if isinstance(dt, T.ArrayType) else dt
        if t.kind in ("iri_ref", "type"):
            p, kind, datatype = RDF_TYPE if t.kind == "type" else t.iri, "iri", None
        else:
            p, kind = t.iri, "literal"
            own = _DATATYPES.get(type(element))
            datatype = t.datatype or (XSD + own if own else None)
        if only and not isinstance(dt, T.ArrayType):
            rows.append(F.when(c.isNotNull(), F.array(_row(s, p, c, kind, datatype, t.lang, t.reverse))))
        else:
            rows.append(F.transform(F.array_compact(values), _rower(s, p, kind, datatype, t.lang, t.reverse)))
    if not rows:
        return df.sparkSession.createDataFrame([], r_type().elementType)
    made = F.flatten(F.array(*(F.coalesce(r, F.array().cast(r_type())) for r in rows))) if len(rows) > 1 else rows[0]
    return df.select(F.explode(made).alias("t")).select("t.*")


def r_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS]))


class Graph:
    """df: the triples. views: where they come from (frame, context, class IRIs), so that a scan for one predicate reads its fields only."""

    def __init__(self, df: DataFrame, prefixes: dict[str, str] | None = None, views: list[tuple] | None = None, distinct: bool = False):
        self.df, self.prefixes, self.views, self.distinct = df, prefixes or {}, views, distinct

    @classmethod
    def of(cls, parts: list[DataFrame], prefixes: dict[str, str] | None = None, distinct: bool = True) -> Graph:
        df = reduce(DataFrame.unionByName, parts)
        return cls(df.distinct() if distinct else df, prefixes)

    @classmethod
    def of_views(cls, views: list[tuple[DataFrame, Context, list[str] | None]], prefixes: dict[str, str] | None = None, distinct: bool = True) -> Graph:
        made = cls.of([to_triples(*v) for v in views], prefixes, distinct)
        return cls(made.df, prefixes, views, distinct)

    def scan(self, p: str) -> DataFrame:
        """The triples of one predicate."""
        if self.views is None:
            return self.df.where(F.col("p") == p)
        parts = [to_triples(*v, only=p) for v in self.views if p in predicates(*v)]
        if not parts:
            return self.df.where(F.lit(False))
        df = reduce(DataFrame.unionByName, parts)
        return df.distinct() if self.distinct else df

    def union(self, other: Graph) -> Graph:
        return Graph(self.df.unionByName(other.df).distinct(), self.prefixes | other.prefixes)

    def delete_subjects(self, subjects: DataFrame) -> Graph:
        return Graph(self.df.join(subjects.select("s"), "s", "left_anti"), self.prefixes)

    def replace(self, subjects: DataFrame, new: DataFrame) -> Graph:
        """Drop the triples of these subjects, then add the new ones; what hung below older versions stays."""
        return Graph(self.delete_subjects(subjects).df.unionByName(new).distinct(), self.prefixes)

    def documents(self) -> DataFrame:
        """One row a subject: s and props, a map of predicates to sorted arrays of values."""
        per = self.df.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("v"))
        return per.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "v")))).alias("props"))

    def star(self, terms: dict[str, str], many: tuple[str, ...] = ()) -> DataFrame:
        """One row a subject with a column for each predicate, in one aggregation instead of a join for each."""
        wanted = self.df.where(F.col("p").isin(list(terms.values())))
        return wanted.groupBy("s").agg(*((F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))) if k in many else F.max(F.when(F.col("p") == p, F.col("o")))).alias(k) for k, p in terms.items()))

    def n_triples(self) -> DataFrame:
        node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
        text = F.concat(F.to_json(F.array("o")).substr(F.lit(2), F.length(F.to_json(F.array("o"))) - 2), F.coalesce(F.concat(F.lit("@"), "lang"), F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit("")))
        o = F.when(F.col("o_kind") == "literal", text).otherwise(node(F.col("o")))
        return self.df.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), o, F.lit(".")).alias("value"))

    def query(self, text: str) -> DataFrame:
        from .sparql import run

        return run(self, text)
