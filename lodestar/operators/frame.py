"""LinkedFrame: entities of one class as a DataFrame, with navigation along IRI fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Node, compile_condition, parse_mini
from ..functions.persist import materialise
from ..plans.model import EntityClass


class LinkedFrame:
    """df: iri and the class's fields. A dereference adds one join, and only when a field of the target is asked for."""

    def __init__(self, df: DataFrame, cls: EntityClass | None = None):
        self.df, self.cls = df, cls

    def filter(self, what: Node | str) -> LinkedFrame:
        n = parse_mini(what) if isinstance(what, str) else what
        return LinkedFrame(self.df.where(F.col("iri").isNotNull() & compile_condition(n, self.df.schema, "list")), self.cls)

    def __getitem__(self, key) -> LinkedFrame:
        if isinstance(key, Node):
            return self.filter(key)
        if isinstance(key, str):
            return self.filter(key) if key.startswith("@") else self.by_iri(key)
        return self.at(key)

    def by_iri(self, iri: str) -> LinkedFrame:
        """Lazy: no rows if there is none; lookup() raises."""
        return LinkedFrame(self.df.where(F.col("iri") == iri), self.cls)

    def lookup(self, iri: str) -> LinkedFrame:
        found = self.by_iri(iri)
        if found.df.isEmpty():
            raise KeyError(iri)
        return found

    def at(self, pos: int) -> LinkedFrame:
        """The row at a place, of positioned()."""
        if "pos" not in self.df.columns:
            raise ValueError("no positions: use positioned()")
        return LinkedFrame(self.df.where(F.col("pos") == pos), self.cls)

    def positioned(self, *order: str) -> LinkedFrame:
        """With pos, the rows' places from 0 in this order: sorted in ranges, whose sizes are summed, so that no task sorts all."""
        df = self.df.repartitionByRange(*order).sortWithinPartitions(*order)
        df = materialise(df.withColumn("_part", F.spark_partition_id()))
        upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        starts = df.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
        df = df.join(F.broadcast(starts), "_part")
        pos = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
        return LinkedFrame(df.withColumn("pos", pos).drop("_part", "_start"), self.cls)

    def deref(self, field: str, target: LinkedFrame, columns: dict[str, str]) -> LinkedFrame:
        """Add columns (of the target: as named here) along a single reference; a missing target leaves nulls and the IRI."""
        t = target.df.select(F.col("iri").alias("_iri"), *(F.col(c).alias(to) for c, to in columns.items()))
        return LinkedFrame(self.df.join(t, F.col(field) == F.col("_iri"), "left").drop("_iri"), self.cls)

    def deref_list(self, field: str, target: LinkedFrame, columns: dict[str, str]) -> DataFrame:
        """One row for each place of a list of references: iri, pos, ref and the target's columns."""
        rows = self.df.select("iri", F.posexplode_outer(field).alias("pos", "ref"))
        t = target.df.select(F.col("iri").alias("_iri"), *(F.col(c).alias(to) for c, to in columns.items()))
        return rows.join(t, F.col("ref") == F.col("_iri"), "left").drop("_iri")

    def deref_as_list(self, field: str, target: LinkedFrame, name: str) -> LinkedFrame:
        """Add a list of the targets (structs) of a list of references, place by place, null where one is missing. A list is one row, as it was before."""
        rows = self.df.select("iri", F.posexplode(field).alias("_pos", "_ref"))
        t = target.df.select(F.col("iri").alias("_iri"), F.struct(*target.df.columns).alias("_x"))
        got = rows.join(t, F.col("_ref") == F.col("_iri"), "left").groupBy("iri").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("_l"))
        got = got.select(F.col("iri").alias("_of"), F.transform("_l", lambda x: x["_x"]).alias(name))
        return LinkedFrame(self.df.join(got, F.col("iri") == F.col("_of"), "left").drop("_of"), self.cls)

    def follow(self, field: str, target: LinkedFrame) -> LinkedFrame:
        """The entities that a field (single or list) leads to, one row a link."""
        c = F.explode(field) if isinstance(self.df.schema[field].dataType, T.ArrayType) else F.col(field)
        return LinkedFrame(self.df.select(c.alias("_ref")).join(target.df, F.col("_ref") == F.col("iri")).drop("_ref"), target.cls)

    def follow_back(self, source: LinkedFrame, field: str) -> LinkedFrame:
        """The entities of source whose field leads here, one row a link."""
        return LinkedFrame(source.df.join(self.df.select(F.col("iri").alias("_to")), F.col(field) == F.col("_to")).drop("_to"), source.cls)

    def flatmap(self, field: str, name: str | None = None) -> DataFrame:
        """Values of a field; lists are spliced, nulls stay."""
        c = F.col(field)
        if isinstance(self.df.schema[field].dataType, T.ArrayType):
            c = F.explode(F.coalesce(c, F.array(F.lit(None))))
        return self.df.select(c.alias(name or field))

    def iris(self, field: str) -> DataFrame:
        """References without their targets: no join; an empty list is null."""
        c = F.col(field)
        many = isinstance(self.df.schema[field].dataType, T.ArrayType)
        return self.df.select("iri", F.when(F.size(c) > 0, c).alias(field) if many else c)

    def raw(self, field: str) -> DataFrame:
        """The value as it is held: an embedded object, or null where only its IRI is known; other fields as they are."""
        held = f"{field}_object"
        return self.df.select("iri", F.col(held if held in self.df.columns else field).alias(field))

    def raw_objects(self) -> DataFrame:
        """iri and doc: each row as JSON with its embedded objects, and IRIs where an object isn't held."""
        held = [c for c in self.df.columns if c.endswith("_object") and c.removesuffix("_object") in self.df.columns]
        whole = {c: F.coalesce(F.to_json(c), _iri_json(F.col(c.removesuffix("_object")))) for c in held}
        plain = [c for c in self.df.columns if c not in held and f"{c}_object" not in held and c != "iri"]
        parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}":'), _json_of(F.col(c)))) for c in plain]
        parts += [F.concat(F.lit(f'"{c.removesuffix("_object")}":'), x) for c, x in whole.items()]
        return self.df.select("iri", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc"))

    def objects_to_iris(self) -> LinkedFrame:
        """Embedded objects that have an IRI (a field iri or id) become it, at every depth."""
        cols = {f.name: _to_iris(F.col(f"`{f.name}`"), f.dataType, True) for f in self.df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType))}
        return LinkedFrame(self.df.withColumns(cols) if cols else self.df, self.cls)

    def link(self, field: str, *iris: str | None) -> LinkedFrame:
        """Append references; nulls are skipped, and a null list counts as empty."""
        new = F.array(*(F.lit(i) for i in iris if i is not None)).cast("array<string>")
        return LinkedFrame(self.df.withColumn(field, F.concat(F.coalesce(field, F.array().cast("array<string>")), new)), self.cls)

    def sync(self, field: str, items: str | Column) -> LinkedFrame:
        """References of items that aren't there yet are appended, once each."""
        new = F.array_compact(F.coalesce(F.col(items) if isinstance(items, str) else items, F.array().cast("array<string>")))
        return LinkedFrame(self.df.withColumn(field, F.array_union(F.coalesce(field, F.array().cast("array<string>")), new)), self.cls)

    def assign(self, field: str, value: Column | str | list[str] | None) -> LinkedFrame:
        """Set a reference, or a list of them; None clears it. An object held for it goes."""
        t = self.df.schema[field].dataType
        c = value if isinstance(value, Column) else F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        return LinkedFrame(self.df.withColumn(field, c.cast(t)).drop(f"{field}_object"), self.cls)

    def unlink(self, field: str, iri: str) -> LinkedFrame:
        """Without the first occurrence."""
        at = F.array_position(field, iri).cast("int")
        rest = F.concat(F.slice(field, F.lit(1), at - 1), F.slice(field, at + 1, F.size(field)))
        return LinkedFrame(self.df.withColumn(field, F.when(at > 0, rest).otherwise(F.col(field))), self.cls)

    def cast(self, cls: EntityClass, none_to_default: bool = False, remove_extra: bool = True, **values) -> LinkedFrame:
        """As another class: its type, common fields, defaults for what is missing (none_to_default: for nulls and empty lists too)."""
        out = [] if remove_extra else [c for c in self.df.columns if c not in cls.attributes and c != "iri"]
        cols = {c: F.col(c) for c in out}
        for k, a in cls.attributes.items():
            default = _literal(a.default, a.type)
            if k in values:
                c = F.lit(values[k])
            elif k == "type":
                c = default if a.default is not None else F.lit(cls.types[0])
            elif k not in self.df.columns:
                c = default
            else:
                c = F.col(k)
                if none_to_default and a.many:
                    c = F.when(F.size(F.filter(c, lambda x: x.isNotNull())) > 0, c).otherwise(default)
                elif none_to_default:
                    c = F.coalesce(c, default)
            cols[k] = c
        return LinkedFrame(self.df.select(*(["iri"] if "iri" in self.df.columns else []), *(c.alias(k) for k, c in cols.items())), cls)

    def copy(self, cls: EntityClass | None = None, **values) -> LinkedFrame:
        """New entities made of these: as the class given, with values that replace theirs."""
        return self.cast(cls or self.cls, none_to_default=False, remove_extra=True, **values)

    def restore_defaults(self, doc: str | None = None) -> LinkedFrame:
        """Defaults for absent fields. doc: the column with the JSON that the fields come from, which tells an absent one from an explicit null; without it nulls count as absent."""
        keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")) if doc else None
        absent = lambda k: ~F.array_contains(keys, k) if doc else F.col(k).isNull()
        cols = {k: F.when(absent(k), _literal(a.default, a.type)).otherwise(F.col(k)) for k, a in self.cls.attributes.items() if a.default is not None and k in self.df.columns}
        return LinkedFrame(self.df.withColumns(cols) if cols else self.df, self.cls)

    def exclude_defaults(self) -> LinkedFrame:
        """Null where a field has its default; references stay, as a default reference isn't restored without being resolved."""
        cols = {k: F.when(~F.col(k).eqNullSafe(_literal(a.default, a.type)), F.col(k)) for k, a in self.cls.attributes.items() if a.default is not None and not a.range and k in self.df.columns}
        return LinkedFrame(self.df.withColumns(cols) if cols else self.df, self.cls)

    def strip_controller(self) -> LinkedFrame:
        """Only what the model classes have; type is that of all of them."""
        model = self.cls.model()
        keep = [c for c in self.df.columns if c == "iri" or c in model.attributes]
        df = self.df.select(*keep)
        if "type" in keep and self.cls.controller:
            df = df.withColumn("type", F.array(*map(F.lit, self.cls.types)))
        return LinkedFrame(df, model)

    def to_json(self, name: str = "doc", ignore_null: bool = True, include: list[str] | None = None, exclude: list[str] = (), exclude_defaults: bool = False) -> DataFrame:
        f = self.exclude_defaults() if exclude_defaults else self
        cols = [c for c in f.df.columns if c != "iri" and c not in exclude and (include is None or c in include)]
        return f.df.select("iri", F.to_json(F.struct(*cols), {"ignoreNullFields": str(ignore_null).lower()}).alias(name))

    def to_jsonld(self, known: dict[str, EntityClass] | None = None) -> DataFrame:
        """iri and doc: the rows compacted with their class's context; of a controller what its model has."""
        from ..plans.context import class_context, of_class
        from .documents import compact
        from .triples import to_triples

        f = self.strip_controller() if self.cls.controller else self
        df = f.df.drop("type")
        context = {"id": "@id", "type": "@type"} | class_context(f.cls, known)
        return compact(to_triples(df, of_class(f.cls, known), [of_class(f.cls, known).expand(i) for i in self.cls.types]), context)

    def violations(self, field: str | None = None) -> DataFrame:
        """iri and field of required references that are missing."""
        names = [field] if field else [k for k, a in self.cls.attributes.items() if a.range and a.required]
        missing = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in names)))
        return self.df.select("iri", F.explode(missing).alias("field"))

    def dangling(self, field: str, target: LinkedFrame) -> DataFrame:
        many = isinstance(self.df.schema[field].dataType, T.ArrayType)
        refs = self.df.select("iri", (F.explode(field) if many else F.col(field)).alias("ref")).where("ref is not null")
        return refs.join(target.df.select(F.col("iri").alias("_iri")), F.col("ref") == F.col("_iri"), "left_anti")


def construct(docs: DataFrame, cls: EntityClass, doc: str = "doc") -> LinkedFrame:
    """Entities of JSON documents (iri, doc). A reference may be given as an IRI or as an object with an id: the field gets the IRIs, and `<field>_object` the objects (variants) where they were given."""
    v = F.try_parse_json(doc)
    parsed = F.from_json(doc, T.StructType([f for f in cls.schema if not cls.attributes[f.name].range]))
    cols = {}
    for k, a in cls.attributes.items():
        if not a.range:
            cols[k] = parsed[k]
            continue
        x = F.try_variant_get(v, f"$['{k}']", "variant")
        iri = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(F.coalesce(F.try_variant_get(e, "$.id", "string"), F.try_variant_get(e, "$.iri", "string")))
        held = lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT<"), e)
        if a.many:
            each = F.when(F.schema_of_variant(x).startswith("ARRAY<"), F.try_variant_get(x, "$", "array<variant>")).when(x.isNotNull() & ~F.is_variant_null(x), F.array(x))
            cols[k], cols[f"{k}_object"] = F.transform(each, iri), F.transform(each, held)
        else:
            cols[k], cols[f"{k}_object"] = iri(x), held(x)
        if a.default is not None:
            cols[k] = F.coalesce(cols[k], _literal(a.default, a.type))
    return LinkedFrame(docs.select("iri", *(c.alias(k) for k, c in cols.items())), cls)


def _json_of(c: Column) -> Column:
    """A value as JSON text."""
    text = F.to_json(F.array(c))
    return text.substr(F.lit(2), F.length(text) - 2)


def _iri_json(c: Column) -> Column:
    return F.when(c.isNotNull(), _json_of(c))


def _to_iris(c: Column, t: T.DataType, inside: bool) -> Column:
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _to_iris(x, t.elementType, True)) if isinstance(t.elementType, (T.StructType, T.ArrayType)) else c
    if not isinstance(t, T.StructType):
        return c
    own = next((k for k in ("iri", "id") if k in t.names and t[k].dataType == T.StringType()), None)
    if own and inside:
        return c[own]
    return F.when(c.isNotNull(), F.struct(*(_to_iris(c[f.name], f.dataType, True).alias(f.name) for f in t)))


def _literal(v, t: T.DataType):
    return F.array(*map(F.lit, v)).cast(t) if isinstance(v, list) else F.lit(v).cast(t)


def best_match(targets: DataFrame, on: str, key: str, credentials: list[str]) -> DataFrame:
    """The credential of each target: equal, else the longest inside it, else the shortest around it; ties by order.

    The list is the driver's own; each target is judged within its row."""
    target = F.col(on)
    ranked = [F.struct(F.when(target == k, 0).when(target.contains(k), 1).otherwise(2).alias("r"), F.when(target.contains(k), F.lit(-len(k))).otherwise(F.lit(len(k))).alias("l"), F.lit(i).alias("i"), F.lit(k).alias("k"), (target.contains(k) | F.lit(k).contains(target)).alias("fits")) for i, k in enumerate(credentials)]
    return targets.select(key, F.array_min(F.filter(F.array(*ranked), lambda x: x["fits"]))["k"].alias("k")).where("k is not null")


def first_positions(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where("_n = 1").drop("_n")
