"""JSON-LD documents: to triples by a context, and back, compacted by a context; JSON to JSON by alias notation.

Everything is column expressions compiled from the context; no document reaches the driver. Nested nodes are
read level by level, until none is left."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonfn import compact_iri, expand_iri, is_array, is_object, is_string
from ..functions.persist import materialise
from ..plans.context import RDF_TYPE, XSD, Context, Term, class_context, compile_context
from ..plans.model import EntityClass
from .frame import LinkedFrame
from .transform import transform
from .triples import COLUMNS


def _keyword(c: Context, kind: str) -> str:
    """The context's alias of a keyword, or the keyword."""
    return next((n for n, t in c.terms.items() if t.kind == kind), f"@{kind}")


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", kind)


def _classes(c: Context) -> dict[str, str]:
    return {n: t.iri for n, t in c.terms.items() if t.kind == "plain" and "*" not in n}


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    if not table:
        return otherwise
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key], otherwise)


def _full(iri: Column, c: Context) -> Column:
    """Expanded by prefixes, or a relative one by the base."""
    out = expand_iri(iri, c.prefixes)
    return F.when(out.contains(":"), out).otherwise(F.concat(F.lit(c.base), out)) if c.base else out


def _node_iri(v: Column, c: Context) -> Column:
    """A node's own IRI, else a blank node of its content."""
    own = _full(_at(v, _keyword(c, "id"), "string"), c)
    return F.coalesce(own, F.concat(F.lit("_:"), F.sha2(F.to_json(v), 256)))


def _entries(s: Column, value: Column, t: Term, c: Context, at: int, p: Column | None = None) -> Column:
    """The triples of the values of one term of a node, each with the nested node that it leads to. at: the number of the context of nested nodes; p: the predicate, if the term doesn't tell it."""
    null = F.lit(None).cast("string")
    each = F.when(is_array(value), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    each = F.filter(each, lambda e: e.isNotNull() & ~F.is_variant_null(e))
    value_key, lang_key = _keyword(c, "value"), _keyword(c, "language")
    inner_context = t.nested or c

    def entry(e: Column) -> Column:
        boxed = is_object(e) & _at(e, value_key).isNotNull()
        node = is_object(e) & ~boxed
        inner = F.when(boxed, _at(e, value_key)).otherwise(e)
        own = F.schema_of_variant(inner)
        datatype = F.when(own == "BOOLEAN", XSD + "boolean").when(own == "BIGINT", XSD + "integer").when(own.rlike("^(DECIMAL|DOUBLE|FLOAT)"), XSD + "double")
        given = F.when(boxed, expand_iri(_at(e, _keyword(c, "type"), "string"), c.prefixes))
        lang = F.coalesce(F.when(boxed, _at(e, lang_key, "string")), F.when(~boxed & is_string(e), F.lit(t.lang).cast("string")))
        to = _node_iri(e, inner_context)
        if t.kind == "type":
            plain = expand_iri(_text(e), c.prefixes)
            plain = F.when(plain.contains(":"), plain).otherwise(F.concat(F.lit(c.vocab), plain)) if c.vocab else plain
            o, refers = _lookup(_text(e), _classes(c), plain), F.lit(True)
        elif t.kind == "iri_ref":
            o, refers = F.when(node, to).otherwise(_full(_text(e), c)), F.lit(True)
        else:
            o, refers = F.when(node, to).otherwise(_text(inner)), node
        named, child = p if p is not None else F.lit(RDF_TYPE if t.kind == "type" else t.iri), F.when(node, F.to_json(e))
        a, b = (o, s) if t.reverse else (s, o)
        kind = F.when(b.startswith("_:") & (refers | F.lit(t.reverse)), "bnode").when(refers | F.lit(t.reverse), "iri").otherwise("literal")
        return F.struct(a.alias("s"), named.alias("p"), b.alias("o"), kind.alias("o_kind"), F.when(~refers, F.coalesce(given, F.lit(t.datatype).cast("string"), datatype)).otherwise(null).alias("datatype"), F.when(~refers, lang).otherwise(null).alias("lang"), child.alias("child"), F.lit(at).alias("context"))

    return F.transform(each, entry)


def _others(s: Column, v: Column, c: Context, at: int) -> Column:
    """The triples of keys without a term, in the context's vocabulary or by a prefix."""
    known = [*c.terms, *(f"@{k}" for k in ("id", "type", "context", "graph", "value", "language"))]
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(known))
    plain = Term("", "", "plain")

    def of(x: Column) -> Column:
        name = expand_iri(x["key"], c.prefixes)
        p = F.when(name != x["key"], name).when(~name.contains(":"), F.concat(F.lit(c.vocab), name) if c.vocab else F.lit(None).cast("string"))
        return F.filter(_entries(s, x["value"], plain, c, at, p), lambda t: t["p"].isNotNull())

    return F.coalesce(F.flatten(F.transform(F.map_entries(fields), of)), F.array().cast(ENTRIES))


ENTRIES = "array<struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string,child:string,context:int>>"


def _contexts(c: Context) -> list[Context]:
    """c and the scoped contexts of its terms, theirs too."""
    out = [c]
    for t in c.terms.values():
        if t.nested:
            out += _contexts(t.nested)
    return out


def from_json(docs: DataFrame, context: dict | list | None = None, depth: int | None = None, known: dict[str, EntityClass] | None = None, max_contexts: int = 1000) -> DataFrame:
    """docs: doc, a JSON object, and perhaps iri, which names a node without an IRI of its own (as a blank node).

    Keys without a term or vocabulary are left out. The nodes of `@graph` are read as documents.
    Nodes may be nested at any depth; a level is written before the next is read. depth: raise an
    error for deeper ones. context None: each document's own `@context`; distinct ones are
    compiled by the driver, and more than max_contexts raise an error."""
    v = F.try_parse_json("doc")
    iri = F.concat(F.lit("_:"), F.col("iri")) if "iri" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(v.alias("v"), iri.alias("_iri"))
    if context is None:
        rows = rows.withColumn("_own", F.to_json(_at(F.col("v"), "@context")))
        own = [r["_own"] for r in rows.select("_own").where("_own is not null").distinct().limit(max_contexts + 1).collect()]
        if len(own) > max_contexts:
            raise ValueError(f"more than {max_contexts} contexts")
        parts = [_read(rows.where(F.col("_own") == x).drop("_own"), compile_context(json.loads(x), known), depth) for x in sorted(own)]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else rows.select(*(F.lit("").alias(k) for k in COLUMNS)).limit(0)
    return _read(rows, compile_context(context, known), depth)


def _read(rows: DataFrame, c: Context, depth: int | None) -> DataFrame:
    if not c.terms and not c.vocab and not c.prefixes:
        raise ValueError("the context has no terms")
    nodes = F.when(is_array(_at(F.col("v"), "@graph")), F.try_variant_get(F.col("v"), "$['@graph']", "array<variant>")).otherwise(F.array("v"))
    rows = rows.select("_iri", F.explode(nodes).alias("v"))
    own = _full(_at(F.col("v"), _keyword(c, "id"), "string"), c)
    contexts = _contexts(c)
    number = {id(x): k for k, x in enumerate(contexts)}
    level, out, k = rows.select(F.coalesce(own, "_iri", _node_iri(F.col("v"), c)).alias("n"), "v", F.lit(0).alias("context")), None, 0
    while level is not None:
        parts = []
        for x in contexts if k else contexts[:1]:
            made = [_entries(F.col("n"), _at(F.col("v"), t.name), t, x, number[id(t.nested or x)]) for t in x.terms.values() if t.kind in ("type", "iri_ref", "plain", "typed") and "*" not in t.name]
            if "type" not in {t.kind for t in x.terms.values()}:
                made.append(_entries(F.col("n"), _at(F.col("v"), "@type"), Term("@type", RDF_TYPE, "type"), x, number[id(x)]))
            if x.vocab or x.prefixes:
                made.append(_others(F.col("n"), F.col("v"), x, number[id(x)]))
            here = level.where(F.col("context") == number[id(x)]) if k else level
            parts.append(here.select(F.explode(F.concat(*made)).alias("t")).select("t.*"))
        rows = materialise(reduce(DataFrame.unionByName, parts))
        out = rows.select(*COLUMNS) if out is None else out.unionByName(rows.select(*COLUMNS))
        below, k = rows.where("child is not null"), k + 1
        if below.isEmpty():
            break
        if depth is not None and k > depth:
            raise ValueError("nodes are nested deeper than depth")
        v = F.parse_json("child")
        ids = [F.when(F.col("context") == number[id(x)], _node_iri(v, x)) for x in contexts]
        level = below.select(F.coalesce(*ids).alias("n"), v.alias("v"), "context")
    return out.distinct()


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return text.substr(F.lit(2), F.length(text) - 2)


def _object(fields: dict[str, Column]) -> Column:
    parts = [F.concat(F.concat(_quoted(F.lit(k)), F.lit(":")), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def compact(triples: DataFrame, context: dict | list, blank_ids: bool = True) -> DataFrame:
    """One row a subject: iri and doc, its JSON object in the context's terms, keys and values sorted.

    A value alone is a scalar unless its term is a set; blank_ids False leaves the ids of blank nodes out.
    A document is one row, so a subject's values must fit one."""
    c = compile_context(context)
    terms = {}
    for n, t in c.terms.items():
        if "*" not in n and not t.reverse and t.kind in ("iri_ref", "typed", "plain"):
            terms.setdefault(t.iri, t)
    p, o, lang, datatype = F.col("p"), F.col("o"), F.col("lang"), F.col("datatype")
    short = compact_iri(o, c.prefixes)
    is_type, refers = p == RDF_TYPE, F.col("o_kind") != "literal"
    term = F.when(is_type, F.lit(_keyword(c, "type"))).otherwise(_lookup(p, {i: t.name for i, t in terms.items()}, compact_iri(p, c.prefixes)))
    coerced = p.isin([i for i, t in terms.items() if t.kind == "iri_ref"])
    own_lang = _lookup(p, {i: t.lang for i, t in terms.items() if t.lang}, F.lit(None).cast("string"))
    own_type = _lookup(p, {i: t.datatype for i, t in terms.items() if t.datatype}, F.lit(None).cast("string"))
    native = datatype.isin(*(XSD + x for x in ("integer", "double", "boolean"))) & o.rlike(r"^(true|false|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)$")
    value = _quoted(o)
    literal = (
        F.when(lang.isNotNull() & ~lang.eqNullSafe(own_lang), _object({_keyword(c, "value"): value, _keyword(c, "language"): _quoted(lang)}))
        .when(datatype.isNotNull() & datatype.eqNullSafe(own_type), value)
        .when(native, o)
        .when(datatype.isNotNull() & (datatype != XSD + "string"), _object({_keyword(c, "value"): value, _keyword(c, "type"): _quoted(compact_iri(datatype, c.prefixes))}))
        .otherwise(value)
    )
    named = _lookup(o, {i: n for n, i in reversed(_classes(c).items())}, short)
    out = F.when(is_type, _quoted(named)).when(refers & coerced, _quoted(short)).when(refers, _object({_keyword(c, "id"): _quoted(short)})).otherwise(literal)
    always = F.col("k").isin([t.name for t in terms.values() if t.container_set])
    per = triples.select("s", term.alias("k"), out.alias("v")).groupBy("s", "k").agg(F.sort_array(F.collect_set("v")).alias("v"))
    text = F.when((F.size("v") > 1) | always, F.concat(F.lit("["), F.concat_ws(",", "v"), F.lit("]"))).otherwise(F.col("v")[0])
    docs = per.select("s", F.concat(_quoted(F.col("k")), F.lit(":"), text).alias("f")).groupBy("s").agg(F.collect_list("f").alias("f"))
    own = F.concat(_quoted(F.lit(_keyword(c, "id"))), F.lit(":"), _quoted(compact_iri(F.col("s"), c.prefixes)))
    own = own if blank_ids else F.when(~F.col("s").startswith("_:"), own)
    fields = F.sort_array(F.array_compact(F.concat(F.array(own), "f")))
    return docs.select(F.col("s").alias("iri"), F.concat(F.lit("{"), F.concat_ws(",", fields), F.lit("}")).alias("doc"))


def class_column(type_: Column, classes: list[EntityClass]) -> Column:
    """The name of the class that rows of this type are made as: its only controller, else its model; null for an unknown type."""
    names: dict[str, dict[bool, list[str]]] = {}
    for x in classes:
        for i in x.types if x.controller else x.iris:
            names.setdefault(i, {True: [], False: []})[x.controller].append(x.class_name)
    best = {i: k[True][0] if len(k[True]) == 1 else k[False][0] if k[False] else None for i, k in names.items()}
    return _lookup(type_, {i: n for i, n in best.items() if n}, F.lit(None).cast("string"))


def import_json(docs: DataFrame, classes: list[EntityClass]) -> dict[str | None, LinkedFrame]:
    """docs: iri, doc. The documents by class: each parsed into the fields of the class that its `type` names (of several types the first known).

    A row that a controller can't be made of, as it lacks one of its required fields, is made as its
    model. Documents of no known type, or that aren't objects, stay as they are under None."""
    v = F.try_parse_json("doc")
    types = F.when(is_array(_at(v, "type")), F.try_variant_get(v, "$.type", "array<string>")).otherwise(F.array(_at(v, "type", "string")))
    first = F.get(F.array_compact(F.transform(types, lambda x: class_column(x, classes))), 0)
    rows = docs.withColumn("_class", first)
    by_name = {x.class_name: x for x in classes}
    for x in classes:
        needed = [k for k, a in x.attributes.items() if a.required]
        if x.controller and needed:
            lacks = reduce(lambda p, q: p | q, (F.coalesce(_at(v, k).isNull() | F.is_variant_null(_at(v, k)), F.lit(True)) for k in needed))
            rows = rows.withColumn("_class", F.when((F.col("_class") == x.class_name) & lacks, F.lit(x.model().class_name)).otherwise(F.col("_class")))
            by_name.setdefault(x.model().class_name, x.model())
    out: dict[str | None, LinkedFrame] = {None: LinkedFrame(rows.where("_class is null").drop("_class"))}
    for name, x in by_name.items():
        parsed = F.from_json("doc", x.schema)
        # A single value of a list field is a list of one, and the other way round.
        fields = [F.coalesce(parsed[k], F.when(~is_array(_at(v, k)), F.array(F.try_variant_get(_at(v, k), "$", a.type.elementType.simpleString())))).alias(k) if a.many and not isinstance(a.type.elementType, (T.StructType, T.ArrayType)) else parsed[k].alias(k) for k, a in x.attributes.items()]
        out[name] = LinkedFrame(rows.where(F.col("_class") == name).select("iri", *fields), x)
    return out


def import_jsonld(triples: DataFrame, classes: list[EntityClass]) -> dict[str | None, LinkedFrame]:
    """The subjects of a graph by class: each compacted with its class's context, then as import_json(). Subjects of no known class stay compacted without terms, under None."""
    known = {x.class_name: x for x in classes}
    out: dict[str | None, LinkedFrame] = {}
    rest = triples
    for x in classes:
        context = class_context(x, known) | {"type": "@type"}
        compiled = compile_context(context, known)
        own = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin([compiled.expand(i) for i in x.iris])).select("s").distinct()
        parsed = import_json(compact(triples.join(own, "s", "left_semi"), context), [x])
        out[x.class_name] = parsed[x.class_name]
        rest = rest.join(own, "s", "left_anti")
    out[None] = LinkedFrame(compact(rest, {}))
    return out


def json_to_json(docs: DataFrame, context: dict, document_context: dict | None = None, depth: int | None = None) -> DataFrame:
    """docs: iri, doc. The documents in the terms of context, which names other spellings by aliases; nodes that had no id get none."""
    read = document_context or {k: v for k, v in context.items() if "*" not in k}
    return compact(transform(from_json(docs, read, depth), context), context, blank_ids=False)
