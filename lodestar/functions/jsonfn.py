"""JSON, array and IRI helpers, on columns and on the driver's schemas."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(c: Column) -> Column:
    """Keys sorted, numbers in one spelling."""
    return F.to_json(F.parse_json(c))


def deep_equal(a: Column, b: Column) -> Column:
    return canonical_json(a).eqNullSafe(canonical_json(b))


def unique_array(c: Column) -> Column:
    return F.array_distinct(c)


def field(doc: Column, key: str, kind: str = "variant") -> Column:
    """A top-level field of a JSON document, by its exact key."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(F.try_parse_json(doc), f"$['{quoted}']", kind)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT<")


def is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY<")


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def escape_json(c: Column) -> Column:
    """The string as it stands inside JSON quotes."""
    return F.regexp_extract(F.to_json(F.array(c)), r'(?s)^\["(.*)"\]$', 1)


def escape_json_deep(c: Column, t: T.DataType) -> Column:
    """Every string in a value of type t, at any depth, as it stands inside JSON quotes."""
    if isinstance(t, T.StringType):
        return escape_json(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: escape_json_deep(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, x: escape_json_deep(x, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(escape_json_deep(c[f.name], f.dataType).alias(f.name) for f in t)))
    return c


def merge_maps(target: Column, source: Column) -> Column:
    """source wins unless its value is null or empty."""
    both = F.map_zip_with(F.coalesce(target, F.create_map().cast("map<string,string>")), F.coalesce(source, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(F.when(b != "", b), a))
    return both


def merge_deep(target: Any, source: Any) -> Any:
    """Objects by key, arrays joined without repeats, a falsy source never wins. Pure."""
    if isinstance(target, dict) and isinstance(source, dict):
        out = dict(target)
        for k, v in source.items():
            out[k] = merge_deep(target[k], v) if k in target else v
        return out
    if isinstance(target, list) and isinstance(source, list):
        seen, out = set(), []
        for x in [*target, *source]:
            key = json.dumps(x, sort_keys=True)
            if key not in seen:
                seen.add(key)
                out.append(x)
        return out
    return source or target


def merge_contexts(context: list) -> list:
    """Neighbouring objects of a context list become one; strings keep their places."""
    out: list = []
    for x in context:
        if isinstance(x, dict) and out and isinstance(out[-1], dict):
            out[-1] = {**out[-1], **x}
        else:
            out.append(x)
    return out


def prefix_of(iri: Column) -> Column:
    return F.substring_index(iri, ":", 1)


def is_full_iri(iri: Column) -> Column:
    return iri.startswith("http")


def url_tail(url: Column) -> Column:
    """The last segment of the path, up to a question mark."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def expand_iri(iri: Column, prefixes: dict[str, str]) -> Column:
    out = iri
    for p, ns in prefixes.items():
        out = F.when(iri.startswith(f"{p}:"), F.concat(F.lit(ns), F.substr(iri, F.lit(len(p) + 2)))).otherwise(out)
    return out


def compact_iri(iri: Column, prefixes: dict[str, str]) -> Column:
    """By the longest namespace that it starts with."""
    out = iri
    for p, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(f"{p}:"), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
    return out
