"""Entity classes: a name, fields with their linked-data meaning, and what they inherit. Driver-side only."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Field
from ..functions.jsonfn import merge_deep

_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "object": T.VariantType()}


@dataclass(frozen=True)
class Attribute:
    type: T.DataType
    range: str | None = None  # the class that an IRI field points to
    default: Any = None
    required: bool = False
    metadata: dict = field(default_factory=dict)

    @property
    def many(self) -> bool:
        return isinstance(self.type, T.ArrayType)


class EntityClass:
    """``Cls.name == "x"`` makes a condition; ``Cls.schema`` is its StructType."""

    def __init__(self, class_name: str, attributes: dict[str, Attribute], iris: list[str] | str = (), context: Any = None, parents: tuple[EntityClass, ...] = (), controller: bool = False, extras: dict | None = None):
        self.class_name, self.own, self.parents, self.controller, self.extras = class_name, attributes, parents, controller, extras or {}
        self.attributes: dict[str, Attribute] = {k: v for p in parents for k, v in p.attributes.items()} | attributes
        self.iris = list(dict.fromkeys([iris] if isinstance(iris, str) else iris)) or [class_name]
        self.context = context if context is not None else {}

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__") or name not in self.__dict__.get("attributes", {}) and name != "iri":
            raise AttributeError(name)
        return Field(name)

    def field(self, name: str) -> Field:
        """The field, also where an attribute of the class has its name."""
        if name not in self.attributes and name != "iri":
            raise AttributeError(name)
        return Field(name)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, a.type, not a.required, a.metadata | ({"range": a.range, "iri": True} if a.range else {})) for k, a in self.attributes.items()])

    @property
    def types(self) -> list[str]:
        """Class IRIs of the model bases, in order and without repeats; a controller has none of its own."""
        if not self.controller:
            return self.iris
        return list(dict.fromkeys(i for p in self.parents for i in p.types))

    def model(self) -> EntityClass:
        """The class without what controllers add."""
        if not self.controller:
            return self
        bases = [p.model() for p in self.parents]
        return bases[0] if len(bases) == 1 else EntityClass("+".join(b.class_name for b in bases), {}, self.types, self.context, tuple(bases))


class Documents:
    """Schema documents by their path, with references between them: `#/$defs/X`, `Other.json`, `sub/Other.json#/definitions/X`, `../X.yaml`."""

    def __init__(self, documents: dict[str, dict]):
        self.documents = {_normal(k): v for k, v in documents.items()}

    @classmethod
    def load(cls, folder: str) -> Documents:
        """The JSON and YAML files below a folder, by their paths in it."""
        root, out = Path(folder), {}
        for f in sorted(root.rglob("*")):
            if f.suffix == ".json":
                out[f.relative_to(root).as_posix()] = json.loads(f.read_text(encoding="utf-8"))
            elif f.suffix in (".yaml", ".yml"):
                import yaml

                out[f.relative_to(root).as_posix()] = yaml.safe_load(f.read_text(encoding="utf-8"))
        return cls(out)

    def find(self, ref: str, at: str) -> tuple[str, str]:
        """The document and pointer that ref means in document `at`; paths may be relative to it, to the root, or be a document's id."""
        path, _, pointer = ref.partition("#")
        if not path:
            return at, pointer
        for name in (_normal(posixpath.join(posixpath.dirname(at), path)), _normal(path)):
            for known in (name, *(f"{name}{x}" for x in (".json", ".yaml", ".yml"))):
                if known in self.documents:
                    return known, pointer
        for known, schema in self.documents.items():
            if path in (schema.get("$id"), schema.get("id")):
                return known, pointer
        raise KeyError(f"no schema {ref!r} seen from {at!r}")

    def get(self, path: str, pointer: str) -> dict:
        out: Any = self.documents[path]
        for key in filter(None, pointer.split("/")):
            out = out[key.replace("~1", "/").replace("~0", "~")]
        return out


def _normal(path: str) -> str:
    return posixpath.normpath(path).lstrip("/")


def _class_of(name: str) -> str:
    """A class's name in a reference: without folders and endings."""
    return posixpath.splitext(name.rsplit("/", 1)[-1])[0] or name


class Compiler:
    """Classes of schema documents: each once, parents before children; `classes` are known from elsewhere, by name."""

    def __init__(self, documents: Documents, classes: dict[str, EntityClass] | None = None):
        self.documents, self.classes, self.made, self.open = documents, classes or {}, {}, set()

    def compile(self, path: str, pointer: str = "") -> EntityClass:
        if (path, pointer) in self.made:
            return self.made[path, pointer]
        if (path, pointer) in self.open:
            raise ValueError(f"{path}#{pointer} inherits from itself")
        schema = self.documents.get(path, pointer)
        # A document whose root refers to one of its definitions is that definition.
        if "$ref" in schema and not schema.get("properties"):
            at, to = self.documents.find(schema["$ref"], path)
            inner = {k: v for k, v in schema.items() if k not in ("$ref", "$defs", "definitions")}
            schema = merge_deep(self.documents.get(at, to), inner)
            path = at
        self.open.add((path, pointer))
        own = [b for b in schema.get("allOf", ()) if "$ref" not in b]
        schema = reduce(merge_deep, own, schema)
        parents = tuple(self._parent(b["$ref"], path) for b in schema.get("allOf", ()) if "$ref" in b)
        required = set(schema.get("required", ()))
        attributes = {k: self.attribute(p, k in required and "default" not in p, path) for k, p in schema.get("properties", {}).items()}
        iris = [schema[k] for k in ("$id", "iri") if schema.get(k)]
        kind = schema.get("properties", {}).get("type", {}).get("default", [])
        name = schema.get("title") or (_class_of(pointer or path) if path else "Entity")
        extras = {k: v for k, v in schema.items() if k not in _STRUCTURE}
        made = EntityClass(name, attributes, [*iris[:1], *([kind] if isinstance(kind, str) else kind)], schema.get("@context"), parents, extras=extras)
        self.open.discard((path, pointer))
        self.made[path, pointer] = made
        return made

    def _parent(self, ref: str, at: str) -> EntityClass:
        try:
            return self.compile(*self.documents.find(ref, at))
        except KeyError:
            return self.classes[_class_of(ref)]

    def attribute(self, p: dict, required: bool, at: str) -> Attribute:
        p = self._flat(p, at)
        keep = {k: v for k, v in p.items() if k in _KEPT}
        target = p.get("range") or p.get("items", {}).get("range")
        if target:
            keep["range"] = target
        elif ref := p.get("$ref") or p.get("items", {}).get("$ref"):
            keep["embeds"] = _class_of(ref)
        return Attribute(self.type(p, at, ()), target and _class_of(target), p.get("default"), required, keep)

    def _flat(self, p: dict, at: str) -> dict:
        """A property with what it refers to, if that isn't an object, and with its allOf branches that don't refer."""
        if "$ref" in p and not p.get("range"):
            try:
                inner = self.documents.get(*self.documents.find(p["$ref"], at))
            except KeyError:
                return p
            if "properties" not in inner and "allOf" not in inner and "$ref" not in inner:
                return merge_deep(inner, {k: v for k, v in p.items() if k != "$ref"})
        return p

    def type(self, p: dict, at: str, seen: tuple) -> T.DataType:
        """seen: the references on the way here; one that comes back to itself is kept as a variant."""
        if p.get("range"):
            return T.StringType()
        if "$ref" in p:
            try:
                path, pointer = self.documents.find(p["$ref"], at)
                inner = self.documents.get(path, pointer)
            except KeyError:
                known = self.classes.get(_class_of(p["$ref"]))
                return known.schema if known else T.VariantType()
            if (path, pointer) in seen:
                return T.VariantType()
            return self.type(inner, path, (*seen, (path, pointer)))
        if p.get("allOf"):
            types = [self.type(b, at, seen) for b in [{k: v for k, v in p.items() if k != "allOf"}, *p["allOf"]] if b.get("properties") or b.get("type") or "$ref" in b or any(k in b for k in ("oneOf", "anyOf", "allOf"))]
            return reduce(lambda x, y: _union(x, y, False), types) if types else T.StringType()
        for word in ("oneOf", "anyOf"):
            if p.get(word):
                base = {k: v for k, v in p.items() if k != word}
                types = [self.type(merge_deep(base, b) if "$ref" not in b else b, at, seen) for b in p[word] if b.get("type") != "null"]
                return reduce(lambda x, y: _union(x, y, True), types) if types else T.StringType()
        kinds = [k for k in ([p["type"]] if isinstance(p.get("type"), str) else p.get("type", ())) if k != "null"]
        if not kinds:
            kinds = ["object"] if p.get("properties") else list(dict.fromkeys(_json_type(v) for v in p["enum"])) if p.get("enum") else ["string"]
        return reduce(lambda x, y: _union(x, y, True), [self._kind(k, p, at, seen) for k in kinds])

    def _kind(self, kind: str, p: dict, at: str, seen: tuple) -> T.DataType:
        if kind == "array":
            return T.ArrayType(self.type(p.get("items", {}), at, seen))
        if kind == "object" and p.get("properties"):
            return T.StructType([T.StructField(k, self.type(v, at, seen)) for k, v in p["properties"].items()])
        return _TYPES[kind]


#: Keys of a schema that aren't extras, and those of a property that are kept as metadata.
_STRUCTURE = ("title", "type", "properties", "required", "allOf", "oneOf", "anyOf", "$defs", "definitions", "$ref", "$id", "id", "iri", "@context")
_KEPT = ("title", "title*", "description", "description*", "enum", "x-enum-varnames", "x-enum-descriptions", "options", "format", "minimum", "maximum", "pattern")


def _json_type(v: Any) -> str:
    return {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "string"}.get(type(v), "object")


def _union(a: T.DataType, b: T.DataType, either: bool) -> T.DataType:
    """The type of values of a or b (either), or of what has both: objects get all fields, whole numbers go into doubles, anything else is a variant."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a}
        for f in b:
            fields[f.name] = _union(fields[f.name], f.dataType, either) if f.name in fields else f.dataType
        return T.StructType([T.StructField(k, t) for k, t in fields.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_union(a.elementType, b.elementType, either))
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType() if either else T.LongType()
    return T.VariantType()


def compile_schemas(documents: dict[str, dict] | Documents, classes: dict[str, EntityClass] | None = None) -> dict[str, EntityClass]:
    """The class of each document, by its path."""
    found = documents if isinstance(documents, Documents) else Documents(documents)
    compiler = Compiler(found, classes)
    return {path: compiler.compile(path) for path in found.documents}


def from_json_schema(schema: dict, classes: dict[str, EntityClass] | None = None) -> EntityClass:
    """The class of one schema: `range` makes IRI fields, `allOf` inherits, `$ref` and combined branches are followed; classes are those it refers to, by name."""
    return Compiler(Documents({"": schema}), classes).compile(_normal(""))


def enum_titles(a: Attribute) -> dict[Any, str]:
    """Of each value of an enumeration its title; the value itself, as text, without one."""
    values = a.metadata.get("enum", [])
    titles = a.metadata.get("options", {}).get("enum_titles") or a.metadata.get("x-enum-descriptions") or []
    return {v: titles[k] if k < len(titles) else str(v) for k, v in enumerate(values)}


def title_of(value: Column, a: Attribute) -> Column:
    """The title of a value, null for one outside the enumeration; a lookup in a literal map."""
    pairs = [F.lit(x) for pair in enum_titles(a).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")


def outside_enum(value: Column, a: Attribute) -> Column:
    """Whether the attribute is an enumeration that lacks the value; null counts as absent, not as outside."""
    values = a.metadata.get("enum")
    return F.coalesce(~value.isin(*values), F.lit(False)) if values else F.lit(False)


def to_json_schema(cls: EntityClass, full: bool = True, diff: bool = False, cutoff: EntityClass | None = None) -> dict:
    """full: with what it inherits; else its own fields, the parents by reference.

    cutoff: what this base class and its bases have is left out. diff: fields are
    left out that a parent has alike. A property of the class's own type refers
    to the root."""
    attributes = dict(cls.attributes if full else cls.own)
    if cutoff is not None:
        attributes = {k: a for k, a in attributes.items() if k not in cutoff.attributes}
    if diff:
        inherited = {k: v for p in cls.parents for k, v in p.attributes.items()}
        attributes = {k: a for k, a in attributes.items() if inherited.get(k) != a}
    out: dict = {"title": cls.class_name, "type": "object", "properties": {k: _property(a) for k, a in attributes.items()}} | cls.extras
    if cls.iris and cls.iris != [cls.class_name]:
        out["$id"] = cls.iris[0]
    parents = [p for p in cls.parents if p is not cutoff]
    if not full and parents:
        out["allOf"] = [{"$ref": f"{p.class_name}.json"} for p in parents]
        out["@context"] = [*(p.class_name for p in parents), *([cls.context] if cls.context else [])]
    elif cls.context:
        out["@context"] = cls.context
    if required := [k for k, a in attributes.items() if a.required]:
        out["required"] = required
    return out


def rooted(schema: dict) -> dict:
    """A schema as it is published: a root that is a `$ref` into its definitions is that definition, with references to it as `#`; `definitions` are `$defs`."""
    out = json.loads(json.dumps(schema).replace('"#/definitions/', '"#/$defs/'))
    defs = out.pop("definitions", {}) | out.pop("$defs", {})
    if isinstance(out.get("$ref"), str) and out["$ref"].startswith("#/$defs/") and out["$ref"][8:] in defs:
        name = out.pop("$ref")[8:]
        text = json.dumps([merge_deep(defs.pop(name), out), defs]).replace(json.dumps(f"#/$defs/{name}"), '"#"')
        out, defs = json.loads(text)
    return out | ({"$defs": defs} if defs else {})


def schema_text(schema: dict, kind: str = "json") -> str:
    """kind: json or yaml."""
    if kind == "yaml":
        import yaml

        return yaml.safe_dump(schema, sort_keys=False, allow_unicode=True)
    return json.dumps(schema, indent=2, ensure_ascii=False)


def _property(a: Attribute) -> dict:
    out = _of_type(a.type) | {k: v for k, v in a.metadata.items() if k != "embeds"}
    if "enum" in out:
        titles = list(enum_titles(a).values())
        out |= {"options": out.get("options", {}) | {"enum_titles": titles}, "x-enum-descriptions": titles}
    if a.range:
        target = out.pop("range", a.range)
        (out["items"] if a.many else out)["range"] = target
    return out | ({"default": a.default} if a.default is not None else {})


def _of_type(t: T.DataType) -> dict:
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": _of_type(t.elementType)}
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: _of_type(f.dataType) for f in t}}
    if isinstance(t, T.VariantType):
        return {}
    return {"type": next((k for k, v in _TYPES.items() if v == t), "string")}
