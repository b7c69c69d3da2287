"""JSON-LD contexts compiled to term tables. Driver-side and pure."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .model import EntityClass

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
KEYWORDS = ("@id", "@type", "@value", "@language", "@graph", "@reverse", "@context", "@base", "@vocab")


@dataclass(frozen=True)
class Term:
    name: str
    iri: str
    kind: str  # id, type, value, language, iri_ref, typed, plain
    datatype: str | None = None
    lang: str | None = None
    container_set: bool = False
    reverse: bool = False
    nested: Context | None = None


class Context:
    def __init__(self, terms: dict[str, Term], prefixes: dict[str, str], base: str | None = None, vocab: str | None = None):
        self.terms, self.prefixes, self.base, self.vocab = terms, prefixes, base, vocab

    def expand(self, name: str) -> str:
        if name in KEYWORDS:
            return name
        if name in self.terms:
            return self.terms[name].iri
        prefix, colon, rest = name.partition(":")
        if colon and prefix in self.prefixes and not rest.startswith("//"):
            return self.prefixes[prefix] + rest
        return f"{self.vocab}{name}" if self.vocab and not colon else name

    def compact(self, iri: str) -> str:
        for t in self.terms.values():
            if t.iri == iri and t.kind not in ("id", "type") and not t.reverse:
                return t.name
        best = max((p for p, ns in self.prefixes.items() if iri.startswith(ns)), key=lambda p: len(self.prefixes[p]), default=None)
        return f"{best}:{iri[len(self.prefixes[best]):]}" if best is not None else iri


def _name(iri: str) -> str:
    """What names a class in an IRI of a wiki page or schema: the last segment, without namespace prefix and ending."""
    return iri.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")


def raw_context(context: Any, known: dict[str, EntityClass] | None = None, seen: tuple = ()) -> dict:
    """One object of a context given as an object, a class's name or IRI, or a list of both; the later wins.

    A class brings what it inherits. Names that aren't known bring nothing: contexts aren't fetched."""
    if isinstance(context, str):
        cls = (known or {}).get(context) or (known or {}).get(_name(context))
        if cls is None or cls.class_name in seen:
            return {}
        return _of_class(cls, known, (*seen, cls.class_name))
    if isinstance(context, list):
        out: dict = {}
        for x in context:
            out |= raw_context(x, known, seen)
        return out
    return dict(context or {})


def _of_class(cls: EntityClass, known: dict[str, EntityClass] | None, seen: tuple) -> dict:
    """The raw context of a class: its ancestors', farthest first, then its own."""
    out: dict = {}
    for p in cls.parents:
        if p.class_name not in seen:
            out |= _of_class(p, known, (*seen, p.class_name))
    return out | raw_context(cls.context, known, seen)


def compile_context(context: Any, known: dict[str, EntityClass] | None = None) -> Context:
    raw = raw_context(context, known)
    prefixes = {k: v for k, v in raw.items() if isinstance(v, str) and not v.startswith("@") and not k.startswith("@") and v[-1:] in "/#:"}
    table = Context({}, prefixes, raw.get("@base"), raw.get("@vocab"))

    def resolve(iri: str) -> str:
        return iri if iri in KEYWORDS else table.expand(iri)

    for name, spec in raw.items():
        if name in prefixes or name.startswith("@") or spec is None:
            continue
        if isinstance(spec, str):
            spec = {"@id": spec}
        reverse = "@reverse" in spec
        iri = resolve(spec.get("@reverse") or spec.get("@id") or name)
        kind = {"@id": "id", "@type": "type", "@value": "value", "@language": "language"}.get(iri)
        coercion = spec.get("@type")
        kind = kind or ("iri_ref" if coercion in ("@id", "@vocab") else "typed" if coercion else "plain")
        # The scoped context of a term adds to the one around it; its own scoped terms are compiled with it.
        nested = compile_context([{k: v for k, v in raw.items() if k != name}, raw_context(spec["@context"], known)], known) if "@context" in spec else None
        datatype = resolve(coercion) if kind == "typed" else None
        table.terms[name] = Term(name, iri, kind, datatype, spec.get("@language") or (raw.get("@language") if kind == "plain" and "@language" not in spec else None), spec.get("@container") == "@set", reverse, nested)
    return table


def of_class(cls: EntityClass, known: dict[str, EntityClass] | None = None) -> Context:
    """The context of a class: its ancestors', then its own; of fields that embed objects of a known class, scoped with that class's."""
    return compile_context(class_context(cls, known), known)


def class_context(cls: EntityClass, known: dict[str, EntityClass] | None = None, seen: tuple = ()) -> dict:
    """As of_class(), as a JSON-LD object. A class that embeds itself, at any depth, isn't scoped again."""
    raw = _of_class(cls, known, (cls.class_name,))
    for name, a in cls.attributes.items():
        target = (known or {}).get(a.metadata.get("embeds", ""))
        if target is None or a.range or name not in raw or target.class_name in (*seen, cls.class_name):
            continue
        spec = raw[name] if isinstance(raw[name], dict) else {"@id": raw[name]}
        raw[name] = spec | {"@context": class_context(target, known, (*seen, cls.class_name))}
    return raw
