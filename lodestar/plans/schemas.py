"""Generated schemas: merged into a target schema, and folded out of its definitions again. Driver-side and pure."""

from __future__ import annotations

import warnings
from copy import deepcopy
from functools import reduce
from typing import Any

from ..functions.jsonfn import merge_contexts, merge_deep

# The section's key and the beginnings of its texts.
SECTION = "generated"
COMMENT = "Autogenerated section - do not edit. Generated from"
PARTIAL = "This is an autogenerated partial class definition of"


def _context(old: Any, new: Any) -> Any:
    """Two objects merge into one; anything else becomes a list in which neighbouring objects are one."""
    if isinstance(old, dict) and isinstance(new, dict):
        return merge_deep(old, new)
    parts = [x if isinstance(x, list) else [x] for x in (old, new) if x is not None]
    if len(parts) == 1 and not isinstance(new, list):
        return new
    return merge_contexts(reduce(merge_deep, parts))


def aggregate(target: dict, generated: dict[str, dict], at_root: bool = True, defs: str = "$defs", section: str = SECTION, root_ref: bool = False) -> dict:
    """The target with the generated schemas (by id): merged in at its root, or into one section of its
    definitions, to which the root then refers (root_ref: by `$ref`, else within `allOf`). Arguments stay as they are."""
    out, pointer = deepcopy(target), f"#/{defs}/{section}"
    if at_root:
        return reduce(merge_deep, deepcopy(list(generated.values())), out)
    for name, schema in generated.items():
        rest = {k: deepcopy(v) for k, v in schema.items() if k != "@context"}
        if "@context" in schema:
            out["@context"] = _context(out.get("@context"), deepcopy(schema["@context"]))
        sections = out.setdefault(defs, {})
        before = sections.get(section, {"$comment": COMMENT})
        sections[section] = merge_deep(before | {"$comment": f"{before['$comment']} {name}"}, rest)
        if root_ref:
            if out.setdefault("$ref", pointer) != pointer:
                warnings.warn(f"$ref is {out['$ref']!r} already", stacklevel=2)
            continue
        refs = out.setdefault("allOf", [])
        if all(x.get("$ref") != pointer for x in refs):
            refs.append({"$ref": pointer})
        if title := rest.get("title"):
            out["title"] = title
            sections[section] |= {"title": f"Generated{title}", "description": f"{PARTIAL} '{title}'"}
        if "description" in rest:
            out["description"] = rest["description"]
    return out


def fold(schema: dict) -> dict:
    """The schema with its generated section inlined where it refers to it, its own values first, and the section gone.

    Without a description of its own it takes the section's, of several languages English or else the first."""
    out, pointer = deepcopy(schema), f"#/$defs/{SECTION}"
    made = out.get("$defs", {}).pop(SECTION, None)
    if not made:
        return out
    refers = out.get("$ref") == pointer
    if refers:
        del out["$ref"]
    rest = [x for x in out.get("allOf", ()) if x.get("$ref") != pointer]
    if len(rest) < len(out.get("allOf", ())):
        refers, out["allOf"] = True, rest
    if not refers:
        return out
    texts = made.get("description*") or {}
    described = texts.get("en") or next(iter(texts.values()), made.get("description"))
    if not out.get("description") and described:
        out["description"] = described
    return merge_deep(made, out)
