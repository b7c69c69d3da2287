"""Merging generated schemas and folding them out again."""

import copy

import pytest

from lodestar.plans.schemas import COMMENT, aggregate, fold

REF = {"$ref": "#/$defs/generated"}


def test_at_root_the_generated_wins_unless_falsy():
    got = aggregate({"title": "A", "required": ["a"]}, {"x": {"title": "", "required": ["a", "b"]}, "y": {"type": "object"}})
    assert got == {"title": "A", "required": ["a", "b"], "type": "object"}


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [("/a", "/b", ["/a", "/b"]), ("/a", {"k": "v"}, ["/a", {"k": "v"}]), ("/a", ["/b", {"k": "v"}], ["/a", "/b", {"k": "v"}]), (["/a", {"k": "v"}], {"m": "w"}, ["/a", {"k": "v", "m": "w"}]), ({"k": "v"}, {"m": "w"}, {"k": "v", "m": "w"}), (["/a"], ["/a", {"k": "v"}], ["/a", {"k": "v"}]), (None, "/b", "/b"), (None, ["/b"], ["/b"])],
)
def test_contexts(old, new, want):
    target = {} if old is None else {"@context": old}
    assert aggregate(target, {"x": {"@context": new}}, at_root=False)["@context"] == want


def test_section_and_back():
    target, made = {"properties": {"a": {"type": "string"}}}, {"x": {"title": "T", "description": "d", "properties": {"b": {"type": "integer"}}}, "y": {"properties": {"c": {}}}}
    before = copy.deepcopy((target, made))
    got = aggregate(target, made, at_root=False)
    assert (target, made) == before
    section = got["$defs"]["generated"]
    assert section["$comment"] == f"{COMMENT} x y" and section["title"] == "GeneratedT" and set(section["properties"]) == {"b", "c"}
    assert got["allOf"] == [REF] and (got["title"], got["description"]) == ("T", "d")
    flat = fold(got)
    assert set(flat["properties"]) == {"a", "b", "c"} and flat["title"] == "T" and flat["allOf"] == [] and flat["$defs"] == {}
    assert aggregate({}, made, at_root=False, root_ref=True)["$ref"] == REF["$ref"]
    with pytest.warns(UserWarning):
        assert aggregate({"$ref": "#/other"}, {"x": {}}, at_root=False, root_ref=True)["$ref"] == "#/other"


def test_fold_prefers_english():
    section = {"title": "Generated", "description": "Generated schema", "description*": {"de": "Wirklich", "en": "Actual"}}
    got = fold({"$defs": {"generated": section}, **REF, "title": "Own"})
    assert (got["title"], got["description"]) == ("Own", "Actual") and "$ref" not in got
    assert fold({"$defs": {"generated": section}, "title": "Own"}) == {"$defs": {}, "title": "Own"}
    assert fold({"title": "x"}) == {"title": "x"}
