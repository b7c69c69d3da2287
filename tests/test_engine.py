"""The linked-data engine."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import jsonfn
from lodestar.functions.expr import Bool, Condition, compile_condition, parse_mini
from lodestar.operators.frame import LinkedFrame, best_match, construct
from lodestar.operators.transform import alias_table, transform
from lodestar.operators.triples import Graph, to_triples
from lodestar.plans import model
from lodestar.plans.context import XSD, compile_context
from lodestar.plans.model import Attribute, EntityClass, from_json_schema, to_json_schema
from lodestar.sources import credentials
from lodestar.sources.store import EntityStore, Registry, Source
from lodestar.streaming.upsert import BucketStore, upsert_batches

S = T.StringType()
Entity = EntityClass("Entity", {"name": Attribute(S), "links": Attribute(T.ArrayType(S), "Entity")}, "ex:Entity")
DOCS = {"ex:a": {"name": "A", "n": 1}, "ex:b": {"name": "B", "n": "1"}, "ex:c": {"n": True}, "ex:d": {"name": None}}


def iris(df):
    return sorted(r["iri"] for r in df.collect())


@pytest.mark.parametrize(("op", "want"), [("eq", ["ex:b"]), ("ne", ["ex:a", "ex:c", "ex:d"]), ("lt", ["ex:a"]), ("le", ["ex:a", "ex:b"]), ("gt", ["ex:c", "ex:d"]), ("ge", ["ex:b", "ex:c", "ex:d"])])
def test_six_operators(spark, op, want):
    df = spark.createDataFrame([(f"ex:{x}", x.upper()) for x in "abcd"], "iri string, name string")
    assert iris(EntityStore(df).query(Condition("name", op, "B"))) == want
    assert iris(LinkedFrame(df).filter(Condition("name", op, "B")).df) == want


def test_stores_agree(spark, tmp_path):
    path = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text(json.dumps(DOCS, indent=2))
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE entities (id TEXT PRIMARY KEY, data TEXT)")
        con.executemany("INSERT INTO entities VALUES (?, ?)", [(k, json.dumps(v)) for k, v in DOCS.items()])
    for s in (EntityStore.from_dict(spark, DOCS), EntityStore.from_json_file(spark, path), EntityStore.from_sqlite(spark, db)):
        assert iris(s.query(Condition("name", "eq", "A"))) == ["ex:a"]
        assert iris(s.query(Condition("n", "eq", 1))) == ["ex:a", "ex:c"]  # True == 1, "1" != 1
        assert iris(s.query(Condition("n", "ne", 1))) == ["ex:b"]  # absent never matches in a store
        assert iris(s.query(Condition("name", "eq", None))) == ["ex:d"]
        assert iris(s.query(Condition("n", "ne", 1), mode="list")) == ["ex:b", "ex:d"]
        got = {r["iri"]: r["doc"] for r in s.resolve(["ex:a", "ex:zz"]).collect()}
        assert set(got) == {"ex:a", "ex:zz"} and got["ex:zz"] is None
        assert iris(s.resolve(["ex:a", "ex:zz"], "drop")) == ["ex:a"]


def test_condition_tree():
    a, b = Condition("x", "eq", 1), Condition("y", "ne", "z")
    assert a & b == Bool("and", a, b) and (a | b).op == "or"
    assert parse_mini("@ name =='a==b'") == Condition("name", "eq", "a==b")
    for bad in (lambda: Condition("x", None, 1), lambda: Bool("xor", a, b), lambda: parse_mini("name==1")):
        with pytest.raises(ValueError):
            bad()


def test_strict_ordering_and_unknown_field(spark):
    df = spark.createDataFrame([("ex:a", "A")], "iri string, name string")
    assert df.where(compile_condition(Condition("name", "lt", 3), df.schema)).count() == 0
    with pytest.raises(Exception, match="no order"):
        df.where(compile_condition(Condition("name", "lt", 3), df.schema, strict=True)).collect()
    assert df.where(compile_condition(Condition("zz", "ne", 1), df.schema)).count() == 0
    assert df.where(compile_condition(Condition("zz", "ne", 1), df.schema, "list")).count() == 1


def test_upsert_and_registry(spark):
    s = EntityStore.from_dict(spark, DOCS)
    new = spark.createDataFrame([("ex:a", "{}", 1), ("ex:a", '{"v":2}', 2), ("ex:e", None, 1)], "iri string, doc string, seq int")
    out = {r["iri"]: r["doc"] for r in s.upsert(new, "seq").df.collect()}
    assert out["ex:a"] == '{"v":2}' and out["ex:e"] is None and len(out) == 5
    r = Registry().register("ex", s)
    assert [x["iri"] for x in r.resolve(spark, ["ex:b", "ex:a", "ex:b"], ["doc"]).orderBy("pos").collect()] == ["ex:b", "ex:a"]
    with pytest.raises(KeyError):
        r.resolve(spark, ["other:1"], ["doc"])


def test_navigation_and_lists(spark):
    df = spark.createDataFrame([("ex:port", "Port", []), ("ex:ferry", "Ferry", ["ex:port"]), ("ex:line", "Line 7", ["ex:port", "ex:ferry", "ex:lost"])], "iri string, name string, links array<string>")
    f = LinkedFrame(df, Entity)
    assert iris(f["ex:line"].follow("links", f)[Entity.name == "Ferry"].follow("links", f).df) == ["ex:port"]
    places = f["ex:line"].deref_list("links", f, {"name": "n"}).orderBy("pos").collect()
    assert [(r["ref"], r["n"]) for r in places] == [("ex:port", "Port"), ("ex:ferry", "Ferry"), ("ex:lost", None)]
    g = f.link("links", "ex:port").unlink("links", "ex:port")["ex:line"].df.first()["links"]
    assert g == ["ex:ferry", "ex:lost", "ex:port"]
    assert iris(f.dangling("links", f)) == ["ex:line"]
    assert f.iris("links").where("links is null").count() == 1


def test_cast_defaults_and_json(spark):
    a = EntityClass("Draft", {"pages": Attribute(T.DoubleType()), "state": Attribute(S, default="open")}, "ex:Draft")
    b = EntityClass("Book", {"type": Attribute(S, default="Book"), "pages": Attribute(T.DoubleType()), "cover": Attribute(S, default="hard")}, "ex:Book")
    f = LinkedFrame(spark.createDataFrame([("x", 12.0, "closed"), ("y", 7.0, None)], "iri string, pages double, state string"), a)
    assert [r["cover"] for r in f.cast(b).df.collect()] == ["hard", "hard"]
    assert f.cast(b, cover="soft").df.columns == ["iri", "type", "pages", "cover"]
    assert f.restore_defaults().df.where("iri = 'y'").first()["state"] == "open"
    assert f.restore_defaults().exclude_defaults().to_json().where("iri = 'y'").first()["doc"] == '{"pages":7.0}'


def test_triples_sparql_round_trip(spark):
    ns, voc = "https://town.example/", "https://words.example/"
    ctx = compile_context({"w": voc, "t": ns, "called": "w:called", "twins": {"@id": "w:twins", "@type": "@id", "@container": "@set"}})
    df = spark.createDataFrame([(ns + "Oslo", "Oslo", None), (ns + "Turku", "Turku", [ns + "Oslo"])], "iri string, called string, twins array<string>")
    g = Graph(to_triples(df, ctx, [ns + "Town"]), {"w": voc, "t": ns})
    assert g.df.count() == 5
    assert [tuple(r) for r in g.query("PREFIX k: <https://words.example/> SELECT ?c WHERE { ?x k:twins ?o . ?o k:called ?c }").collect()] == [("Oslo",)]
    docs = {r["s"]: r["props"] for r in g.documents().collect()}
    assert docs[ns + "Turku"][voc + "twins"] == [ns + "Oslo"]
    assert f'<{ns}Turku> <{voc}called> "Turku" .' in [r["value"] for r in g.n_triples().collect()]
    assert g.query("ASK { ?x w:twins t:Oslo }").first()["ask"]
    assert g.query("SELECT (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s ?p ?o }").first()["n"] == 2
    views = Graph.of_views([(df, ctx, [ns + "Town"])], {"w": voc})
    for p in (voc + "called", voc + "twins", "https://nowhere.example/p"):
        assert sorted(map(tuple, views.scan(p).collect())) == sorted(map(tuple, g.df.where(F.col("p") == p).collect()))


def test_transform(spark):
    ex = "https://shelf.example/"
    rows = [("b1", "shelvedAt", "s9"), ("b2", "standsIn", "s9"), ("b1", "heading", "Atlas"), ("b2", "title", "Index"), ("s9", "aisle", "4")]
    kind = lambda p: "iri" if p in ("shelvedAt", "standsIn") else "literal"
    t = spark.createDataFrame([(s, ex + p, o, kind(p), None, None) for s, p, o in rows], "s string, p string, o string, o_kind string, datatype string, lang string")
    ctx = {"x": ex, "title": "x:title", "title*": {"@id": "x:heading", "@language": "en"}, "holds": {"@id": "x:holds", "@type": "@id"}, "holds*": {"@reverse": "x:shelvedAt"}, "holds**": {"@reverse": "x:standsIn"}, "row": {"@id": "x:row", "@type": "x:int"}, "row*": "x:aisle"}
    got = {(r["s"], r["p"].removeprefix(ex), r["o"], r["lang"], r["datatype"]) for r in transform(t, ctx).collect()}
    assert got == {("s9", "holds", "b1", None, None), ("s9", "holds", "b2", None, None), ("b1", "title", "Atlas", "en", None), ("b2", "title", "Index", None, None), ("s9", "row", "4", None, ex + "int")}
    with pytest.raises(ValueError):
        alias_table({"z*": "x:z"})


def test_schema_compiler():
    room = from_json_schema({"title": "Room", "properties": {"type": {"type": "array", "items": {"type": "string"}, "default": ["Room"]}, "floor": {"type": "string"}}})
    hall = from_json_schema({"title": "Hall", "$id": "ex:Hall", "allOf": [{"$ref": "Room.json"}], "required": ["door"], "properties": {"door": {"type": "string", "range": "Room.json"}, "seats": {"type": ["integer", "null"], "default": 3}}}, {"Room": room})
    assert hall.schema["door"].metadata["range"] == "Room" and not hall.schema["door"].nullable and hall.attributes["seats"].default == 3
    assert hall.iris == ["ex:Hall"] and room.iris == ["Room"] and "floor" in hall.attributes
    part = to_json_schema(hall, full=False)
    assert part["allOf"] == [{"$ref": "Room.json"}] and part["required"] == ["door"] and part["properties"]["door"]["range"] == "Room.json"


def test_json_helpers(spark):
    assert jsonfn.merge_deep({"a": 1, "b": [1]}, {"a": 0, "b": [1, 2]}) == {"a": 1, "b": [1, 2]}
    assert jsonfn.merge_contexts(["/c", {"a": "x"}, {"b": "y"}]) == ["/c", {"a": "x", "b": "y"}]
    df = spark.createDataFrame([('{"b":1,"a":1.0}', '{"a":1,"b":1}', 'q"\n')], "x string, y string, z string")
    r = df.select(jsonfn.deep_equal(F.col("x"), F.col("y")), jsonfn.escape_json(F.col("z"))).first()
    assert r[0] and r[1] == 'q\\"\\n'


def test_credentials(spark):
    """The equal name, else the longest inside the address, else the shortest around it."""
    stored = ["data.example", "data.example/a", "data.example/a/b", "very.long.name.example/path"]
    want = {"https://data.example/a/b/c": stored[2], "ftp://data.example/z": stored[0], "data.example/a": stored[1], "name.example": stored[3]}
    df = spark.createDataFrame([(k,) for k in [*want, "nowhere.test"]], "u string")
    assert {r["u"]: r["k"] for r in best_match(df, "u", "u", stored).collect()} == want
    assert {k: credentials.find(k, stored) for k in want} == want
    with pytest.raises(KeyError):
        credentials.find("nowhere.test", stored)
    kinds = {"token": {"token": "t"}, "oauth2": {"access_token": "a", "refresh_token": "r"}, "oauth1": {f: "x" for f in credentials.KINDS["oauth1"]}, "user_pwd": {"username": "u", "password": "p", "token": "t"}, "certificate": {"cert_path": "c", "username": "u", "password": "p"}, "base": {"colour": "red"}}
    assert {credentials.infer("i", v).kind: k for k, v in kinds.items()} == {k: k for k in kinds}


def test_vault(tmp_path):
    a, b = str(tmp_path / "a.yaml"), str(tmp_path / "sub" / "b.yaml")
    credentials.dump([credentials.infer("x.org", {"token": "one"}), credentials.infer("y.org", {"username": "u", "password": "p"})], a)
    vault = credentials.Vault(a, b).add(credentials.infer("x.org/api", {"token": "two"}))
    assert dict(vault.get("https://x.org/api/v2").values) == {"token": "two"}
    assert dict(vault.get("https://x.org/other").values) == {"token": "one"}
    assert vault.get("y.org", exact=True).kind == "user_pwd" and "'p'" not in repr(vault.get("y.org"))
    with pytest.raises(KeyError):
        vault.get("https://x.org/api", exact=True)
    vault.save(b)
    assert [c.iri for c in credentials.load(b)] == ["x.org/api"]
    vault.save()
    assert {c.iri for c in credentials.load(a)} == {"x.org", "x.org/api", "y.org"}


def test_registry_upsert(spark):
    old = {p: spark.createDataFrame([(f"{p}:1", "old"), (f"{p}:2", "old")], "iri string, doc string") for p in ("a", "b")}
    registry = Registry()
    for p, df in old.items():
        registry.register(p, df)
    new = spark.createDataFrame([("a:1", "new", 1), ("a:1", "newer", 2), ("b:3", "new", 1)], "iri string, doc string, n int")
    got = sorted(tuple(r) for r in registry.upsert(new, "n").union(["iri", "doc"]).collect())
    assert got == [("a:1", "newer"), ("a:2", "old"), ("b:1", "old"), ("b:2", "old"), ("b:3", "new")]
    for iri in ("c:1", None):
        lost = spark.createDataFrame([(iri, "x")], "iri string, doc string")
        with pytest.raises(Exception, match="no store for"):
            registry.upsert(lost).union(["iri", "doc"]).collect()


def test_enumerations(spark):
    mood = {"type": "string", "enum": ["m:1", "m:2", "m:3"], "x-enum-varnames": ["CALM", "BUSY", "STORMY"], "options": {"enum_titles": ["Calm sea", "Busy sea"], "columns": 2}}
    cls = model.from_json_schema({"title": "Sea", "properties": {"mood": mood, "name": {"type": "string"}}})
    a = cls.attributes["mood"]
    df = spark.createDataFrame([("m:2",), ("m:3",), ("m:9",), (None,)], "mood string")
    got = [tuple(r) for r in df.select(model.title_of(F.col("mood"), a), model.outside_enum(F.col("mood"), a), model.title_of(F.col("mood"), cls.attributes["name"])).collect()]
    assert got == [("Busy sea", False, None), ("m:3", False, None), (None, True, None), (None, False, None)]
    out = model.to_json_schema(cls)["properties"]["mood"]
    assert out["x-enum-descriptions"] == out["options"]["enum_titles"] == ["Calm sea", "Busy sea", "m:3"]
    assert out["options"]["columns"] == 2 and out["x-enum-varnames"] == ["CALM", "BUSY", "STORMY"]
    assert model.from_json_schema({"title": "Sea", "properties": {"mood": out}}).attributes["mood"].metadata["enum"] == mood["enum"]


def test_combined_schemas():
    """Branches of scalars keep every value, references are followed, also back to themselves."""
    schema = {
        "title": "Part", "$defs": {"Size": {"type": "object", "properties": {"w": {"type": "number"}, "next": {"$ref": "#/$defs/Size"}}}, "Code": {"type": "string", "enum": ["a", "b"]}},
        "properties": {
            "either": {"oneOf": [{"type": "integer"}, {"type": "string"}]}, "some": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "wide": {"type": ["integer", "number"]},
            "shape": {"title": "Shape", "oneOf": [{"type": "object", "properties": {"r": {"type": "number"}}}, {"type": "object", "properties": {"a": {"type": "integer"}, "r": {"type": "integer"}}}]},
            "size": {"$ref": "#/$defs/Size"}, "sizes": {"type": "array", "items": {"$ref": "#/$defs/Size"}}, "code": {"$ref": "#/$defs/Code"}, "whole": {"allOf": [{"type": "object", "properties": {"x": {"type": "string"}}}, {"type": "object", "properties": {"y": {"type": "boolean"}}}]},
        },
    }
    types = {k: a.type.simpleString() for k, a in model.from_json_schema(schema).attributes.items()}
    size = "struct<w:double,next:variant>"
    assert types == {"either": "variant", "some": "bigint", "wide": "double", "shape": "struct<r:double,a:bigint>", "size": size, "sizes": f"array<{size}>", "code": "string", "whole": "struct<x:string,y:boolean>"}
    assert model.from_json_schema(schema).attributes["code"].metadata["enum"] == ["a", "b"]


def test_schemas_of_a_folder(tmp_path):
    """Relative references, folders, YAML, a root that refers to a definition, and parents of another document."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "Node.json").write_text(json.dumps({"title": "Node", "$id": "ex:Node", "properties": {"name": {"type": "string"}, "to": {"type": "array", "items": {"type": "string", "range": "sub/Leaf.yaml"}}}}))
    (tmp_path / "sub" / "Leaf.yaml").write_text("title: Leaf\nallOf:\n  - $ref: ../Node.json\nrequired: [at]\nproperties:\n  at: {type: string, range: ../Node.json}\n  box: {$ref: 'Box.json'}\n")
    (tmp_path / "sub" / "Box.json").write_text(json.dumps({"$ref": "#/definitions/Box", "definitions": {"Box": {"title": "Box", "type": "object", "properties": {"w": {"type": "integer"}}}}}))
    got = model.compile_schemas(model.Documents.load(str(tmp_path)))
    leaf = got["sub/Leaf.yaml"]
    assert leaf.parents == (got["Node.json"],) and list(leaf.attributes) == ["name", "to", "at", "box"]
    assert leaf.attributes["at"].range == "Node" and leaf.attributes["at"].required and leaf.attributes["to"].range == "Leaf"
    assert leaf.attributes["box"].type.simpleString() == "struct<w:bigint>" and got["sub/Box.json"].class_name == "Box"
    with pytest.raises(ValueError, match="itself"):
        model.compile_schemas({"A.json": {"allOf": [{"$ref": "A.json"}]}})


def test_schema_export():
    parent = EntityClass("P", {"a": Attribute(S), "b": Attribute(S, default="x")}, "ex:P")
    child = EntityClass("C", {"b": Attribute(S, default="y"), "c": Attribute(S)}, "ex:C", parents=(parent,), extras={"x-own": 1})
    assert set(to_json_schema(child)["properties"]) == {"a", "b", "c"} and to_json_schema(child)["x-own"] == 1
    assert set(to_json_schema(child, diff=True)["properties"]) == {"b", "c"} and set(to_json_schema(child, cutoff=parent)["properties"]) == {"c"}
    assert "allOf" not in to_json_schema(child, full=False, cutoff=parent)
    got = model.rooted({"$ref": "#/definitions/T", "definitions": {"T": {"type": "object", "properties": {"up": {"$ref": "#/definitions/T"}, "u": {"$ref": "#/definitions/U"}}}, "U": {"type": "string"}}})
    assert got == {"type": "object", "properties": {"up": {"$ref": "#"}, "u": {"$ref": "#/$defs/U"}}, "$defs": {"U": {"type": "string"}}}
    import yaml

    assert yaml.safe_load(model.schema_text(got, "yaml")) == json.loads(model.schema_text(got)) == got


def test_references_and_objects(spark):
    cls = EntityClass("Crew", {"name": Attribute(S), "boss": Attribute(S, "Crew", default="ex:none"), "mates": Attribute(T.ArrayType(S), "Crew")}, "ex:Crew")
    rows = [("ex:a", {"name": "A", "boss": "ex:b", "mates": ["ex:c", {"id": "ex:d", "name": "D"}]}), ("ex:b", {"name": None, "boss": {"iri": "ex:z", "name": "Z"}}), ("ex:c", {})]
    f = construct(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "iri string, doc string"), cls)
    got = {r["iri"]: (r["name"], r["boss"], r["mates"]) for r in f.df.collect()}
    assert got == {"ex:a": ("A", "ex:b", ["ex:c", "ex:d"]), "ex:b": (None, "ex:z", None), "ex:c": (None, "ex:none", None)}
    raw = {r["iri"]: r["boss"] for r in f.raw("boss").select("iri", F.to_json("boss").alias("boss")).collect()}
    assert raw == {"ex:a": None, "ex:b": '{"iri":"ex:z","name":"Z"}', "ex:c": None}
    whole = {r["iri"]: json.loads(r["doc"]) for r in f.raw_objects().collect()}
    assert whole["ex:b"] == {"boss": {"iri": "ex:z", "name": "Z"}} and whole["ex:a"]["boss"] == "ex:b" and whole["ex:c"] == {"boss": "ex:none"}
    held = spark.createDataFrame([("ex:a", ("ex:b", "B"), [(("ex:c", "C"), 1)])], "iri string, boss struct<iri:string,name:string>, mates array<struct<who:struct<id:string,name:string>,n:int>>")
    assert [tuple(r) for r in LinkedFrame(held).objects_to_iris().df.selectExpr("boss", "mates[0].who", "mates[0].n").collect()] == [("ex:b", "ex:c", 1)]
    assert f.copy(boss="ex:new").df.select("boss").distinct().collect()[0][0] == "ex:new"
    assert f.exclude_defaults().df.where("boss is null").count() == 0  # a reference isn't dropped


def test_lists_and_places(spark):
    df = spark.createDataFrame([("ex:1", None), ("ex:2", ["ex:1"])], "iri string, links array<string>")
    f = LinkedFrame(df, Entity)
    one = lambda g, iri="ex:1": g.by_iri(iri).df.first()["links"]
    assert one(f.link("links", "ex:9", None)) == ["ex:9"] and one(f.sync("links", F.array(F.lit("ex:1"), F.lit("ex:3"), F.lit(None))), "ex:2") == ["ex:1", "ex:3"]
    assert one(f.assign("links", ["ex:7"])) == ["ex:7"] and one(f.assign("links", None), "ex:2") is None
    with pytest.raises(KeyError):
        f.lookup("ex:9")
    many = LinkedFrame(spark.range(1000).select(F.concat(F.lit("ex:"), F.lpad("id", 4, "0")).alias("iri")).repartition(7)).positioned("iri")
    assert many.at(637).df.first()["iri"] == "ex:0637" and many.df.agg(F.sum("pos")).first()[0] == 499_500
    names = spark.createDataFrame([("ex:1", "One")], "iri string, name string")
    got = f.assign("links", ["ex:1", "ex:0", "ex:1"]).deref_as_list("links", LinkedFrame(names), "them").by_iri("ex:2").df.first()["them"]
    assert [x and x["name"] for x in got] == ["One", None, "One"]


def test_defaults_and_dumps(spark):
    cls = EntityClass("D", {"a": Attribute(S, default="x"), "b": Attribute(S)}, "ex:D")
    rows = spark.createDataFrame([("1", None, None, "{}"), ("2", None, "b", '{"a":null,"b":"b"}')], "iri string, a string, b string, doc string")
    assert [r["a"] for r in LinkedFrame(rows, cls).restore_defaults("doc").df.orderBy("iri").collect()] == ["x", None]
    f = LinkedFrame(rows.drop("doc"), cls)
    assert [r["doc"] for r in f.to_json(ignore_null=False, exclude=["b"]).orderBy("iri").collect()] == ['{"a":null}'] * 2
    assert [r["doc"] for r in f.restore_defaults().to_json(include=["a"], exclude_defaults=True).orderBy("iri").collect()] == ["{}"] * 2


def test_stores_write_what_they_read(spark, tmp_path):
    store = EntityStore.from_dict(spark, DOCS | {"ex:gone": None})
    store.export_json(str(tmp_path / "lines"))
    store.export_json(str(tmp_path / "one"), single=True)
    parsed = lambda s: {r["iri"]: r["doc"] and json.loads(r["doc"]) for r in s.df.collect()}
    assert parsed(EntityStore.from_json_file(spark, str(tmp_path / "lines"), lines=True)) == DOCS | {"ex:gone": None}
    assert parsed(EntityStore.from_json_file(spark, str(tmp_path / "one"))) == DOCS | {"ex:gone": None}
    assert json.loads(next((tmp_path / "one").glob("part-*")).read_text()) == DOCS | {"ex:gone": None}
    db = str(tmp_path / "new.db")
    store.to_sqlite(db)
    EntityStore.from_dict(spark, {"ex:a": {"name": "A2"}, "ex:new": {}}).to_sqlite(db)
    read = EntityStore.from_sqlite(spark, db)
    assert parsed(read) == DOCS | {"ex:gone": None, "ex:a": {"name": "A2"}, "ex:new": {}}
    assert [r["doc"] for r in read.get("ex:a").collect()] == ['{"name":"A2"}']
    empty = EntityStore.from_dict(spark, {"ex:a": {}})
    EntityStore(empty.df.limit(0)).export_json(str(tmp_path / "none"), single=True)
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == {}


def test_upsert_needs_an_order(spark):
    store = EntityStore(spark.createDataFrame([("ex:a", "old")], "iri string, doc string"))
    twice = spark.createDataFrame([("ex:a", "new"), ("ex:a", "new")], "iri string, doc string")
    assert [tuple(r) for r in store.upsert(twice).df.collect()] == [("ex:a", "new")]
    with pytest.raises(Exception, match="no order"):
        store.upsert(spark.createDataFrame([("ex:n", "1"), ("ex:n", "2")], "iri string, doc string")).df.collect()


def test_hooks_raise():
    for hook in (lambda s: s.resolve([]), lambda s: s.query(Condition("a", "eq", 1)), lambda s: s.upsert(None)):
        with pytest.raises(NotImplementedError):
            hook(Source())


def test_stream_of_upserts(spark, tmp_path):
    """Batches of a stream: the last of an iri by order counts, old rows stay, and a batch that runs again changes nothing."""
    path, source = str(tmp_path / "store"), str(tmp_path / "in")
    BucketStore(spark, path, 8).start(spark.createDataFrame([(f"ex:{k}", "old") for k in range(20)], "iri string, doc string"))
    schema = "iri string, doc string, seq int"
    for rows in ([("ex:1", "x", 1), ("ex:1", "y", 2), ("ex:99", "new", 1)], [("ex:1", "z", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    write = upsert_batches(spark, path, "seq", 8)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {f"ex:{k}": "old" for k in range(20)} | {"ex:1": "z", "ex:99": "new"}
    got = lambda: {r["iri"]: r["doc"] for r in BucketStore(spark, path, 8).read().collect()}
    assert got() == want
    write(spark.createDataFrame([("ex:1", "z", 3)], schema), 1)
    assert got() == want


def test_sparql_terms_and_groups(spark):
    t = [("ex:a", "ex:p", "ex:b", "iri", None, None), ("ex:b", "ex:q", "1", "literal", XSD + "integer", None), ("ex:c", "ex:p", "ex:b", "literal", None, None), ("ex:c", "ex:q", "1.0", "literal", XSD + "double", None), ("ex:c", "ex:l", "hi", "literal", None, "en")]
    g = Graph(spark.createDataFrame(t, "s string, p string, o string, o_kind string, datatype string, lang string"), {"ex": "ex:"})
    rows = lambda q: sorted(tuple(r) for r in g.query(q).collect())
    assert rows("SELECT ?s WHERE { ?s ex:p ?x . ?x ex:q ?y }") == [("ex:a",)]
    assert rows('SELECT ?s WHERE { ?s ex:p "ex:b" }') == [("ex:c",)] and rows("SELECT ?s WHERE { ?s ex:p <ex:b> }") == [("ex:a",)]
    assert rows('SELECT ?s WHERE { ?s ex:p ?o FILTER(?o = "ex:b") }') == [("ex:c",)] and rows("SELECT ?s WHERE { ?s ex:p ?o FILTER(?o != <ex:b>) }") == [("ex:c",)]
    assert rows("SELECT ?x ?y WHERE { ?x ex:q ?a . ?y ex:q ?b FILTER(?a = ?b) FILTER(?x != ?y) }") == [("ex:b", "ex:c"), ("ex:c", "ex:b")]
    assert rows('SELECT ?s WHERE { ?s ex:l "hi"@en }') == [("ex:c",)] and rows('SELECT ?s WHERE { ?s ex:l "hi" }') == []
    assert rows("SELECT ?s (COUNT(DISTINCT ?o) AS ?n) WHERE { ?s ex:p|ex:q ?o } GROUP BY ?s HAVING(?n > 1)") == [("ex:c", 2)]
    assert rows('SELECT ?s WHERE { ?s ex:p ?o FILTER(isIRI(?o)) }') == [("ex:a",)] and rows('SELECT ?s WHERE { ?s ?p ?o FILTER(LANG(?o) = "en") }') == [("ex:c",)]
    kept = {tuple(r) for r in g.query("CONSTRUCT { ?s ex:copy ?o } WHERE { ?s ex:q|ex:l|ex:p ?o }").collect()}
    assert kept == {(s, "ex:copy", *rest) for s, _, *rest in t}
    assert rows("SELECT ?s WHERE { ?s ex:p ?o FILTER EXISTS { ?u ex:l ?v } }") == [("ex:a",), ("ex:c",)] and rows("SELECT ?s WHERE { ?s ex:p ?o FILTER NOT EXISTS { ?u ex:l ?v } }") == []
    assert rows('SELECT ?s ?u WHERE { ?s ex:l ?o OPTIONAL { ?u ex:none ?v } }') == [("ex:c", None)]


def test_long_paths(spark):
    """A chain, whose rounds end by themselves, and a cycle."""
    n = 12
    t = [(f"ex:{k}", "ex:next", f"ex:{k + 1}", "iri", None, None) for k in range(n)] + [("ex:u", "ex:next", "ex:v", "iri", None, None), ("ex:v", "ex:next", "ex:u", "iri", None, None)]
    g = Graph(spark.createDataFrame(t, "s string, p string, o string, o_kind string, datatype string, lang string").coalesce(1), {"ex": "ex:"})
    assert g.query("SELECT ?o WHERE { <ex:0> ex:next+ ?o }").count() == n
    assert sorted(r[0] for r in g.query("SELECT ?o WHERE { <ex:u> ex:next+ ?o }").collect()) == ["ex:u", "ex:v"]


def test_merging_columns(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "", "c": "3", "a": "9"}, {"k": ['q"', "n\n"]})], "x map<string,string>, y map<string,string>, z map<string,array<string>>")
    assert df.select(jsonfn.merge_maps(F.col("x"), F.col("y"))).first()[0] == {"a": "9", "b": "2", "c": "3"}
    assert df.select(jsonfn.escape_json_deep(F.col("z"), df.schema["z"].dataType)).first()[0] == {"k": ['q\\"', "n\\n"]}
    assert [r[0] for r in spark.createDataFrame([("https://x",), ("ex:1",)], "i string").select(jsonfn.is_full_iri(F.col("i"))).collect()] == [True, False]
