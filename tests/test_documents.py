"""JSON-LD documents, the vocabulary transform, and the endpoint source."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import types as T

from lodestar.operators.documents import compact, from_json, import_json, import_jsonld, json_to_json
from lodestar.operators.frame import LinkedFrame
from lodestar.operators.transform import transform
from lodestar.plans.context import RDF_TYPE
from lodestar.plans.model import Attribute, EntityClass
from lodestar.sources.endpoint import WIKIDATA_TYPE, fetch, typed

S = T.StringType()
BASE = {"ex": "https://another-example.org/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "schema": "https://schema.org/"}


def docs(df):
    return {r["iri"]: json.loads(r["doc"]) for r in df.collect()}


def test_documents_in_other_words(spark):
    """Terms and class names of one vocabulary come out in another's; nodes without an id stay apart by their rows."""
    df = spark.createDataFrame([("k1", '{"kind":"Vessel","called":"Aurora"}'), ("k2", '{"kind":"Vessel","called":"Aurora"}'), ("k3", None), ("k4", '{"kind":"Raft"}')], "iri string, doc string")
    source = BASE | {"called": "ex:called", "kind": "@type", "Vessel": "ex:Vessel"}
    target = BASE | {"name*": "ex:called", "name": "rdfs:label", "Ship*": "ex:Vessel", "Ship": "schema:Vehicle", "type": "@type"}
    got = docs(json_to_json(df, target, source))
    assert got == {f"_:{k}": {"type": "Ship", "name": "Aurora"} for k in ("k1", "k2")} | {"_:k4": {"type": "Raft"}}


def test_reversed_edges_and_languages(spark):
    """Rivers name what they flow into; seas list what flows into them, by two spellings of the edge, and have titles of a language."""
    c = BASE | {"id": "@id", "type": "@type"}
    link = lambda i: {"@id": i, "@type": "@id"}
    read = c | {"into": link("ex:into"), "ends": link("ex:endsIn"), "called": "ex:called", "depth": {"@id": "ex:depth", "@type": "ex:metre"}}
    rivers = [{"id": f"ex:r{k}", "type": "ex:River", "into" if k % 2 else "ends": "ex:sea"} for k in range(4)]
    nodes = [*rivers, {"id": "ex:sea", "type": "ex:Sea", "called": "Weites Meer", "depth": "70"}]
    write = c | {
        "text": "@value", "tongue": "@language", "inflow": {"@id": "ex:inflow", "@type": "@id", "@container": "@set"}, "inflow*": {"@reverse": "ex:into"}, "inflow**": {"@reverse": "ex:endsIn"},
        "title": {"@id": "rdfs:label", "@container": "@set"}, "title*": {"@id": "ex:called", "@language": "de"}, "deep": {"@id": "schema:depth", "@type": "schema:Distance"}, "deep*": "ex:depth",
    }
    got = docs(compact(transform(from_json(spark.createDataFrame([(json.dumps(n),) for n in nodes], "doc string"), read), write), write))
    sea = {"id": "ex:sea", "type": "ex:Sea", "title": [{"text": "Weites Meer", "tongue": "de"}], "inflow": [f"ex:r{k}" for k in range(4)], "deep": "70"}
    assert got == {BASE["ex"] + "sea": sea} | {BASE["ex"] + f"r{k}": {"id": f"ex:r{k}", "type": "ex:River"} for k in range(4)}


def test_values_round_trip(spark):
    context = BASE | {"id": "@id", "n": "ex:n", "x": "ex:x", "yes": "ex:yes", "day": {"@id": "ex:day", "@type": "ex:date"}, "title": {"@id": "ex:title", "@language": "de"}, "knows": {"@id": "ex:knows", "@type": "@id", "@container": "@set"}, "loose": "ex:loose"}
    doc = {"id": "ex:a", "n": 3, "x": [0.5, 2.25], "yes": True, "day": "2020-01-01", "title": "quo\"te\n", "knows": ["ex:b"], "loose": [{"@value": "hi", "@language": "en"}, {"id": "ex:c"}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,), ("[1]",)], "doc string")
    assert docs(compact(from_json(df, context), context)) == {BASE["ex"] + "a": doc}


def test_nested_nodes(spark):
    context = BASE | {"id": "@id", "name": "ex:name", "part": {"@id": "ex:part", "@type": "@id"}, "of": {"@reverse": "ex:has"}}
    df = spark.createDataFrame([('{"id":"ex:a","part":{"name":"p","part":{"id":"ex:q","name":"q"}},"of":{"id":"ex:z"}}',)], "doc string")
    rows = from_json(df, context).collect()
    by = {(r["p"].rsplit("/")[-1], r["o_kind"]): (r["s"], r["o"]) for r in rows}
    blank = by["part", "bnode"][1]
    assert by["part", "iri"] == (blank, BASE["ex"] + "q") and by["has", "iri"] == (BASE["ex"] + "z", BASE["ex"] + "a")
    assert len(rows) == 5 and {r["s"] for r in rows if r["o"] == "p"} == {blank}
    with pytest.raises(Exception, match="nested deeper"):
        from_json(df, context, depth=1).collect()
    deep = {"id": "ex:0"}
    for k in range(1, 9):
        deep = {"id": f"ex:{k}", "part": deep}
    assert from_json(spark.createDataFrame([(json.dumps(deep),)], "doc string"), context).count() == 8


def test_graphs_bases_vocabularies_and_scopes(spark):
    context = {"@base": "https://b.example/", "@vocab": "https://v.example/", "id": "@id", "of": {"@id": "https://v.example/of", "@type": "@id"}, "unit": {"@id": "https://v.example/unit", "@context": {"name": "https://u.example/name"}}}
    doc = {"@graph": [{"id": "one", "@type": "Thing", "of": "two", "name": "n", "unit": {"id": "m", "name": "metre"}}, {"id": "two", "size": 3}]}
    got = {(r["s"], r["p"], r["o"]) for r in from_json(spark.createDataFrame([(json.dumps(doc),)], "doc string"), context).collect()}
    b, v = "https://b.example/", "https://v.example/"
    assert got == {(b + "one", RDF_TYPE, v + "Thing"), (b + "one", v + "of", b + "two"), (b + "one", v + "name", "n"), (b + "one", v + "unit", b + "m"), (b + "m", "https://u.example/name", "metre"), (b + "two", v + "size", "3")}


def test_contexts_within_documents(spark):
    rows = [json.dumps({"@context": {"n": f"https://{k}.example/n"}, "@id": f"ex:{k}", "n": k}) for k in "ab"] + ['{"n":"no context"}']
    got = {(r["s"], r["p"], r["o"]) for r in from_json(spark.createDataFrame([(x,) for x in rows], "doc string")).collect()}
    assert got == {(f"ex:{k}", f"https://{k}.example/n", k) for k in "ab"}
    with pytest.raises(ValueError, match="contexts"):
        from_json(spark.createDataFrame([(x,) for x in rows], "doc string"), max_contexts=1)


def test_documents_become_classes(spark):
    thing = EntityClass("Thing", {"type": Attribute(S), "name": Attribute(S), "tags": Attribute(T.ArrayType(S))}, "ex:Thing", BASE | {"name": "ex:name", "tags": "ex:tags"})
    tool = EntityClass("Tool", {"size": Attribute(T.LongType())}, "ex:Tool", {"size": "ex:size"}, (thing,))
    made = EntityClass("ToolDriver", {"port": Attribute(S, required=True)}, parents=(tool,), controller=True)
    rows = [("a", {"type": "ex:Thing", "name": "A", "tags": "x"}), ("b", {"type": ["ex:Nope", "ex:Tool"], "size": 3, "port": "p"}), ("c", {"type": "ex:Tool", "size": 4}), ("d", {"type": "ex:Other"}), ("e", None)]
    got = import_json(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "iri string, doc string"), [thing, tool, made])
    assert [tuple(r) for r in got["Thing"].df.collect()] == [("a", "ex:Thing", "A", ["x"])]
    assert [(r["iri"], r["size"], r["port"]) for r in got["ToolDriver"].df.collect()] == [("b", 3, "p")]
    assert [(r["iri"], r["size"]) for r in got["Tool"].df.collect()] == [("c", 4)]  # without a port it is no driver
    assert sorted(r["iri"] for r in got[None].df.collect()) == ["d", "e"]
    ns = BASE["ex"]
    t = [(ns + "a", RDF_TYPE, ns + "Thing", "iri"), (ns + "a", ns + "name", "A", "literal"), (ns + "b", RDF_TYPE, ns + "Tool", "iri"), (ns + "b", ns + "name", "B", "literal"), (ns + "z", ns + "name", "Z", "literal")]
    triples = spark.createDataFrame([(*x, None, None) for x in t], "s string, p string, o string, o_kind string, datatype string, lang string")
    got = import_jsonld(triples, [thing, tool])
    assert [(r["iri"], r["name"]) for r in got["Thing"].df.collect()] == [(ns + "a", "A")]
    assert [(r["iri"], r["name"]) for r in got["Tool"].df.collect()] == [(ns + "b", "B")] and [r["iri"] for r in got[None].df.collect()] == [ns + "z"]


def test_entities_as_documents(spark):
    base = EntityClass("Base", {"type": Attribute(S), "name": Attribute(S)}, "ex:Base", BASE | {"name": "ex:name"})
    mid = EntityClass("Mid", {"part": Attribute(S, "Base")}, "ex:Mid", {"part": {"@id": "ex:part", "@type": "@id"}}, (base,))
    leaf = EntityClass("Leaf", {"n": Attribute(T.LongType())}, "ex:Leaf", {"n": "ex:n"}, (mid,))
    driven = EntityClass("LeafDriver", {"session": Attribute(S)}, parents=(leaf,), controller=True)
    ns = BASE["ex"]
    df = spark.createDataFrame([(ns + "x", "X", ns + "y", 3, "open")], "iri string, name string, part string, n long, session string")
    assert docs(LinkedFrame(df, driven).to_jsonld()) == {ns + "x": {"id": "ex:x", "type": "ex:Leaf", "name": "X", "part": "ex:y", "n": 3}}


def test_endpoint(spark):
    known = {"http://e/a": [("http://e/name", {"type": "literal", "value": "A", "xml:lang": "en"}), (WIKIDATA_TYPE, {"type": "uri", "value": "http://e/T"})]}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            rows = [{"s": {"type": "uri", "value": i}, "p": {"type": "uri", "value": p}, "o": o} for i, po in known.items() if f"<{i}>" in query for p, o in po]
            self.send_response(200 if self.headers["Authorization"] == "Basic dTpw" else 401)
            self.end_headers()
            self.wfile.write(json.dumps({"results": {"bindings": rows}}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/sparql"
        df = spark.createDataFrame([("http://e/a",), ("http://e/b",), ("http://e/a",), (None,)], "iri string")
        got = {tuple(r) for r in typed(fetch(df, url, "u", "p", batch=1)).collect()}
        assert got == {("http://e/a", "http://e/name", "A", "literal", None, "en"), ("http://e/a", RDF_TYPE, "http://e/T", "iri", None, None)}
        with pytest.raises(Exception, match="not an IRI"):
            fetch(spark.createDataFrame([("http://e/> }",)], "iri string"), url, "u", "p").collect()
    finally:
        server.shutdown()
