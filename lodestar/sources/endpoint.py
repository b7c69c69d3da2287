"""Entities behind a SPARQL endpoint: a request of IRIs becomes triples, fetched by tasks in VALUES batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.context import RDF_TYPE

#: Fixed value: "instance of" in Wikidata.
WIKIDATA_TYPE = "http://www.wikidata.org/prop/direct/P31"
SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"


def fetch(request: DataFrame, endpoint: str, user: str | None = None, password: str | None = None, batch: int = 200, timeout: float = 60.0) -> DataFrame:
    """The triples of the request's iri values (full IRIs). An IRI the endpoint doesn't know has none, a null one is left out;
    one with characters that no IRI has raises an error. A failed request fails its task, which Spark runs again."""

    def ask(iris: list[str]) -> list[tuple]:
        import base64
        import json
        import re
        import urllib.parse
        import urllib.request

        for i in iris:
            if re.search(r'[\x00-\x20<>"{}|^`\\]', i):
                raise ValueError(f"not an IRI: {i!r}")
        values = " ".join(f"<{i}>" for i in iris)
        text = f"SELECT ?s ?p ?o WHERE {{ VALUES ?s {{ {values} }} ?s ?p ?o }}"
        headers = {"Accept": "application/sparql-results+json", "User-Agent": "lodestar"}
        if user is not None:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()
        call = urllib.request.Request(endpoint, urllib.parse.urlencode({"query": text}).encode(), headers)
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            rows = json.load(answer)["results"]["bindings"]
        kinds = {"uri": "iri", "bnode": "bnode"}
        name = lambda x: f"_:{x['value']}" if x["type"] == "bnode" else x["value"]
        return [(name(r["s"]), r["p"]["value"], name(r["o"]), kinds.get(r["o"]["type"], "literal"), r["o"].get("datatype"), r["o"].get("xml:lang")) for r in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            iris = pdf["iri"].tolist()
            for at in range(0, len(iris), batch):
                yield pd.DataFrame(ask(iris[at : at + batch]), columns=["s", "p", "o", "o_kind", "datatype", "lang"])

    return request.select("iri").where("iri is not null").distinct().mapInPandas(run, SCHEMA)


def typed(triples: DataFrame, predicate: str = WIKIDATA_TYPE) -> DataFrame:
    """A vocabulary's own type predicate becomes rdf:type."""
    return triples.withColumn("p", F.when(F.col("p") == predicate, RDF_TYPE).otherwise(F.col("p")))
