"""Vocabulary transform by alias notation: a context key `T*` names another spelling of term T."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.context import RDF_TYPE, compile_context


def alias_table(context: dict) -> list[dict]:
    """alias IRI, base IRI, whether it is reversed, its language, datatype, whether its values are IRIs."""
    c, out = compile_context(context), []
    for name, t in c.terms.items():
        base = name.rstrip("*")
        if base == name:
            continue
        if base not in c.terms:
            raise ValueError(f"alias {name!r} has no term {base!r}")
        out.append({"alias": t.iri, "base": c.terms[base].iri, "reverse": t.reverse, "lang": t.lang, "datatype": t.datatype or c.terms[base].datatype, "as_iri": t.kind == "iri_ref"})
    return out


def transform(triples: DataFrame, context: dict) -> DataFrame:
    """One projection over the triples, then a set: renames predicates and classes, turns edges round, tags languages."""
    p, o, s = F.col("p"), F.col("o"), F.col("s")
    cols = {"p": p, "s": s, "o": o, "lang": F.col("lang"), "o_kind": F.col("o_kind"), "datatype": F.col("datatype")}
    for a in alias_table(context):
        hit = p == a["alias"]
        if a["reverse"]:
            hit = hit & (F.col("o_kind") != "literal")
            cols["s"], cols["o"] = F.when(hit, o).otherwise(cols["s"]), F.when(hit, s).otherwise(cols["o"])
            cols["o_kind"] = F.when(hit, F.when(s.startswith("_:"), "bnode").otherwise("iri")).otherwise(cols["o_kind"])
        if a["lang"]:
            cols["lang"] = F.when(hit & (F.col("o_kind") == "literal"), F.coalesce("lang", F.lit(a["lang"]))).otherwise(cols["lang"])
        if a["as_iri"]:
            cols["o_kind"] = F.when(hit, "iri").otherwise(cols["o_kind"])
            cols["datatype"] = F.when(~hit, cols["datatype"])
        elif a["datatype"]:
            cols["datatype"] = F.when(hit & (F.col("o_kind") == "literal"), F.lit(a["datatype"])).otherwise(cols["datatype"])
        cols["p"] = F.when(hit, a["base"]).otherwise(cols["p"])
        cols["o"] = F.when((p == RDF_TYPE) & (o == a["alias"]), a["base"]).otherwise(cols["o"])
    return triples.select(*(c.alias(k) for k, c in cols.items())).select(*triples.columns).distinct()
