"""The registered queries: each goes through the engine's API; oracle.sql has the same results in SQL."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfn
from ..functions.expr import Condition
from ..operators.documents import import_json
from ..operators.frame import LinkedFrame, best_match
from ..operators.transform import transform
from ..operators.triples import Graph, to_triples
from ..sources.store import EntityStore, Registry, first_found, request, resolve_type
from .context import compile_context, of_class
from .model import Attribute, EntityClass, title_of

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()  # noqa: E741
PREFIXES = {"ex": "http://example.org/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "schema": "https://schema.org/"}


def _context(**terms) -> dict:
    return PREFIXES | {k: {"@id": f"ex:{v}", "@type": "@id"} if ref else f"ex:{v}" for k, (v, ref) in terms.items()}


Region = EntityClass("Region", {"name": Attribute(S)}, "ex:Region", _context(name=("name", False)))
Nation = EntityClass("Nation", {"name": Attribute(S), "region": Attribute(S, "Region", required=True)}, "ex:Nation", _context(name=("name", False), region=("region", True)))
Customer = EntityClass("Customer", {"name": Attribute(S), "nation": Attribute(S, "Nation"), "nationkey": Attribute(I), "acctbal": Attribute(D), "mktsegment": Attribute(S)}, "ex:Customer", _context(name=("name", False), nation=("nation", True), mktsegment=("segment", False)))
Supplier = EntityClass("Supplier", {"name": Attribute(S), "nation": Attribute(S, "Nation"), "acctbal": Attribute(D)}, "ex:Supplier", _context(name=("name", False), nation=("nation", True), acctbal=("acctbal", False)))
Order = EntityClass("Order", {"customer": Attribute(S, "Customer"), "orderstatus": Attribute(S, default="O"), "totalprice": Attribute(D), "orderpriority": Attribute(S)}, "ex:Order", _context(customer=("customer", True), totalprice=("total", False), orderpriority=("priority", False)))
Event = EntityClass("Event", {"kind": Attribute(S, default="unknown"), "amount": Attribute(D, default=0.0), "usr": Attribute(S, "Customer", required=True)}, "ex:Event")
Party = EntityClass("Party", {"type": Attribute(S, default="Party"), "name": Attribute(S)}, "Party")
CustomerController = EntityClass("CustomerController", {"session": Attribute(S)}, parents=(EntityClass("PlainCustomer", {"name": Attribute(S)}, "ex:PlainCustomer"),), controller=True)
_A = EntityClass("A", {"type": Attribute(T.ArrayType(S))}, "ex:A")
_B = EntityClass("B", {"type": Attribute(T.ArrayType(S))}, ["ex:B", "ex:A"])
AB = EntityClass("AB", {}, parents=(_A, _B), controller=True)


class Views:
    """Typed views of the tables; IRIs are computed, columns pruned by Catalyst."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")

    def _view(self, table: str, key: str, prefix: str, cls: EntityClass | None, **cols: Column | str) -> LinkedFrame:
        t = self.table(table)
        return LinkedFrame(t.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("iri"), *((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items())), cls)

    @property
    def region(self) -> LinkedFrame:
        return self._view("region", "r_regionkey", "region", Region, name="r_name")

    @property
    def nation(self) -> LinkedFrame:
        return self._view("nation", "n_nationkey", "nation", Nation, name="n_name", region=_iri("region", "n_regionkey"), id="n_nationkey")

    @property
    def customer(self) -> LinkedFrame:
        return self._view("customer", "c_custkey", "customer", Customer, name="c_name", nation=_iri("nation", "c_nationkey"), nationkey="c_nationkey", acctbal="c_acctbal", mktsegment="c_mktsegment", custkey="c_custkey")

    @property
    def supplier(self) -> LinkedFrame:
        return self._view("supplier", "s_suppkey", "supplier", Supplier, name="s_name", nation=_iri("nation", "s_nationkey"), acctbal="s_acctbal")

    @property
    def order(self) -> LinkedFrame:
        return self._view("orders", "o_orderkey", "order", Order, customer=_iri("customer", "o_custkey"), orderstatus="o_orderstatus", totalprice="o_totalprice", orderpriority="o_orderpriority")

    @property
    def part(self) -> LinkedFrame:
        return self._view("part", "p_partkey", "part", None, size="p_size")

    @property
    def event(self) -> LinkedFrame:
        kind = F.when(F.col("event_type") != "error", F.col("event_type"))
        usr = _iri("customer", "user_id")
        return self._view("events", "event_id", "event", Event, event_id="event_id", event_type="event_type", kind=kind, value="value", amount=F.when(F.col("event_type") == "purchase", F.col("value")), user=usr, usr=F.when(F.col("event_type") != "error", usr), k=jsonfn.field(F.col("props"), "k"))

    def graph(self, *names: str, distinct: bool = False) -> Graph:
        """These views as triples; keys are unique, so that a union is a set already."""
        views = [(getattr(self, n).df, of_class(getattr(self, n).cls), [PREFIXES["ex"] + getattr(self, n).cls.class_name]) for n in names]
        return Graph.of_views(views, PREFIXES, distinct)


def _iri(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, d: f(Views(spark, d))
    return f


def _short(c: str | Column) -> Column:
    return jsonfn.compact_iri(F.col(c) if isinstance(c, str) else c, PREFIXES)


@query
def resolve_one(v):
    return EntityStore(v.customer.df).get("customer:17").select("iri", "name")


@query
def resolve_batch_keep_missing(v):
    store = Registry().register("customer", v.customer.df.select("iri", "name"))
    return store.resolve(v.spark, ["customer:5", "customer:2", "customer:999999999"], ["name"]).select("pos", "iri", "name")


@query
def resolve_batch_drop_missing(v):
    return EntityStore(v.customer.df).resolve(["customer:5", "customer:2", "customer:999999999"], "drop").select("iri", "name")


def _registry(v) -> Registry:
    typed = lambda f: f.df.withColumn("type", F.lit(f.cls.class_name))
    return Registry().register("region", typed(v.region)).register("nation", typed(v.nation))


@query
def resolve_polymorphic(v):
    return _registry(v).union(["iri", "type", "name"])


@query
def route_by_prefix(v):
    r = Registry().register("region", v.region.df).register("nation", v.nation.df).register("supplier", v.supplier.df)
    return r.union(["iri"]).groupBy(jsonfn.prefix_of(F.col("iri")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query
def fanout_union_dups(v):
    return Registry().register("nation", v.nation.df).register("n", v.nation.df).query(Nation.name == "NATION_3", ["iri", "name"])


@query
def first_non_null_store(v):
    low = EntityStore(v.nation.df.where("id < 10"))
    return first_found(request(v.spark, ["nation:3", "nation:20"]).select("iri"), [low, EntityStore(v.nation.df)], "name")


@query
def filter_eq(v):
    return EntityStore(v.customer.df).query(Customer.mktsegment == "BUILDING").select("iri")


@query
def filter_ne_store_semantics(v):
    return EntityStore(v.event.df).query(Event.kind != "view").select("event_id")


@query
def filter_ne_list_semantics(v):
    return v.event[Event.kind != "view"].df.select("event_id")


@query
def filter_lt(v):
    return v.part[Condition("size", "lt", 10)].df.select("iri")


@query
def filter_le_string(v):
    return v.nation[Nation.name <= "NATION_15"].df.select("iri")


@query
def filter_gt(v):
    return v.customer[Customer.acctbal > 5000.0].df.select("iri")


@query
def filter_ge(v):
    return v.event[Condition("value", "ge", 100.0)].df.select("event_id")


@query
def filter_and(v):
    return EntityStore(v.customer.df).query((Customer.mktsegment == "BUILDING") & (Customer.acctbal > 5000.0)).select("iri", "name")


@query
def filter_or(v):
    return EntityStore(v.customer.df).query((Customer.mktsegment == "BUILDING") | (Customer.nationkey == 3)).select("iri")


@query
def filter_nested_bool(v):
    segment = (Customer.mktsegment == "BUILDING") | (Customer.mktsegment == "MACHINERY")
    return v.customer[segment & ((Customer.acctbal < 0.0) | (Customer.nationkey == 7))].df.select("iri")


@query
def filter_string_mini_query(v):
    return v.nation["@name=='NATION_7'"].df.select("iri")


def _event_docs(v) -> EntityStore:
    return EntityStore(v.table("events").select(F.col("event_id").alias("iri"), F.col("props").alias("doc")))


@query
def filter_json_number(v):
    return _event_docs(v).query(Condition("k", "ge", 90)).select(F.col("iri").alias("event_id"))


@query
def filter_json_type_guard(v):
    return _event_docs(v).query(Condition("k", "eq", "69")).agg(F.count(F.lit(1)).alias("n"))


@query
def filter_json_key_presence(v):
    return _event_docs(v).query(Condition("k", "ne", None)).agg(F.count(F.lit(1)).alias("n"))


@query
def list_lookup_iri(v):
    return v.supplier["supplier:3"].df.select("iri", "name")


@query
def deref_one(v):
    return v.order.deref("customer", v.customer, {"name": "customer_name"}).df.select("iri", "customer_name")


@query
def deref_missing_keeps_iri(v):
    rows = v.spark.createDataFrame([("x:1", "nation:4"), ("x:2", "nation:777")], "iri string, ref string")
    return LinkedFrame(rows).deref("ref", v.nation, {"name": "ref_name"}).df


@query
def deref_list_positional(v):
    rows = v.spark.createDataFrame([("x:1", ["nation:4", "nation:777", "nation:2", "nation:4"])], "iri string, refs array<string>")
    return LinkedFrame(rows).deref_list("refs", v.nation, {"name": "ref_name"})


@query
def nav_three_hop(v):
    f = v.order.deref("customer", v.customer, {"nation": "_n"}).deref("_n", v.nation, {"name": "nation", "region": "_r"}).deref("_r", v.region, {"name": "region"})
    return f.df.where("region is not null").groupBy("region", "nation").agg(F.count(F.lit(1)).alias("n_orders"))


@query
def nav_chain_filter(v):
    nations = v.region[Region.name == "ASIA"].follow_back(v.nation, "region")
    return nations[Nation.name == "NATION_2"].follow_back(v.customer, "nation")[Customer.mktsegment == "BUILDING"].df.select("iri")


@query
def flatmap_projection(v):
    return v.region[Region.name == "ASIA"].follow_back(v.nation, "region").flatmap("name")


@query
def flatmap_keeps_null_scalar(v):
    return v.event[Condition("user", "eq", "customer:13")].flatmap("amount")


@query
def iri_only_projection(v):
    return v.order[Order.orderstatus == "F"].iris("customer")


@query
def bgp_two_hop(v):
    return v.graph("customer", "nation").query("SELECT ?s_name ?o_name WHERE { ?c a ex:Customer ; ex:name ?s_name ; ex:nation ?n . ?n ex:name ?o_name }")


@query
def bgp_three_hop(v):
    return v.graph("supplier", "nation", "region").query("SELECT DISTINCT ?supplier ?region WHERE { ?s a ex:Supplier . ?s ex:name ?supplier . ?s ex:nation ?n . ?n ex:region ?r . ?r ex:name ?region }")


@query
def bgp_star(v):
    return v.graph("customer").star({"name": PREFIXES["ex"] + "name", "segment": PREFIXES["ex"] + "segment", "nation": PREFIXES["ex"] + "nation"}).select("s", "name", "segment", "nation")


@query
def construct_subject(v):
    df = v.graph("nation").query("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o FILTER(?s = <nation:3>) }")
    return df.select("s", _short("p").alias("p"), _short("o").alias("o"))


@query
def triples_per_predicate(v):
    return v.graph("customer", "nation").df.where(F.col("p") != PREFIXES["ex"] + "segment").groupBy(_short("p").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query
def sparql_optional(v):
    return v.graph("customer", "order").query('SELECT ?c ?o WHERE { ?c ex:nation ?n . FILTER(?n = <nation:3>) OPTIONAL { ?o ex:customer ?c . ?o ex:total ?t . FILTER(?t > 400000.0) } }')


@query
def sparql_union(v):
    return v.graph("customer", "supplier").query('SELECT ?name WHERE { { ?s a ex:Supplier ; ex:nation ?n ; ex:name ?name } UNION { ?s a ex:Customer ; ex:nation ?n ; ex:name ?name } FILTER(?n = <nation:1>) }')


@query
def sparql_minus(v):
    return v.graph("nation", "supplier").query("SELECT ?n WHERE { ?n a ex:Nation MINUS { ?s ex:nation ?n . ?s ex:acctbal ?b . FILTER(?b > 5000.0) } }")


@query
def sparql_exists(v):
    return v.graph("customer", "order").query('SELECT ?c WHERE { ?c a ex:Customer FILTER EXISTS { ?o ex:customer ?c . ?o ex:priority "1-URGENT" } }')


@query
def sparql_order_limit(v):
    return v.graph("customer").query("SELECT DISTINCT ?name WHERE { ?c ex:name ?name } ORDER BY ?name LIMIT 10")


@query
def sparql_group_count(v):
    return v.graph("customer").query("SELECT ?nation (COUNT(?c) AS ?n) WHERE { ?c ex:nation ?nation } GROUP BY ?nation")


@query
def sparql_path_plus(v):
    g = Graph.of_views([(v.customer.df, of_class(Customer), None), (v.nation.df, of_class(Nation), None)], PREFIXES, distinct=False)
    return g.query("SELECT DISTINCT ?s ?o WHERE { ?s (ex:nation|ex:region)+ ?o }")


@query
def upsert_documents(v):
    new = v.spark.createDataFrame([("nation:3", 3, "RENAMED", 0), ("nation:900", 900, "OLD", 0), ("nation:900", 900, "NEW", 1)], "iri string, id int, name string, seq int")
    return EntityStore(v.nation.df.select("iri", "id", "name")).upsert(new, "seq").df.select("id", "name")


@query
def rdf_replace_subject(v):
    g = v.graph("nation")
    g = Graph(g.df.where(F.col("p") != PREFIXES["rdf"] + "type"), PREFIXES)
    new = v.spark.createDataFrame([("nation:3", "RENAMED")], "iri string, name string")
    out = g.replace(new.select(F.col("iri").alias("s")), to_triples(new, of_class(Nation)))
    return out.df.select("s", _short("p").alias("p"), "o")


@query
def graph_union_distinct(v):
    did = compile_context(_context(event_type=("did", False)))
    events = v.event.df.select(F.col("user").alias("iri"), "event_type", "value")
    parts = [to_triples(df, did) for df in (events, events.where("value > 100.0"))]
    return Graph(parts[0]).union(Graph(parts[1])).df.select("s", _short("p").alias("p"), "o")


_NATION_NS = {"nation": "https://example.com/nation/"}


@query
def tr_expand_iri(v):
    return v.nation.df.select(jsonfn.expand_iri(F.col("iri"), _NATION_NS).alias("iri"))


@query
def tr_compact_iri(v):
    return v.nation.df.select(jsonfn.compact_iri(jsonfn.expand_iri(F.col("iri"), _NATION_NS), _NATION_NS).alias("iri"))


_ALIASES = PREFIXES | {"name": "schema:name", "name*": "ex:name", "Person": "schema:Person", "Person*": "ex:Customer", "hasNation": "ex:hasNation", "hasNation*": {"@reverse": "ex:region"}, "label": "schema:label", "label*": {"@id": "ex:source", "@language": "en"}}


def _transformed(triples: DataFrame, *keep: str) -> DataFrame:
    """keep: of the aliases."""
    return transform(triples, PREFIXES | {k: x for k, x in _ALIASES.items() if k.rstrip("*") in keep})


@query
def tr_alias_rename(v):
    df = _transformed(v.graph("supplier", "nation").df, "name").where(F.col("p") == PREFIXES["schema"] + "name")
    return df.select("s", _short("p").alias("p"), "o")


@query
def tr_alias_class(v):
    df = _transformed(v.graph("customer").df, "Person").where(F.col("p") == PREFIXES["rdf"] + "type")
    return df.select(F.col("s").alias("id"), _short("o").alias("type"))


@query
def tr_reverse_edge(v):
    df = _transformed(v.graph("nation").df, "hasNation").where(F.col("p") == PREFIXES["ex"] + "hasNation")
    return df.select("s", _short("p").alias("p"), "o")


@query
def tr_language_tag(v):
    docs = v.table("documents").select(_iri("doc", "doc_id").alias("iri"), "source")
    df = _transformed(to_triples(docs, compile_context(_context(source=("source", False)))), "label")
    return df.select("s", "o", "lang")


@query
def tr_flatten_regroup(v):
    did = compile_context(_context(event_type=("did", False)))
    g = Graph(to_triples(v.event.df.select(F.col("user").alias("iri"), "event_type"), did))
    return g.documents().select(F.col("s").alias("id"), F.size(F.element_at("props", PREFIXES["ex"] + "did")).cast("long").alias("n_values"))


@query
def json_exclude_defaults(v):
    return v.order.exclude_defaults().df.select("iri", F.col("orderstatus").alias("status"))


@query
def json_restore_defaults(v):
    return v.event.restore_defaults().df.select("event_id", "kind")


@query
def cast_remove_extra(v):
    return v.supplier.cast(Party).df.select("iri", "type", "name")


@query
def cast_none_to_default(v):
    target = EntityClass("Purchase", {"event_id": Attribute(L), "amount": Attribute(D, default=0.0)}, "ex:Purchase")
    return v.event.cast(target, none_to_default=True).df.select("event_id", "amount")


@query
def required_iri_violations(v):
    return v.event.violations("usr").select("iri")


@query
def dangling_refs(v):
    return v.event.dangling("user", LinkedFrame(v.customer.df.where("custkey >= 100"))).select("iri")


@query
def ctl_strip_fields(v):
    df = v.customer.df.select("iri", "name", F.lit("s").alias("session"))
    return LinkedFrame(df, CustomerController).strip_controller().df


@query
def ctl_type_merge(v):
    df = v.nation.df.select("iri", F.array().cast("array<string>").alias("type"))
    return LinkedFrame(df, AB).strip_controller().df.select("iri", F.posexplode("type").alias("pos", "type"))


@query
def ctl_unique_preferred(v):
    rows = [("A", "ModelA", "CtlA"), ("B", "ModelB", "CtlB1"), ("B", "ModelB", "CtlB2"), ("C", "ModelC", None)]
    classes = v.spark.createDataFrame(rows, "type string, model string, controller string")
    return resolve_type(classes.select("type").distinct(), classes)


@query
def jt_unique_array(v):
    per = v.event.df.groupBy(F.col("user").alias("s")).agg(F.collect_list("event_type").alias("items"))
    return per.select("s", F.explode(jsonfn.unique_array("items")).alias("item"))


@query
def jt_enum_titles(v):
    kinds = EntityClass("Kinds", {"event_type": Attribute(S, metadata={"enum": ["view", "click"], "options": {"enum_titles": ["Viewed", "Clicked"]}})})
    title = title_of(F.col("event_type"), kinds.attributes["event_type"])
    return v.event.df.select("event_id", F.coalesce(title, "event_type").alias("title"))


@query
def st_url_tail(v):
    return v.table("pages").select("page_id", jsonfn.url_tail(F.col("url")).alias("tail"))


@query
def cred_best_match(v):
    return best_match(v.table("pages"), "url", "page_id", ["example.com", "example.net", "http://", "https://", "example.org/es"])


def _layers(v) -> LinkedFrame:
    """Three layers of 333 entities, each linked to all of the next layer."""
    layer = v.spark.range(0, 3, 1, 3).withColumnRenamed("id", "layer")
    numbers = F.sequence(F.lit(0), F.lit(332))
    name = lambda n, i: F.concat(n.cast("string"), F.lit("-"), i.cast("string"))
    nodes = layer.select("layer", F.explode(numbers).alias("i"))
    links = F.when(F.col("layer") < 2, F.transform(numbers, lambda j: F.concat(F.lit("ex:e"), name(F.col("layer") + 1, j))))
    nodes = nodes.select("layer", F.concat(F.lit("ex:e"), name(F.col("layer"), F.col("i"))).alias("iri"), F.concat(F.lit("Entity "), name(F.col("layer"), F.col("i"))).alias("name"), links.alias("links"))
    return LinkedFrame(nodes)


@query
def perf_chain(v):
    """From the first layer through two lists of links, with a condition at each of the three layers."""
    f = _layers(v)
    found = LinkedFrame(f.df.where("layer = 0"))[Condition("name", "eq", "Entity 0-50")].follow("links", f)[Condition("name", "eq", "Entity 1-50")].follow("links", f)[Condition("name", "eq", "Entity 2-50")]
    return found.df.select("iri", "name")


@query
def perf_links(v):
    return _layers(v).flatmap("links", "link").where("link is not null").agg(F.count(F.lit(1)).alias("n_links"))


@query
def sparql_literal_or_iri(v):
    """A literal with the text of an IRI joins no IRI."""
    g = Graph.of([to_triples(v.nation.df, of_class(Nation)), to_triples(v.region.df.withColumn("name", F.col("iri")), of_class(Region))], PREFIXES, distinct=False)
    return g.query("SELECT ?s ?o WHERE { ?s ex:region ?x . ?o ex:name ?x }").unionByName(g.query("SELECT ?s ?o WHERE { ?s ex:region ?x . ?o ex:name ?y FILTER(STR(?x) = STR(?y)) }"))


@query
def sparql_disconnected(v):
    """Groups without a common variable: EXISTS as a whole, OPTIONAL as each with each, or none."""
    g = v.graph("nation", "region")
    one = g.query('SELECT ?n WHERE { ?n a ex:Nation FILTER EXISTS { ?r ex:name "ASIA" } }')
    two = g.query('SELECT ?n WHERE { ?n a ex:Nation FILTER NOT EXISTS { ?r ex:name "ASIA" } }')
    three = g.query('SELECT ?n ?r WHERE { ?n a ex:Nation OPTIONAL { ?r ex:name "NOWHERE" } }')
    none = F.lit(None).cast("string").alias("r")
    return one.select(F.lit(1).alias("k"), "n", none).unionByName(two.select(F.lit(2).alias("k"), "n", none)).unionByName(three.select(F.lit(3).alias("k"), "n", "r"))


@query
def documents_by_class(v):
    """JSON documents made into their classes by type."""
    typed = lambda f, *cols: f.df.select("iri", F.to_json(F.struct(F.lit(f.cls.class_name).alias("type"), *cols)).alias("doc"))
    docs = typed(v.nation, "name", "region").unionByName(typed(v.region, "name"))
    classes = [EntityClass("Nation", {"name": Attribute(S), "region": Attribute(S, "Region")}), EntityClass("Region", {"name": Attribute(S)})]
    made = import_json(docs, classes)
    return made["Nation"].df.select("iri", "name", "region").unionByName(made["Region"].df.select("iri", "name", F.lit(None).cast("string").alias("region")))


def _oracle() -> dict[str, str]:
    text = (Path(__file__).parent / "oracle.sql").read_text()
    return {m[1]: m[2].strip().rstrip(";") for m in re.finditer(r"-- name: (\w+)\n(.*?)(?=\n-- name: |\Z)", text, re.S)}


ORACLE = _oracle()
