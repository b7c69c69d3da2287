"""Chat formatting with linked tool calls.

An assistant turn whose text is a JSON object with `tool_calls` (id, name,
arguments, optional depends_on) makes calls; a tool turn whose text has
`tool_call_id` and `content` brings a result. Calls and results are hash-joined
by conversation and id, calls are ordered topologically (a call after those it
depends on, a result after its call), arguments are validated against the
tools' schemas, and every message becomes canonical JSON (keys sorted, no
spaces). What an assistant says beside its calls is a message of rank -1; fields
that aren't known, of it or of a result, are carried in `fields`. One row a message, so that no conversation has to fit anywhere; the
order within a conversation is that of turn, rank and part.

Cases. A null or unparsable text is an ordinary message of that text; a null
role is an empty one; a null conv_id is a conversation of its own. The first
result of an id (by turn, content, fields) is linked, others are `duplicate`,
those without a call `orphan`; a call without a result is `pending`. The first
call of an id (by turn, part, name, arguments) counts, others are `duplicate`
and stand with it; rows equal to the first are copies of it and come out as
often, alike. A call without an id is pending and not ordered. Calls on a cycle,
that depend on an unknown id or on one that can't be ordered, have level -1 and
aren't valid. Very long texts are parsed whole. No rows: no result. Other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, materialise, same

CALLS = "tool_calls array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>"
RESULT = "tool_call_id string, content string"
#: Schemas of the production tools (JSON Schema: required, properties with type, additionalProperties).
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "calculator": {"required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "get_weather": {"required": ["city"], "properties": {"city": {"type": "string"}, "unit": {"type": "string"}}, "additionalProperties": False},
}
_FAMILY = {"string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID"}


def valid(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """Whether the arguments fit the schema of the tool of that name; false for unknown tools and broken JSON."""
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, schema in tools.items():
        keys = F.json_object_keys(arguments)
        good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
        for key in schema.get("required", ()):
            good = good & F.coalesce(F.array_contains(keys, key), F.lit(False))
        for key, what in schema.get("properties", {}).items():
            value = F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant"))
            if kind := what.get("type"):
                good = good & F.coalesce(value.rlike(_FAMILY[kind]), ~F.coalesce(F.array_contains(keys, key), F.lit(False)))
        if schema.get("additionalProperties") is False:
            good = good & (F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, schema.get("properties", {}))))) == 0)
        out = F.when(name == tool, good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level, at of calls (conv_id, id, turn, depends_on; one row an id).

    level: 0 without dependencies, else one more than the deepest of them; at:
    the latest turn of the call and what it depends on. Calls that can't be
    ordered aren't there.

    Each round brings what was settled last to the links that still wait, and
    settles calls whose links have all been met: as many rounds as the longest
    chain, over the waiting links only."""
    some = F.coalesce(F.size(F.array_compact("depends_on")), F.lit(0)) > 0
    fresh = materialise(calls.where(~some).select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("at")))
    links = materialise(calls.where(some).select("conv_id", F.col("id").alias("_id"), F.explode(F.array_distinct(F.array_compact("depends_on"))).alias("id")))
    nodes = materialise(calls.where(some).select("conv_id", "id", F.size(F.array_distinct(F.array_compact("depends_on"))).alias("open"), F.lit(-1).alias("level"), F.col("turn").alias("at")))
    done = fresh
    while not links.isEmpty():
        reached = same(links, counted(fresh), ["conv_id", "id"], "left")
        reached = materialise(reached)
        new = reached.where("level is not null").groupBy("conv_id", F.col("_id").alias("id")).agg(F.count(F.lit(1)).alias("_met"), F.max("level").alias("_level"), F.max("at").alias("_at"))
        nodes = same(nodes, counted(new), ["conv_id", "id"], "left")
        nodes = materialise(nodes.select("conv_id", "id", (F.col("open") - F.coalesce("_met", F.lit(0))).alias("open"), F.greatest("level", "_level").alias("level"), F.greatest("at", "_at").alias("at")))
        fresh = materialise(nodes.where("open = 0").select("conv_id", "id", (F.col("level") + 1).alias("level"), "at"))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
        nodes = nodes.where("open > 0")
        links = materialise(reached.where("level is null").drop("level", "at"))
    return done


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))))


def _others(*known: str) -> Column:
    """The fields of the object in text beside the known ones, sorted, or null without any; the whole text as `raw` where it only parses leniently."""
    kind = "map<string,variant>"
    fields = F.map_filter(F.try_parse_json("text").cast(kind), lambda k, _: ~k.isin(*known))
    fields = F.map_from_entries(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k, F.element_at(fields, k))))
    raw = F.create_map(F.lit("raw"), F.to_variant_object(F.array("text"))).cast(kind)
    fields = F.when(F.try_parse_json("text").isNull(), raw).otherwise(fields)
    return F.when(F.size(fields) > 0, fields)


def _message(rows: DataFrame, rank: int, json: Column) -> DataFrame:
    return rows.select("conv_id", "turn", F.lit(rank).alias("rank"), F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("none").alias("status"), F.lit(True).alias("valid"), json.alias("json"))


def _firsts(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows with _first: whether cols equal those of the least row of its conversation and id; aggregated before they are shuffled."""
    key = F.struct(*cols)
    least = rows.where("id is not null").groupBy("conv_id", "id").agg(F.min(key).alias("_least"))
    return same(rows, counted(least), ["conv_id", "id"], "left").withColumn("_first", F.coalesce(F.col("_least").eqNullSafe(key), F.lit(False))).drop("_least")


def format_chat(messages: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, rank, part, kind (message, call, result), call_id, status, valid, json.

    Plain messages are read and written in one pass; calls and results are parsed once and written."""
    tools = TOOLS if tools is None else tools
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).withColumn("_json", F.col("text").startswith("{"))
    calls = F.when((F.col("role") == "assistant") & F.col("_json"), F.from_json("text", CALLS)["tool_calls"])
    result = F.when((F.col("role") == "tool") & F.col("_json"), F.from_json("text", RESULT))
    rows = rows.withColumns({"_calls": calls, "_result": F.when(result["tool_call_id"].isNotNull(), result)})
    out = _message(rows.where("coalesce(size(_calls), 0) <= 0 and _result is null"), 0, _json(role=F.col("role"), content=F.col("text")))
    linked = materialise(rows.where("size(_calls) > 0 or _result is not null").select(
        "conv_id", "turn", "_calls", "_result",
        F.when(F.size("_calls") > 0, F.from_json("text", "content string")["content"]).alias("said"),
        F.to_json(F.when(F.size("_calls") > 0, _others("content", "tool_calls", "role")).otherwise(_others("content", "tool_call_id", "role"))).alias("others"),
    ))
    fields = F.try_parse_json("others")
    # What a turn with calls says, and its other fields, come before the calls.
    said = linked.where("size(_calls) > 0 and (coalesce(said, '') <> '' or others is not null)")
    out = out.unionByName(_message(said, -1, _json(role=F.lit("assistant"), content=F.coalesce("said", F.lit("")), fields=fields)))

    made = linked.where("size(_calls) > 0").select("conv_id", "turn", F.posexplode("_calls").alias("part", "c")).select("conv_id", "turn", "part", "c.*")
    made = _firsts(made, ["turn", "part", "name", "arguments", "depends_on"])
    first = made.where("_first").dropDuplicates(["conv_id", "id"]).select("conv_id", "id", "turn", "part", "depends_on")
    level = levels(materialise(first.select("conv_id", "id", "turn", "depends_on")))
    first = same(first, level, ["conv_id", "id"], "left")
    first = counted(first.select("conv_id", "id", F.coalesce("at", "turn").alias("call_turn"), F.col("part").alias("call_part"), F.coalesce("level", F.lit(-1)).alias("level")))

    got = linked.where("_result is not null").select("conv_id", F.col("turn").alias("got_turn"), F.col("_result.tool_call_id").alias("id"), F.col("_result.content").alias("content"), "others")
    got = materialise(_firsts(got, ["got_turn", "content", "others"]))
    has = counted(got.where("_first").select("conv_id", "id", F.lit(True).alias("_has")).distinct())

    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))
    call_json = _json(role=F.lit("assistant"), tool_call=F.struct(arguments.alias("arguments"), F.col("id").alias("id"), F.col("name").alias("name")))
    status = F.when(F.col("id").isNull(), "pending").when(~F.col("_first"), "duplicate").when(F.col("_has"), "linked").otherwise("pending")
    level = F.coalesce("level", F.lit(-1))
    # A call's rank is twice its level, its result's one more: no call comes before what it depends on.
    calls_out = same(same(made, first, ["conv_id", "id"], "left"), has, ["conv_id", "id"], "left")
    calls_out = calls_out.select("conv_id", F.coalesce("call_turn", "turn").alias("turn"), (2 * F.greatest(level, F.lit(0))).alias("rank"), "part", F.lit("call").alias("kind"), F.col("id").alias("call_id"), status.alias("status"), (valid(F.col("name"), F.col("arguments"), tools) & (level >= 0)).alias("valid"), call_json.alias("json"))
    linked_results = same(got, first, ["conv_id", "id"], "left")
    at = F.col("call_part").isNotNull()
    status = F.when(~at, "orphan").when(~F.col("_first"), "duplicate").otherwise("linked")
    results_out = linked_results.select("conv_id", F.when(at, F.col("call_turn")).otherwise(F.col("got_turn")).alias("turn"), F.when(at, 2 * F.greatest(level, F.lit(0)) + 1).otherwise(0).alias("rank"), F.coalesce("call_part", F.lit(0)).alias("part"), F.lit("result").alias("kind"), F.col("id").alias("call_id"), status.alias("status"), at.alias("valid"), _json(role=F.lit("tool"), tool_call_id=F.col("id"), content=F.col("content"), fields=fields).alias("json"))
    return out.unionByName(calls_out).unionByName(results_out)
