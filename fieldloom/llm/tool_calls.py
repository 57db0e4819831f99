"""Linking tool calls to their results, in DataFrame expressions alone.

Calls and results meet by a hash join on (conversation, identifier). Rows that repeat an
identifier are merged first, so the join has one row on each side whatever a conversation
holds. A call may name a parent, the call whose result it builds on; the topological order is
the depth of a call under its parents, found by pointer jumping: each round a call looks up
where its pointer points and doubles its reach, so a chain of any length takes the logarithm of
its length in joins on unique keys, and no conversation is ever collected. A call on or below a
cycle never reaches a root and gets no depth.

Arguments are parsed as variants and checked against the schema of the tool: required
parameters, types, and names that the schema lacks. Records are serialised as canonical JSON:
keys sorted, no white space, absent values left out.

Defined results: of calls with one identifier the one with the smallest turn, then name and
arguments counts, and n_calls tells how many there were; results alike. Where an identifier
has several calls or results, the record lists all of them (`calls`, `results`) in that order.
A call without result and a result without call are rows of their own. A row without
identifier is linked to nothing and stays a row of its own. A parent that does not exist is
none. Arguments that are null or not a JSON object are "invalid json". A tool's message that
names no call is an orphan without identifier. Messages of no or of another role that are not
explicit calls are neither calls nor results; `other_messages` gives each of them a row of
status "other". A number with nothing behind its point is an integer; canonical numbers keep the
kind that they are written in (100 and 1e2 differ), and those of over 38 digits become doubles. Of
very long texts nothing is cut. Empty tables give empty results.

`order_key` sorts the rows of a conversation topologically: by depth, turn and identifier, rows
without depth last. It is a key and not a number, so that no conversation needs a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored

#: Most bytes of schemas that are broadcast: names and types, and this much for the rest of a row.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64

#: Schemas of the two tools that plain conversations are read as.
CONVERSATION_SCHEMAS = [
    ("configure", "instructions", "string", True),
    ("reply", "prompt", "string", True),
    ("reply", "turn", "integer", True),
]


def conversation_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSATION_SCHEMAS, "name string, param string, type string, required boolean")


def _order_key(depth: Column, turn: Column, call: Column) -> Column:
    last = lambda c: F.lpad(F.coalesce(c.cast("string"), F.lit("9" * 19)), 19, "0")
    return F.concat_ws(":", last(depth), last(turn), F.coalesce(call, F.lit(""))).alias("order_key")


def _id(conv: Column, turn: Column) -> Column:
    return F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), turn.cast("string"))


def _part(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, v (the parsed object, if it is one) and whether it is an explicit call."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("body"))
    m = m.withColumn("v", F.when(F.col("body").startswith("{"), F.try_parse_json("body")))
    explicit = _part("$.id").isNotNull() & _part("$.name").isNotNull() & (F.coalesce("role", F.lit("")) != "tool")
    return m.withColumn("explicit", F.coalesce(explicit, F.lit(False)))


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read messages (conv_id, turn, role, text) as calls and results.

    Explicit ones are JSON objects: a call has id and name (and may have arguments and parent),
    a message of role `tool` is the result of its call_id. Otherwise a user's message is a call
    of `reply` whose parent is the user's message two turns before, the assistant's next message
    is its result, and a system message is a call of `configure`. Other messages of role `tool`
    are results without identifier.
    """
    m, part, explicit = _messages(messages), _part, F.col("explicit")
    implied_id = _id(F.col("conv_id"), F.col("turn"))
    arguments = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("body").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct(F.col("body").alias("instructions"))))
    calls = m.where(explicit | F.col("role").isin("user", "system")).select(
        "conv_id", "turn",
        F.when(explicit, part("$.id")).otherwise(implied_id).alias("call_id"),
        F.when(explicit, part("$.name")).when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.when(explicit, F.to_json(F.try_variant_get("v", "$.arguments", "variant"))).otherwise(arguments).alias("arguments"),
        F.when(explicit, part("$.parent")).when(F.col("role") == "user", _id(F.col("conv_id"), F.col("turn") - 2)).alias("parent"),
    )
    tool = F.col("role") == "tool"
    given = part("$.call_id").isNotNull() & tool
    results = m.where(tool | ((F.col("role") == "assistant") & ~explicit)).select(
        "conv_id", "turn",
        F.when(tool, part("$.call_id")).otherwise(_id(F.col("conv_id"), F.col("turn") - 1)).alias("call_id"),
        F.when(given, F.coalesce(part("$.content"), F.lit(""))).otherwise(F.col("body")).alias("content"),
    )
    return calls, results


def other_messages(messages: DataFrame) -> DataFrame:
    """Messages that are neither calls nor results, a row each as `link_tool_calls` has them."""
    known = F.coalesce(F.col("role").isin("user", "system", "assistant", "tool"), F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    return _messages(messages).where(~F.col("explicit") & ~known).select(
        "conv_id", none("string").alias("call_id"), none("string").alias("name"), "turn", none("long").alias("result_turn"),
        none("long").alias("depth"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"),
        F.lit("other").alias("status"), none("array<string>").alias("errors"),
        F.to_json(F.struct(F.col("body").alias("content"), "role", F.lit("other").alias("status"))).alias("record"),
        _order_key(none("long"), F.col("turn"), none("string")),
    )


def _merged(rows: DataFrame, fields: list[str], count: str, every: str) -> DataFrame:
    """One row for each (conversation, identifier), with the first of its rows and, where there
    are several, all in `every`; rows without identifier stay as they are."""
    row = F.struct(*fields)
    out = rows.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_list(row)).alias("all"))
    size = F.size("all").cast("long")
    out = out.select("conv_id", "call_id", F.col("all")[0].alias("first"), size.alias(count), F.when(size > 1, F.col("all")).alias(every))
    alone = rows.where("call_id IS NULL").select("conv_id", "call_id", row.alias("first"), F.lit(1).cast("long").alias(count))
    return out.unionByName(alone, allowMissingColumns=True).select("conv_id", "call_id", "first.*", count, every)


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): how many ancestors each call has; null on or below a cycle."""
    known = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", "parent")
    ids = known.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("exists"))
    at = stored(known.join(ids, ["conv_id", "parent"], "left").select("conv_id", "call_id", F.when(F.col("exists"), F.col("parent")).alias("to"), F.col("exists").isNotNull().cast("long").alias("depth")), "tool-depth")
    reach, total = 1, at.count()
    while reach <= total and not at.where("to IS NOT NULL").isEmpty():
        there = at.select(F.col("conv_id"), F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("hit"))
        at = at.join(there, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        at, reach = stored(at, "tool-depth"), reach * 2
    return at.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with `canonical` arguments and `errors`, the sorted list of what breaks the schema."""
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("param", "type", "required"))).alias("spec")).withColumnRenamed("name", "tool")
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("name", "param", "type")]
    size = schemas.agg(F.coalesce(F.sum(sizes[0] + sizes[1] + sizes[2] + ROW_BYTES), F.lit(0))).first()[0]
    tools = F.broadcast(tools) if size <= BROADCAST_BYTES else tools
    read = calls.join(tools, F.col("name") == F.col("tool"), "left").drop("tool")
    read = read.withColumn("v", F.try_parse_json("arguments"))
    read = read.withColumn("args", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.from_json("arguments", "map<string, variant>")))
    has = lambda p: F.map_contains_key("args", p["param"])
    value = lambda p: F.element_at("args", p["param"])
    whole = lambda v: (_json_type(v) == "number") & F.coalesce(F.try_variant_get(v, "$", "double") % 1 == 0, F.lit(False))
    fits = lambda p: (_json_type(value(p)) == p["type"]) | ((p["type"] == "number") & (_json_type(value(p)) == "integer")) | ((p["type"] == "integer") & whole(value(p)))
    missing = F.transform(F.filter("spec", lambda p: p["required"] & ~has(p)), lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.transform(F.filter("spec", lambda p: has(p) & ~fits(p)), lambda p: F.concat(F.lit("type:"), p["param"]))
    extra = F.transform(F.array_except(F.map_keys("args"), F.transform("spec", lambda p: p["param"])), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("args").isNull(), F.array(F.lit("invalid json"))).when(F.col("spec").isNull(), F.array(F.lit("unknown tool")))
    read = read.withColumn("errors", errors.otherwise(F.sort_array(F.concat(missing, wrong, extra))))
    return read.withColumn("canonical", F.when(F.col("args").isNotNull(), F.col("v"))).drop("spec", "args", "v")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier of calls and results, and for each row without identifier.

    calls: conv_id, turn, call_id, name, arguments (JSON), parent. results: conv_id, turn, call_id,
    content. schemas: name, param, type, required. The result has conv_id, call_id, name, turn,
    result_turn, depth, n_calls, n_results, status (linked, early, pending or orphan), errors,
    record, the canonical JSON, and order_key.
    """
    c = stored(_merged(calls, ["turn", "name", "arguments", "parent"], "n_calls", "calls"), "tool-calls")
    r = _merged(results, ["turn", "content"], "n_results", "answers").withColumnRenamed("turn", "result_turn")
    checked = argument_errors(c, schemas).withColumnsRenamed({"conv_id": "c_conv", "call_id": "c_id"})
    depths = call_depths(c).withColumnsRenamed({"conv_id": "d_conv", "call_id": "d_id"})
    checked = checked.join(depths, F.col("c_conv").eqNullSafe(F.col("d_conv")) & (F.col("c_id") == F.col("d_id")), "left").drop("d_conv", "d_id")
    both = checked.join(r, F.col("c_conv").eqNullSafe(F.col("conv_id")) & (F.col("c_id") == F.col("call_id")), "full")
    conv, call = F.coalesce("c_conv", "conv_id"), F.coalesce("c_id", "call_id")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending")
        .when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked")
    )
    out = both.select(
        conv.alias("conv_id"), call.alias("call_id"), "name", "turn", "result_turn", "depth",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        status.alias("status"), "errors", "canonical", "content", "calls", F.transform("answers", lambda r: r["content"]).alias("answers"),
    )
    calls = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["name"].alias("name"), c["parent"].alias("parent"), c["turn"].alias("turn")))
    record = F.to_json(F.struct(
        F.col("canonical").alias("arguments"), calls.alias("calls"), F.col("call_id").alias("id"), "name",
        F.col("content").alias("result"), F.col("answers").alias("results"), "status",
    ))
    out = out.withColumn("record", record).drop("canonical", "content", "calls", "answers")
    return out.select("*", _order_key(F.col("depth"), F.coalesce("turn", "result_turn"), F.col("call_id")))
