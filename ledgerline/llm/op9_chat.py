"""Chat formatting: tool calls linked to their results (DataFrame functions only).

A message whose text is JSON of the form {"tool_calls": [{"id", "name", "arguments"}]} makes
calls; one of the form {"tool_call_id", ...} is a result. Calls and results of a conversation
are joined by identifier. A result is placed no earlier than its call: messages are ordered by
(rank_turn, rank_step, turn), where a result's rank_turn is at least its call's turn, and its
rank_step is 1. The links run from calls to results only, so this order is topological, and no
conversation need be gathered in one task. Arguments are checked against schemas, and each
message is serialised as canonical JSON: no spaces, keys in order, null fields left out. A message
with calls keeps its content, and under `extra` the JSON of whatever other keys it has.

Nulls: a null role or text is left out of the JSON; null conv_ids are one conversation; a null
turn is placed first. A call id that repeats in a conversation links to its first call; a
result without a call is kept, with `orphan`. Rows that repeat are kept. Broken JSON is plain
text. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Schemas of tools: name -> {argument: (JSON type, required)}.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("number", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True)},
}
CALLS = "array<struct<id:string,name:string,arguments:string>>"


def json_type(args: Column, name: str) -> Column:
    """string, number, boolean, array, object, or null if the argument is absent."""
    kind = F.schema_of_variant(F.try_variant_get(args, f"$['{name}']", "variant"))
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .when(kind.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), "number")
    )


def problems(name: Column, args: Column, schemas: dict) -> Column:
    """array of what is wrong with a call: unknown tool, malformed, missing or mistyped arguments."""
    found = [F.when(~name.isin(list(schemas)) | name.isNull(), "unknown tool"), F.when(args.isNull(), "malformed arguments")]
    for tool, fields in schemas.items():
        for field, (kind, required) in fields.items():
            has = json_type(args, field)
            if required:
                found.append(F.when((name == tool) & args.isNotNull() & has.isNull(), f"missing {field}"))
            found.append(F.when((name == tool) & has.isNotNull() & (has != kind), f"{field} is not {kind}"))
    return F.array_compact(F.array(*found))


def linked(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, rank_turn, rank_step, call_turn, orphan, problems, json."""
    text = F.regexp_replace("text", r"^[\x20\t\r\n]++", "")
    calls = F.when(text.startswith("{"), F.from_json(F.get_json_object(text, "$.tool_calls"), CALLS))
    answers = F.when(text.startswith("{"), F.get_json_object(text, "$.tool_call_id"))
    rows = messages.select("conv_id", "turn", "role", "text", calls.alias("calls"), answers.alias("answers"))
    made = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls").alias("c")).where("c.id is not null").groupBy(F.col("conv_id").alias("c_conv"), F.col("c.id").alias("c_id")).agg(F.min("turn").alias("call_turn"))
    # Only results take part in the join; other messages pass by, whatever the size of their conversation.
    results = rows.where("answers is not null").join(made, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("answers") == F.col("c_id")), "left").withColumn("orphan", F.col("c_id").isNull()).drop("c_conv", "c_id")
    others = rows.where("answers is null").withColumns({"call_turn": F.lit(None).cast("long"), "orphan": F.lit(False)})
    both = results.unionByName(others)
    parsed = F.transform(F.coalesce("calls", F.array().cast(CALLS)), lambda c: problems(c["name"], F.try_parse_json(c["arguments"]), schemas))
    canonical = F.transform("calls", lambda c: F.struct(F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    plain = F.size(F.coalesce("calls", F.array().cast(CALLS))) == 0
    # What else a message with calls holds stays: its content, and its other keys under `extra`.
    held = F.from_json(F.when(~plain, F.regexp_replace("text", r"^[\x20\t\r\n]++", "")), "map<string,variant>")
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(F.transform_values(held, lambda k, v: F.to_json(v)), lambda k, v: ~k.isin("content", "role", "tool_call_id", "tool_calls")))))
    content = F.coalesce(F.try_variant_get(held["content"], "$", "string"), F.nullif(F.to_json(held["content"]), F.lit("null")))
    body = F.to_json(F.struct(F.when(plain, F.col("text")).otherwise(content).alias("content"), F.when(F.cardinality(rest) > 0, rest).alias("extra"), F.col("role"), F.col("answers").alias("tool_call_id"), F.when(~plain, canonical).alias("tool_calls")))
    return both.select(
        "conv_id", "turn", "role",
        F.greatest("turn", "call_turn").alias("rank_turn"), F.col("answers").isNotNull().cast("int").alias("rank_step"),
        "call_turn", "orphan", F.flatten(parsed).alias("problems"), body.alias("json"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
