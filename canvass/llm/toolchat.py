"""Chat formatting: tool calls linked to their results, with DataFrame functions only.

Calls and results meet in one hash join by conversation and identifier.  Each call
may name the call it comes after; depths along these links are found by pointer
doubling, in as many rounds as the binary logarithm of the longest chain, and
rows come out sorted by conversation, depth and turn.  No conversation is ever
gathered in one task.  Arguments are checked against a schema for each tool name,
and every row carries one canonical JSON object: sorted keys, no white space.

Defined results: an identifier used by several calls or results of a conversation
counts once, as the earliest turn (then the smallest text), and ``n_calls`` and
``n_results`` tell how often; a call without result has status ``no_result``, a
result without call ``no_call``; calls that wait for each other in a ring have
status ``cycle`` and no depth, so they come last; a link to a call that does not
exist counts as none; arguments that are no JSON object have the one error
``not_an_object``; null conversations and identifiers are keys like others; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.storage import stored


@dataclass(frozen=True)
class Field:
    """A property of a tool's arguments; kind is a JSON Schema type."""

    kind: str
    required: bool = True
    minimum: float | None = None
    min_length: int | None = None
    choices: tuple[str, ...] | None = None


#: Schemas by tool name; a tool's arguments may have no further properties.
Schemas = dict[str, dict[str, Field]]
_VARIANT_TYPES = {"integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments, a JSON text, under its tool's schema."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)

    def of_tool(fields: dict[str, Field]) -> Column:
        found = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unknown:"), k))]
        for key, field in fields.items():
            path = f'$["{key}"]'
            kind = F.schema_of_variant(F.variant_get(parsed, path, "variant"))
            bad = ~kind.rlike(f"^{_VARIANT_TYPES[field.kind]}$")
            if field.minimum is not None:
                bad = bad | (F.try_variant_get(parsed, path, "double") < field.minimum)
            if field.min_length is not None:
                bad = bad | (F.length(F.try_variant_get(parsed, path, "string")) < field.min_length)
            if field.choices is not None:
                bad = bad | ~F.try_variant_get(parsed, path, "string").isin(*field.choices)
            absent = ~F.array_contains(keys, key)
            missing = F.when(absent, F.lit(f"missing:{key}")) if field.required else F.lit(None).cast("string")
            found.append(F.array(missing, F.when(~absent & F.coalesce(bad, F.lit(True)), F.lit(f"invalid:{key}"))))
        return F.array_sort(F.array_compact(F.concat(*found)))

    checked = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        checked = F.when(name == tool, of_tool(fields)).otherwise(checked)
    return F.when(keys.isNull() | parsed.isNull(), F.array(F.lit("not_an_object"))).otherwise(checked)


def chain_depths(calls: DataFrame) -> DataFrame:
    """Depth of each (conv_id, call_id) along parent_id by pointer doubling; null on and behind a ring."""
    same = lambda a, b, key: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{key}") == F.col(f"{b}.call_id"))
    ids = calls.select("conv_id", "call_id", "parent_id")
    at = stored(
        ids.alias("x").join(ids.alias("y"), same("x", "y", "parent_id"), "left")
        .select("x.conv_id", "x.call_id", F.col("y.call_id").alias("up"), F.col("y.call_id").isNotNull().cast("long").alias("depth")),
        "depths",
    )
    n, reach = at.count(), 1
    while at.where("up IS NOT NULL").limit(1).count() and reach <= n:
        at = stored(
            at.alias("x").join(at.alias("y"), same("x", "y", "up"), "left")
            .select("x.conv_id", "x.call_id", F.col("y.up").alias("up"), (F.col("x.depth") + F.coalesce("y.depth", F.lit(0))).alias("depth")),
            "depths",
        )
        reach *= 2
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def canonical(**fields: Column) -> Column:
    """A JSON object of the columns with sorted keys; nulls stay out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link calls (conv_id, turn, call_id, parent_id, name, arguments) to results (conv_id, turn, call_id, content)."""
    first_call = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("c"), F.count("*").alias("n_calls")
    )
    first_result = results.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")
    )
    made = stored(first_call.select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    depths = chain_depths(made)
    both = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & a["call_id"].eqNullSafe(b["call_id"])
    known = made.join(depths, both(made, depths), "left").drop(depths["conv_id"], depths["call_id"])
    known = known.withColumn("is_call", F.lit(True))
    linked = known.join(first_result, both(known, first_result), "full").select(
        F.coalesce(known["conv_id"], first_result["conv_id"]).alias("conv_id"),
        F.coalesce(known["call_id"], first_result["call_id"]).alias("call_id"),
        F.coalesce("turn", "r.turn").alias("turn"),
        "parent_id",
        "name",
        "arguments",
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        "depth",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("is_call").isNull(), "no_call")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("linked")
        .alias("status"),
    )
    errors = F.when(F.col("status") == "no_call", F.array().cast("array<string>")).otherwise(
        argument_errors(F.col("name"), F.col("arguments"), schemas)
    )
    return linked.withColumn("errors", errors).withColumn(
        "json",
        canonical(
            arguments=F.try_parse_json("arguments"),
            errors=F.when(F.size("errors") > 0, F.col("errors")),
            id=F.col("call_id"),
            name=F.col("name"),
            parent=F.col("parent_id"),
            result=F.when(F.col("n_results") > 0, F.struct("content", F.col("result_turn").alias("turn"))),
            status=F.col("status"),
            turn=F.col("turn"),
        ),
    )


_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:string>>>"


def calls_in_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages that hold them as JSON.

    An assistant's text is {"tool_calls": [{"id", "name", "arguments", "after"}]}, a tool's is
    {"tool_call_id", "content"}; other messages have neither.
    """
    said = messages.select("conv_id", "turn", "role", "text")
    calls = (
        said.where("role = 'assistant'")
        .select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.after").alias("parent_id"), "c.name", "c.arguments")
    )
    results = (
        said.where("role = 'tool'")
        .select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
        .where("r.tool_call_id IS NOT NULL")
        .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    )
    return calls, results


def calls_in_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results.

    A user's or system's turn t calls ``reply`` or ``configure`` under the identifier conv_id:t, after the call of the
    turn before the last answer (t - 2); any other turn t answers the call of turn t - 1.
    """
    said = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    key = lambda back: F.concat_ws(":", F.col("conv_id"), F.col("turn") - back)
    asks = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    name = F.when(F.col("role") == "system", "configure").otherwise("reply")
    calls = said.where(asks).select(
        "conv_id",
        "turn",
        key(0).alias("call_id"),
        F.when(F.col("turn") >= 2, key(2)).alias("parent_id"),
        name.alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"),
    )
    results = said.where(~asks).select("conv_id", "turn", key(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


_PROMPT = {"turn": Field("integer", minimum=0), "prompt": Field("string", min_length=1)}
TURN_SCHEMAS: Schemas = {"reply": _PROMPT, "configure": _PROMPT}


def op6_tool_call_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_calls(*calls_in_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TURN_SCHEMAS)
    return linked.select(
        "conv_id", "turn", "call_id", "depth", "status", F.size("errors").alias("n_errors"), "json"
    ).orderBy("conv_id", F.col("depth").asc_nulls_last(), "turn")


OP6_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS call_id,
    CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS parent_id
  FROM m WHERE role IN ('user', 'system')
), d AS (
  SELECT c.call_id, CAST(0 AS BIGINT) AS depth FROM c LEFT JOIN c AS p ON c.parent_id = p.call_id WHERE p.call_id IS NULL
  UNION ALL
  SELECT c.call_id, d.depth + 1 FROM c JOIN d ON c.parent_id = d.call_id
), r AS (
  SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM m WHERE role NOT IN ('user', 'system')
), j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
    d.depth, c.role, c.text AS prompt, c.parent_id, r.text AS content, r.turn AS result_turn,
    CASE WHEN c.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    CAST(CASE WHEN c.call_id IS NOT NULL AND c.text = '' THEN 1 ELSE 0 END AS INTEGER) AS n_errors
  FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN d ON c.call_id = d.call_id
)
SELECT conv_id, turn, call_id, depth, status, n_errors,
  '{' ||
  CASE WHEN status <> 'no_call' THEN '"arguments":{"prompt":' || to_json(prompt) || ',"turn":' || turn || '},' ELSE '' END ||
  CASE WHEN n_errors > 0 THEN '"errors":["invalid:prompt"],' ELSE '' END ||
  '"id":' || to_json(call_id) ||
  CASE WHEN status <> 'no_call' THEN ',"name":"' || CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END || '"' ELSE '' END ||
  CASE WHEN parent_id IS NOT NULL THEN ',"parent":' || to_json(parent_id) ELSE '' END ||
  CASE WHEN status <> 'no_result' THEN ',"result":{"content":' || to_json(content) || ',"turn":' || result_turn || '}' ELSE '' END ||
  ',"status":"' || status || '","turn":' || turn || '}' AS json
FROM j
"""
