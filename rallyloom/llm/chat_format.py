"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

Everything is joins and column functions over one row a message. The keys of the
joins are (conversation, call identifier), so a conversation with a third of all
messages spreads over all tasks; no conversation is gathered into one row. Lines
carry a sort key instead of a running number: sorted by ``conv_id, level, at,
step, turn``, a conversation's messages are in topological order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import discard, materialise

#: JSON types and the variant types that satisfy them (fixed values).
TYPES = {
    "string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$",
    "boolean": r"^BOOLEAN$", "array": r"^ARRAY<", "object": r"^OBJECT<", "null": r"^VOID$",
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = True


Schemas = dict[str, tuple[Field, ...]]


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong with a call's arguments; empty if nothing.

    ``not an object``, ``unknown tool``, ``missing NAME``, ``type of NAME`` or ``unknown NAME``.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    none = F.array().cast("array<string>")

    def of(fields: tuple[Field, ...]) -> Column:
        found = []
        for field in fields:
            kind = F.schema_of_variant(F.try_variant_get(value, _path(field.name), "variant"))
            missing = F.lit(f"missing {field.name}") if field.required else F.lit(None).cast("string")
            found.append(F.when(kind.isNull(), missing).when(~kind.rlike(TYPES[field.type]), F.lit(f"type of {field.name}")))
        known = F.array(*[F.lit(f.name) for f in fields]).cast("array<string>")
        extra = F.transform(F.array_except(F.json_object_keys(arguments), known), lambda k: F.concat(F.lit("unknown "), k))
        return F.array_sort(F.concat(F.array_compact(F.array(*found)) if found else none, F.coalesce(extra, none)))

    checks = F.when(~is_object, F.array(F.lit("not an object")))
    for name, fields in sorted(schemas.items()):
        checks = checks.when(tool == name, of(fields))
    return checks.otherwise(F.array(F.lit("unknown tool")))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null where it is no valid JSON."""
    return F.to_json(F.try_parse_json(json))


def _conversation() -> Column:
    """What tells conversations apart; a null one is one of its own, whatever strings there are."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))


def _chains(edges: DataFrame) -> DataFrame:
    """``conv, id, to, far``, stored: of each call that uses one other, the first call down
    its chain that uses none or several, and the steps there; ``to`` is null on a circle.

    Pointers double, so a chain of n calls takes log2(n) rounds.
    """
    single = edges.groupBy("conv", "id").agg(F.min("used").alias("to"), F.count(F.lit(1)).alias("uses")).where("uses = 1")
    jumps = materialise(single.select("conv", "id", "to", F.lit(1).cast("bigint").alias("far")), "chat-jumps")
    rounds = max(1, jumps.count()).bit_length() + 1
    for _ in range(rounds):
        on = jumps.select(F.col("conv").alias("c2"), F.col("id").alias("mid"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        joined = jumps.join(on, (F.col("conv") == F.col("c2")) & (F.col("to") == F.col("mid")), "left")
        moved = F.col("mid").isNotNull()
        last, jumps = jumps, materialise(
            joined.select("conv", "id", F.when(moved, F.col("beyond")).otherwise(F.col("to")).alias("to"), (F.col("far") + F.when(moved, F.col("more")).otherwise(0)).alias("far"), moved.alias("moved")),
            "chat-jumps",
        )
        discard(last)
        if jumps.where("moved").isEmpty():
            return jumps.drop("moved")
    # Whoever still moves after doubling past every call is on a circle or leads to one.
    return jumps.select("conv", "id", F.when(~F.col("moved"), F.col("to")).alias("to"), "far")


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv, id, level`` of calls that use results of other calls, from rows of ``conv, id, uses``.

    A call's level is one more than the highest of the calls it uses; calls that
    use none, or only unknown ones, have level 0 and are not returned. Calls on a
    circle, or that use one, have level -1. Chains of calls that use one other are
    contracted first; then a round settles one level of the calls that use several.
    """
    edges = calls.where(F.size("uses") > 0).select("conv", "id", F.explode("uses").alias("used"))
    known = calls.select(F.col("conv").alias("c2"), F.col("id").alias("i2")).distinct()
    edges = materialise(edges.join(known, (F.col("conv") == F.col("c2")) & (F.col("used") == F.col("i2")), "left_semi").distinct(), "chat-edges")
    if edges.isEmpty():
        return edges.select("conv", "id", F.lit(0).cast("bigint").alias("level"))
    chains = _chains(edges)
    # Calls that use several, with the ends of the chains below them.
    several = edges.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("conv", "id")
    below = chains.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), "to", "far", F.col("to").isNull().alias("lost"))
    ends = edges.join(several, ["conv", "id"]).join(below, (F.col("conv") == F.col("c2")) & (F.col("used") == F.col("i2")), "left")
    ends = materialise(ends.select("conv", "id", F.when(F.col("i2").isNull(), F.col("used")).otherwise(F.col("to")).alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.coalesce("lost", F.lit(False)).alias("lost")), "chat-ends")
    # Level by level: a call is settled when all ends below it are. An end that uses nothing is settled at 0.
    settled = materialise(several.join(ends, ["conv", "id"]).select("conv", "id").limit(0).withColumn("level", F.lit(0).cast("bigint")), "chat-settled")
    rest = ends
    while not rest.isEmpty():
        mine = rest.select(F.col("conv").alias("c2"), F.col("id").alias("i2")).distinct()
        blocked = rest.join(mine, (F.col("conv") == F.col("c2")) & (F.col("to") == F.col("i2")), "left_semi").select("conv", "id").unionByName(rest.where("lost").select("conv", "id")).distinct()
        ready = rest.join(blocked, ["conv", "id"], "left_anti")
        done = settled.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), F.col("level").alias("under"))
        ready = ready.join(done, (F.col("conv") == F.col("c2")) & (F.col("to") == F.col("i2")), "left")
        # A settled circle stays one for whoever uses it.
        level = F.when(F.min("under") < 0, -1).otherwise(F.max(F.col("far") + F.coalesce("under", F.lit(0))))
        fresh = materialise(ready.groupBy("conv", "id").agg(level.cast("bigint").alias("level")), "chat-fresh")
        if fresh.isEmpty():
            fresh = materialise(rest.select("conv", "id").distinct().withColumn("level", F.lit(-1).cast("bigint")), "chat-fresh")
        settled = materialise(settled.unionByName(fresh), "chat-settled")
        rest = materialise(rest.join(fresh.select("conv", "id"), ["conv", "id"], "left_anti"), "chat-rest")
    done = settled.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), F.col("level").alias("under"))
    through = chains.join(done, (F.col("conv") == F.col("c2")) & (F.col("to") == F.col("i2")), "left")
    level = F.when(F.col("to").isNull() | (F.col("under") < 0), -1).otherwise(F.col("far") + F.coalesce("under", F.lit(0)))
    return settled.unionByName(through.select("conv", "id", level.cast("bigint").alias("level")))


MESSAGE = ("conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "result_of", "uses")


def format_messages(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message: ``conv_id, turn, role, status, errors, level, at, step, line``.

    ``messages`` has ``conv_id, turn, role, text, call_id, tool, arguments,
    result_of, uses`` (``uses``: call identifiers whose results the call needs; it
    may be null); other columns are not looked at. ``status``: ``message``; for calls
    ``answered``, ``open``, ``repeated`` (an earlier call has the identifier) or
    ``invalid`` (arguments break the schema); for results ``linked``, ``orphan`` (no
    call) or ``repeated`` (an earlier result answers the call). Ties on turn go to the
    smaller text, then to any one row: of rows that repeat in every column, one is the
    call or result and the others are ``repeated``. A result's ``at`` is its call's
    turn, so it sorts behind it even if the log has it earlier. Null texts become empty
    strings; rows without a conversation are one conversation, apart from all named ones.
    """
    m = messages.select(*MESSAGE).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))
    m = materialise(m.withColumn("conv", _conversation()).withColumn("key", F.monotonically_increasing_id()), "chat-messages")
    calls = m.where("call_id is not null")
    results = m.where("call_id is null and result_of is not null")
    plain = m.where("call_id is null and result_of is null")
    first = F.min(F.struct("turn", "text", "key"))
    first_call = calls.groupBy(F.col("conv").alias("c1"), F.col("call_id").alias("i1")).agg(first.alias("call"))
    first_result = results.groupBy(F.col("conv").alias("c2"), F.col("result_of").alias("i2")).agg(first.alias("answer"))
    levels = call_levels(calls.select("conv", F.col("call_id").alias("id"), "uses")).select(F.col("conv").alias("c3"), F.col("id").alias("i3"), "level")

    def linked(rows: DataFrame, identifier: str, how: str, how_answer: str) -> DataFrame:
        at = lambda c, i: (F.col("conv") == F.col(c)) & (F.col(identifier) == F.col(i))
        return rows.join(first_call, at("c1", "i1"), how).join(first_result, at("c2", "i2"), how_answer).join(levels, at("c3", "i3"), "left")

    zero, level = F.lit(0).cast("bigint"), F.coalesce("level", F.lit(0)).cast("bigint").alias("level")
    no_errors, no_arguments = F.array().cast("array<string>"), F.lit(None).cast("string")
    asked = linked(calls, "call_id", "inner", "left").withColumn("errors", argument_errors(F.col("tool"), F.col("arguments"), schemas))
    status = (
        F.when(F.col("key") != F.col("call.key"), "repeated").when(F.size("errors") > 0, "invalid")
        .when(F.col("answer").isNotNull(), "answered").otherwise("open")
    )
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.to_variant_object(F.struct(F.col("arguments").alias("invalid")))))
    out_calls = asked.select("conv_id", "turn", "role", status.alias("status"), "errors", level, F.col("turn").alias("at"), zero.alias("step"), _line(arguments, "text"))
    answered = linked(results, "result_of", "left", "inner")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("key") != F.col("answer.key"), "repeated").otherwise("linked")
    out_results = answered.select(
        "conv_id", "turn", "role", status.alias("status"), no_errors.alias("errors"), level,
        F.coalesce(F.col("call.turn"), F.col("turn")).alias("at"), F.lit(1).cast("bigint").alias("step"), _line(no_arguments, "text"),
    )
    out_plain = plain.select("conv_id", "turn", "role", F.lit("message").alias("status"), no_errors.alias("errors"), zero.alias("level"), F.col("turn").alias("at"), zero.alias("step"), _line(no_arguments, "text"))
    return reduce(DataFrame.unionByName, [out_calls, out_results, out_plain])


def _line(arguments: Column, text: str) -> Column:
    """Canonical JSON: keys in order, no spaces, absent keys left out."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), c))
    parts = [
        part("arguments", arguments), part("call_id", _string(F.col("call_id"))), part("content", _string(F.col(text))),
        part("result_of", _string(F.col("result_of"))), part("role", _string(F.col("role"))), part("tool", _string(F.col("tool"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line")


def _string(c: Column) -> Column:
    """A JSON string literal; null stays null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Messages with tool calls from a table ``conv_id, turn, role, text`` that holds none.

    A user turn is a call ``conv_id:turn`` of the tool ``reply``, the assistant turn
    after it its result. What goes wrong in logs of calls follows from the number n of
    code points of the user's text, so that it occurs everywhere in the table:

    * uses: the call of the user turn before (not if 4 divides n), the one before
      that too if 10 divides n, and the following one if 19 divides n (a circle, if that one uses this one);
    * identifiers: if 17 divides n, the call repeats the one of turn 0;
    * arguments: if 11 divides n, a list; else by n modulo 7: 0 no prompt, 1 a number as a string, 2 an unknown key;
    * if 13 divides n, a tool that no schema knows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n, turn = F.length(text), F.col("turn")
    name = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), t.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    json = lambda *fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields]))
    prompt, chars = ("prompt", text), ("chars", n)
    arguments = (
        F.when(n % 11 == 0, F.to_json(F.array(text))).when(n % 7 == 0, json(chars)).when(n % 7 == 1, json(prompt, ("chars", n.cast("string"))))
        .when(n % 7 == 2, json(prompt, chars, ("draft", F.lit(True)))).otherwise(json(prompt, chars))
    )
    uses = F.array(
        F.when((n % 4 != 0) & (turn >= 2), name(turn - 2)), F.when((n % 10 == 0) & (turn >= 4), name(turn - 4)), F.when(n % 19 == 0, name(turn + 2))
    )
    call = F.when((n % 17 == 0) & (turn > 0), name(F.lit(0))).otherwise(name(turn))
    return turns.select(
        "conv_id", "turn", "role", "text", F.when(user, call).alias("call_id"), F.when(user, F.when(n % 13 == 0, "lookup").otherwise("reply")).alias("tool"),
        F.when(user, arguments).alias("arguments"), F.when(assistant, name(turn - 1)).alias("result_of"), F.when(user, F.array_compact(uses)).alias("uses"),
    )


#: The tool that ``conversation_messages`` speaks of.
REPLY: Schemas = {"reply": (Field("chars", "integer"), Field("prompt", "string"))}
