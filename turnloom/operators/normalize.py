"""Normalization: merge consecutive messages of a role, gather system prompts, order tool results. Array expressions only,
but for JSON text, so a conversation stays one row and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema
from turnloom.functions.arrays import indexes, last_position, let, runs
from turnloom.functions.jsontext import forms
from turnloom.versions import MESSAGE_JOINER, Version

_NO_CHUNKS = f"array<{schema.CHUNK}>"
_NO_CALLS = f"array<{schema.CALL}>"


def islands(messages: Column) -> Column:
    """Consecutive messages of one role and weight together."""
    return runs(messages, lambda p, m, i: (p["role"] != m["role"]) | ~p["weight"].eqNullSafe(m["weight"]))


def coalesced(group: Column, chunk_joiner: str) -> Column:
    """struct(content_kind, chunks) of several messages' content in order.

    Text next to text is joined, across messages by a blank line, within one by chunk_joiner; empty text is skipped;
    other chunks stay apart and part what is joined. With no other chunk the content is text, maybe empty.
    """
    items = F.flatten(F.transform(group, lambda m, i: F.transform(
        F.filter(F.coalesce(m["chunks"], F.array().cast(_NO_CHUNKS)), lambda c: (c["type"] != "text") | (F.length(c["text"]) > 0)),
        lambda c: F.struct(i.alias("of"), c.alias("chunk")))))
    parts = runs(items, lambda p, x, i: (p["chunk"]["type"] != "text") | (x["chunk"]["type"] != "text"))

    def joined(part: Column) -> Column:
        pieces = F.transform(part, lambda x, i: F.concat(
            F.when(i == 0, F.lit("")).when(F.get(part, i - 1)["of"] != x["of"], F.lit(MESSAGE_JOINER)).otherwise(F.lit(chunk_joiner)), x["chunk"]["text"]))
        return F.when(F.get(part, F.lit(0))["chunk"]["type"] == "text", schema.text_chunk(F.array_join(pieces, ""))).otherwise(F.get(part, F.lit(0))["chunk"])

    chunks = F.transform(parts, joined)
    empty = F.array(schema.text_chunk(F.lit("")))
    return let(chunks, lambda c: F.struct(
        F.when(F.forall(c, lambda x: x["type"] == "text"), F.lit("str")).otherwise(F.lit("list")).alias("content_kind"),
        F.when(F.size(c) == 0, empty).otherwise(c).alias("chunks")))


def _content(group: Column, v: Version) -> dict[str, Column]:
    c = coalesced(group, v.chunk_joiner)
    return {"content_kind": c["content_kind"], "chunks": c["chunks"]}


def system_prompt(messages: Column, v: Version) -> Column:
    """All system contents that aren't empty, joined; null where prompts stay in place or there is none."""
    if v.system_in_place:
        return F.lit(None).cast("string")
    found = F.filter(messages, lambda m: (m["role"] == "system") & F.coalesce(schema.has_content(m), F.lit(False)))
    texts = F.transform(found, lambda m: F.get(coalesced(F.array(m), v.chunk_joiner)["chunks"], F.lit(0))["text"])
    return let(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, MESSAGE_JOINER)))


def ordered_results(results: Column, called: Column) -> Column:
    """Results by the last place of their id among the calls, then among the results; ids not called go last."""
    ids = F.transform(results, lambda m: m["tool_call_id"])
    keyed = F.transform(results, lambda m, i: F.struct(
        F.coalesce(last_position(called, F.coalesce(F.when(m["tool_call_id"] != "", m["tool_call_id"]), F.lit("null"))), F.lit(2**31 - 1)).alias("call"),
        last_position(ids, m["tool_call_id"]).alias("result"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda k: F.get(results, k["i"]))


def named_results(messages: Column) -> Column:
    """The messages, where results without a name have that of the last call before them with their id, if there is one."""

    def named(m: Column, i: Column) -> Column:
        calls = F.flatten(F.transform(F.slice(messages, F.lit(1), i), lambda x: F.coalesce(x["tool_calls"], F.array().cast(_NO_CALLS))))
        own = F.filter(calls, lambda c: c["id"] == m["tool_call_id"])
        name = let(own, lambda c: F.get(c, F.size(c) - 1)["name"])
        return F.when((m["role"] == "tool") & m["name"].isNull(), schema.with_fields(m, name=name)).otherwise(m)

    return F.transform(messages, named)


def _merged(groups: Column, g: Column, i: Column, v: Version) -> Column:
    """The messages that a group becomes."""
    role = F.get(g, F.lit(0))["role"]
    alone = lambda m: schema.with_fields(m, **_content(F.array(m), v))
    user = schema.message(role=F.lit("user"), **_content(g, v))
    calls = F.flatten(F.transform(g, lambda m: F.coalesce(m["tool_calls"], F.array().cast(_NO_CALLS))))
    assistant = schema.message(
        role=F.lit("assistant"), **_content(g, v), tool_calls=let(calls, lambda c: F.when(F.size(c) > 0, c)),
        prefix=F.exists(g, lambda m: F.coalesce(m["prefix"], F.lit(False))), weight=F.get(g, F.lit(0))["weight"],
    )
    results = F.transform(g, alone)
    if v.reorder_results:
        tools_before = F.filter(F.sequence(F.lit(0), i), lambda j: (j < i) & (F.get(F.get(groups, j), F.lit(0))["role"] == "tool"))
        since = F.coalesce(F.array_max(tools_before) + 1, F.lit(0))
        calling = F.filter(F.slice(groups, since + 1, i - since), lambda x: F.get(x, F.lit(0))["role"] == "assistant")
        called = F.flatten(F.flatten(F.transform(calling, lambda x: F.transform(x, lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), F.array().cast("array<string>"))))))
        results = let(called, lambda c: ordered_results(results, c))
    system = F.transform(g, alone) if v.system_in_place else F.array().cast(f"array<{schema.MESSAGE}>")
    return F.when(role == "user", F.array(user)).when(role == "assistant", F.array(assistant)).when(role == "tool", results).otherwise(system)


def merged(messages: Column, v: Version) -> Column:
    """All messages merged; an empty user message goes in front of none, and before v7 of any but a user message."""
    done = let(islands(messages), lambda groups: F.flatten(F.transform(groups, lambda g, i: _merged(groups, g, i, v))))
    empty = schema.text_message(F.lit("user"), F.lit(""))
    lead = lambda m: F.size(m) == 0 if v.system_in_place else (F.size(m) == 0) | (F.get(m, F.lit(0))["role"] != "user")
    return let(done, lambda m: F.when(lead(m), F.concat(F.array(empty), m)).otherwise(m))


def built_settings(effort: Column, v: Version, allowed: tuple[str, ...] = ("none", "high"), accepts_none: bool = True, default: str | None = None) -> Column:
    """struct(effort, error): the request's effort if allowed, the default if none is given, null where none may be."""
    code = "struct<code:string,message:string>"
    if not v.settings:
        return F.struct(F.lit(None).cast("string").alias("effort"), F.lit(None).cast(code).alias("error"))
    value = F.coalesce(effort, F.lit(default))
    bad = F.when(value.isNull() & F.lit(not accepts_none), F.struct(F.lit("request").alias("code"), F.lit("an effort is needed").alias("message"))).when(
        ~value.isin(*allowed), F.struct(F.lit("request").alias("code"), F.concat(F.lit("no such effort: "), value).alias("message")))
    return F.struct(value.alias("effort"), bad.alias("error"))


def normalize(df: DataFrame, v: Version, json_text: bool = True) -> DataFrame:
    """df with normalized `messages` and with `system_prompt`.

    json_text: re-serialise call arguments and, before v7, results; False spares the Python step where a table is known
    to hold no tool messages.
    """
    out = df.withColumn("system_prompt", system_prompt(F.col("messages"), v)).withColumn("messages", merged(F.col("messages"), v))
    if not json_text:
        return out
    own = lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["arguments"]), F.array().cast("array<string>"))
    text = lambda m: F.when(m["role"] == "tool", F.array(F.get(m["chunks"], F.lit(0))["text"])).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform("messages", lambda m: F.concat(own(m), text(m))))
    out = out.withColumn("__texts", both).withColumn("__forms", forms(F.col("__texts")))
    sizes = F.transform("messages", lambda m: F.size(own(m)) + F.size(text(m)))
    out = out.withColumn("__at", F.transform(indexes(F.col("messages")), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)))

    def one(m: Column, i: Column) -> Column:
        at = F.get(F.col("__at"), i)
        calls = F.transform(m["tool_calls"], lambda c, j: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.get(F.col("__forms"), at + j)["normal"].alias("arguments")))
        fields = {"tool_calls": calls}
        if v.json_results:
            fields |= {"chunks": F.when(m["role"] == "tool", F.array(schema.text_chunk(F.get(F.col("__forms"), at)["normal"]))).otherwise(m["chunks"])}
        return schema.with_fields(m, **fields)

    return out.withColumn("messages", F.transform("messages", one)).drop("__texts", "__forms", "__at")
