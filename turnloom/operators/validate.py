"""Validation: the first rule that a request breaks, as a column. Nothing is raised inside a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import first_present, indexes, let, when
from turnloom.functions.jsontext import schema_faults
from turnloom.schema import has_calls, has_content
from turnloom.versions import AUDIOS, MODES, Version

NAME = r"^[a-zA-Z0-9_-]{1,64}$"
CALL_ID = r"^[a-zA-Z0-9]{9}$"
#: Roles that may follow a role.
FOLLOWS = {"system": ("user", "assistant", "system"), "user": ("assistant", "system", "user"), "assistant": ("assistant", "user", "tool"), "tool": ("assistant", "tool", "user")}


def last_message_error(m: Column, mode: str, continue_final: Column, v: Version) -> Column:
    if mode == "finetuning":
        rules = [
            when(m["role"] != "assistant", "structure", F.concat(F.lit("the last message must be the assistant's, not of role "), m["role"])),
            when(continue_final, "structure", "a final message can't be continued when finetuning"),
        ]
        if v.id_rules:
            rules.append(_first(F.transform(m["tool_calls"], lambda c: call_error(c, mode, F.lit(True), v))))
        return first_present(rules)
    open_end = m["prefix"] | continue_final
    return first_present([
        when((m["role"] == "assistant") & ~open_end, "structure", "the last message must be the user's or a tool's, or one of the assistant to go on with"),
        when(continue_final & ((m["role"] != "assistant") | m["prefix"]), "structure", "only an assistant message without prefix can be continued"),
    ])


def order_error(messages: Column) -> Column:
    """The first pair of roles that may not follow each other."""

    def allowed(before: Column, role: Column) -> Column:
        out = F.lit(False)
        for r, after in FOLLOWS.items():
            out = F.when(before == r, role.isin(*after)).otherwise(out)
        return out

    roles = F.transform(messages, lambda m: m["role"])
    bad = let(roles, lambda r: F.filter(indexes(r), lambda i: (i > 0) & ~allowed(F.get(r, i - 1), F.get(r, i))))
    return let(F.get(bad, F.lit(0)), lambda i: when(i.isNotNull(), "structure", F.concat(F.lit("role "), F.get(roles, i), F.lit(" may not follow role "), F.get(roles, i - 1))))


def pairing_error(messages: Column, mode: str, by_id: bool) -> Column:
    """Calls and results must match: by count, or by ids that are distinct and called. The first message isn't looked at."""
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    count = F.lit("calls and results differ in number")
    if not by_id:
        start = F.struct(F.lit(0).alias("open"), F.lit(None).cast("string").alias("error"))

        def step(s: Column, m: Column) -> Column:
            error = F.coalesce(s["error"], F.when((m["role"] == "assistant") & (s["open"] != 0), count))
            calls = F.when(m["tool_calls"].isNotNull(), F.size(m["tool_calls"])).otherwise(s["open"])
            now = F.when(m["role"] == "tool", s["open"] - 1).when(m["role"] == "assistant", calls).otherwise(s["open"])
            return F.struct(now.alias("open"), error.alias("error"))

        left = lambda s: s["open"]
    else:
        ids = F.array().cast("array<string>")
        start = F.struct(ids.alias("called"), ids.alias("seen"), F.lit(None).cast("string").alias("error"))

        def step(s: Column, m: Column) -> Column:
            own = F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), ids)
            id_ = m["tool_call_id"]
            known = lambda a: F.exists(a, lambda x: x.eqNullSafe(id_))
            error = F.when(
                m["role"] == "tool",
                F.when(known(s["seen"]), F.lit("two results have the same id")).when(~known(s["called"]), F.lit("a result's id was not called")),
            ).when(
                m["role"] == "assistant",
                F.when(F.size(s["called"]) != F.size(s["seen"]), count).when(F.size(F.array_distinct(own)) < F.size(own), F.lit("two calls have the same id")),
            )
            called = F.when(m["role"] == "assistant", own).otherwise(s["called"])
            seen = F.when(m["role"] == "assistant", ids).when(m["role"] == "tool", F.array_append(s["seen"], id_)).otherwise(s["seen"])
            return F.struct(called.alias("called"), seen.alias("seen"), F.coalesce(s["error"], error).alias("error"))

        left = lambda s: F.size(s["called"]) - F.size(s["seen"])
    final = {"serving": lambda s: F.when(left(s) != 0, count), "finetuning": lambda s: F.when(left(s) < 0, F.lit("more results than calls"))}.get(mode, lambda s: F.lit(None).cast("string"))
    end = F.aggregate(rest, start, step, lambda s: F.coalesce(s["error"], final(s)))
    return let(end, lambda e: when(e.isNotNull(), "structure", e))


def system_audio_error(messages: Column) -> Column:
    """System prompts and audio in user messages exclude each other."""
    system = F.filter(indexes(messages), lambda i: F.get(messages, i)["role"] == "system")
    audio = F.filter(indexes(messages), lambda i: (F.get(messages, i)["role"] == "user") & (F.get(messages, i)["content_kind"] == "list") & F.exists(F.get(messages, i)["chunks"], lambda c: c["type"].isin(*AUDIOS)))
    where = F.concat(F.lit("system prompts at "), F.concat_ws(",", system.cast("array<string>")), F.lit(" and audio at "), F.concat_ws(",", audio.cast("array<string>")))
    return when((F.size(system) > 0) & (F.size(audio) > 0), "structure", where)


def structure_error(messages: Column, continue_final: Column, mode: str, v: Version) -> Column:
    n = F.size(messages)
    last = F.get(messages, n - 1)
    checked = F.lit(True) if mode == "finetuning" else n > 1
    rules = [
        when(n == 0, "structure", "a conversation needs a message"),
        when((n == 1) & ~F.get(messages, F.lit(0))["role"].isin("user", "system"), "structure", "a conversation begins with the user's or a system message"),
        F.when(checked, last_message_error(last, mode, continue_final, v)),
        order_error(messages),
        pairing_error(messages, mode, v.id_sets),
    ]
    if v.number == 7:
        rules.append(system_audio_error(messages))
    return first_present(rules)


def chunks_error(m: Column, v: Version, role: str) -> Column:
    """Chunk kinds that the role's messages may not hold, sorted."""
    allowed = v.chunks[role]
    if allowed is None:
        return when(F.exists(m["chunks"], lambda c: c["type"] == "thinking"), role, "no thinking in tool messages")
    bad = F.array_sort(F.array_distinct(F.transform(F.filter(m["chunks"], lambda c: ~c["type"].isin(*allowed)), lambda c: c["type"])))
    return let(bad, lambda b: when((m["content_kind"] == "list") & (F.size(b) > 0), role, F.concat(F.lit(f"{role} messages can't hold "), F.concat_ws(", ", b))))


def call_error(c: Column, mode: str, is_last: Column, v: Version) -> Column:
    name = when(~c["name"].rlike(NAME), "call", F.concat(F.lit("not a function name: "), c["name"]))
    if not v.id_rules:
        return name
    rules = [when((c["id"] != "null") & ~c["id"].rlike(CALL_ID), "call", F.concat(F.lit("not a call id: "), c["id"]))]
    if mode == "finetuning":
        rules.append(when((c["id"] == "null") & ~is_last, "call", "only the last message may have calls without id"))
    if mode == "serving":
        rules.append(when(c["id"] == "null", "call", "a call needs an id"))
    return first_present([*rules, name])


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def assistant_error(m: Column, mode: str, is_last: Column, v: Version) -> Column:
    rules = [chunks_error(m, v, "assistant")]
    if not v.content_with_calls:
        rules.append(when(F.coalesce(has_content(m), F.lit(False)) == has_calls(m), "assistant", "either content or calls"))
    rules.append(_first(F.transform(m["tool_calls"], lambda c: call_error(c, mode, is_last, v))))
    if mode == "finetuning":
        rules.append(when(m["weight"].isNotNull() & ~m["weight"].isin(0.0, 1.0), "assistant", "weight must be 0 or 1"))
    rules.append(when(m["prefix"] & ~is_last, "assistant", "only the last message may be a prefix"))
    return first_present(rules)


def tool_error(m: Column, v: Version) -> Column:
    rules = [chunks_error(m, v, "tool"), when(~m["name"].rlike(NAME), "tool", F.concat(F.lit("not a function name: "), m["name"]))]
    if v.id_rules:
        rules += [
            when(m["tool_call_id"].isNull(), "request", "a result needs its call's id"),
            when(~m["tool_call_id"].rlike(CALL_ID), "tool", F.concat(F.lit("not a call id: "), m["tool_call_id"])),
        ]
    return first_present(rules)


def content_error(messages: Column, mode: str, v: Version) -> Column:
    def one(m: Column, i: Column) -> Column:
        role = m["role"]
        system = first_present([when(m["content_kind"] == "null", "system", "a system prompt needs content"), chunks_error(m, v, "system")])
        return (
            F.when(role == "user", chunks_error(m, v, "user")).when(role == "assistant", assistant_error(m, mode, i == F.size(messages) - 1, v))
            .when(role == "tool", tool_error(m, v)).when(role == "system", system).otherwise(when(F.lit(True), "request", "no such role"))
        )

    return _first(F.transform(messages, one))


def tools_error(tools: Column, faults: Column) -> Column:
    """Of each tool the schema first, then its name."""

    def one(t: Column, i: Column) -> Column:
        fault = F.get(faults, i)
        return first_present([when(fault.isNotNull(), "schema", fault), when(~t["name"].rlike(NAME), "tools", F.concat(F.lit("not a function name: "), t["name"]))])

    return _first(F.transform(F.coalesce(tools, F.array().cast("array<struct<name:string,description:string,parameters:string,strict:boolean>>")), one))


def construction_error(messages: Column) -> Column:
    """What no version allows: chunk kinds a role's messages never hold."""
    kinds = {"user": ("text", "image", "image_url", "input_audio", "audio_url"), "assistant": ("text", "thinking"), "system": ("text", "input_audio", "thinking"), "tool": ("text", "image", "image_url", "input_audio", "audio_url")}

    def one(m: Column) -> Column:
        ok = F.lit(True)
        for role, allowed in kinds.items():
            ok = F.when(m["role"] == role, F.forall(m["chunks"], lambda c: c["type"].isin(*allowed))).otherwise(ok)  # noqa: B023
        return when(~ok, "construction", F.concat(F.lit("a chunk that messages of this role never hold: "), m["role"]))

    return _first(F.transform(messages, one))


def ranges_error(df: DataFrame) -> Column:
    """Sampling fields, where the table has them."""
    rules = {"temperature": ~F.col("temperature").between(0, 1), "top_p": ~F.col("top_p").between(0, 1), "max_tokens": F.col("max_tokens") < 0, "random_seed": F.col("random_seed") < 0} if set(df.columns) >= {"temperature", "top_p", "max_tokens", "random_seed"} else {}
    found = [when(rule, "construction", f"{name} is out of range") for name, rule in rules.items()]
    return first_present(found) if found else F.lit(None).cast("struct<code:string,message:string>")


def tool_choice_error(choice: Column, named: Column, tools: Column) -> Column:
    """A named tool must exist; 'any' and 'required' need tools."""
    names = F.transform(F.coalesce(tools, F.array().cast("array<struct<name:string,description:string,parameters:string,strict:boolean>>")), lambda t: t["name"])
    return first_present([
        when(named.isNotNull() & ~F.array_contains(names, named), "tools", F.concat(F.lit("no such tool: "), named)),
        when(choice.isin("any", "required") & (F.size(names) == 0), "tools", "this choice needs tools"),
    ])


def validate(df: DataFrame, v: Version, mode: str = "test", schemas: bool = False) -> DataFrame:
    """df with `error`: the first rule broken, in the order request, structure, content, tools, settings; null if none.

    Columns a table lacks count as null. Tool schemas need Python; they are checked only if asked for.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    col = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    tools = col("tools", "array<struct<name:string,description:string,parameters:string,strict:boolean>>")
    messages = F.col("messages")
    goes_on = F.coalesce(col("continue_final_message", "boolean"), F.lit(False))
    rules = [ranges_error(df), construction_error(messages)]
    if mode == "serving":
        rules.append(when(col("model", "string").isNull(), "request", "serving needs a model"))
    rules += [structure_error(messages, goes_on, mode, v), content_error(messages, mode, v)]
    if schemas:
        df = df.withColumn("__faults", schema_faults(F.transform(tools, lambda t: t["parameters"])))
    faults = F.col("__faults") if schemas else F.array().cast("array<string>")
    rules.append(tools_error(tools, F.coalesce(faults, F.array().cast("array<string>"))))
    if not v.settings:
        rules.append(when(col("reasoning_effort", "string").isNotNull(), "request", "this version has no reasoning effort"))
    return df.withColumn("error", first_present(rules)).drop("__faults")
