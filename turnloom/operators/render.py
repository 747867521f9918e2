"""Rendering: messages to segments, that is, special tokens and pieces of text in order.

A piece is encoded by itself, so where pieces part decides the ids. Kinds of segment: 'sp' a special token, 'tx' text,
'im' an image run (a, b: its grid), 'au' an audio run (a: its tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema
from turnloom.functions.arrays import first_present, indexes, let, when
from turnloom.functions.jsontext import quoted, values
from turnloom.functions.media import AudioConfig, ImageConfig, audio_tokens, image_grid
from turnloom.versions import IMAGES, MESSAGE_JOINER, Version

SEGMENT = "struct<kind:string,val:string,a:int,b:int>"
_NONE = f"array<{SEGMENT}>"


def _segment(kind: str, val: Column, a: Column | None = None, b: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), val.alias("val"), (none if a is None else a).cast("int").alias("a"), (none if b is None else b).cast("int").alias("b"))


def sp(token: str) -> Column:
    return _segment("sp", F.lit(token))


def tx(text: Column) -> Column:
    return _segment("tx", text)


def first_last_user(messages: Column) -> tuple[Column, Column]:
    """Zero-based index of the first and last user message, -1 if there is none."""
    at = F.filter(indexes(messages), lambda i: F.get(messages, i)["role"] == "user")
    return F.coalesce(F.array_min(at), F.lit(-1)), F.coalesce(F.array_max(at), F.lit(-1))


def image_first(chunks: Column) -> Column:
    """A last image behind nothing but text goes to the front."""
    last = F.get(chunks, F.size(chunks) - 1)
    move = (F.size(chunks) >= 2) & last["type"].isin(*IMAGES) & F.forall(F.slice(chunks, F.lit(1), F.size(chunks) - 1), lambda c: c["type"] == "text")
    return F.when(move, F.concat(F.array(last), F.slice(chunks, F.lit(1), F.size(chunks) - 1))).otherwise(chunks)


def _of_chunk(c: Column, image: ImageConfig, audio: AudioConfig) -> Column:
    grid = image_grid(c["width"], c["height"], image)
    think = F.concat(F.array(sp("[THINK]"), tx(c["text"])), F.when(F.coalesce(c["closed"], F.lit(True)), F.array(sp("[/THINK]"))).otherwise(F.array().cast(_NONE)))
    return (
        F.when(c["type"] == "text", F.array(tx(c["text"]))).when(c["type"] == "thinking", think)
        .when(c["type"].isin(*IMAGES), F.array(_segment("im", F.lit(""), grid["w"], grid["h"])))
        .otherwise(F.array(sp("[BEGIN_AUDIO]"), _segment("au", F.lit(""), audio_tokens(c["n_samples"], audio))))
    )


def _of_chunks(chunks: Column, image: ImageConfig, audio: AudioConfig) -> Column:
    return F.flatten(F.transform(chunks, lambda c: _of_chunk(c, image, audio)))


def _user(m: Column, i: Column, first: Column, last: Column, v: Version, image: ImageConfig, audio: AudioConfig) -> Column:
    text = F.get(m["chunks"], F.lit(0))["text"]
    prompt = F.col("system_prompt")
    given = F.length(F.coalesce(prompt, F.lit(""))) > 0
    lead = F.concat(prompt, F.lit(MESSAGE_JOINER))
    if v.number == 1:
        return F.array(tx(F.concat(F.lit("[INST] "), F.when(given & (i == first), F.concat(lead, text)).otherwise(text), F.lit(" [/INST]"))))
    here = i == (first if v.tools_on == "first" else last)
    head = F.when(here & (F.size(F.coalesce(F.col("tools"), F.array().cast(f"array<{schema.TOOL}>"))) > 0), F.array(sp("[AVAILABLE_TOOLS]"), tx(F.col("__tools")), sp("[/AVAILABLE_TOOLS]"))).otherwise(F.array().cast(_NONE))
    if v.settings:
        effort = F.concat(F.lit('{"reasoning_effort": "'), F.col("effort"), F.lit('"}'))
        head = F.concat(head, F.when(here & F.col("effort").isNotNull(), F.array(sp("[MODEL_SETTINGS]"), tx(effort), sp("[/MODEL_SETTINGS]"))).otherwise(F.array().cast(_NONE)))
    with_prompt = given & (i == last)
    listed = _of_chunks(image_first(m["chunks"]), image, audio)
    if v.system_in_place:
        body = F.when(m["content_kind"] == "list", listed).otherwise(F.array(tx(text)))
    else:
        own = F.when(with_prompt, F.concat(F.array(tx(lead)), listed)).otherwise(listed)
        body = F.when(m["content_kind"] == "list", own).otherwise(F.array(tx(F.when(with_prompt, F.concat(lead, text)).otherwise(text))))
    return F.concat(head, F.array(sp("[INST]")), body, F.array(sp("[/INST]")))


def _calls(m: Column, value: Column, name: Column, v: Version) -> Column:
    """value, name: arrays along the calls of the message: arguments as JSON, names as JSON strings."""
    calls = m["tool_calls"]
    if v.number >= 11:
        with_id = lambda c: F.when(F.coalesce(c["id"], F.lit("null")).isin("null", ""), F.array().cast(_NONE)).otherwise(F.array(sp("[CALL_ID]"), tx(c["id"])))
        ids = with_id if v.number == 11 else lambda c: F.array().cast(_NONE)
        return F.flatten(F.transform(calls, lambda c, j: F.concat(F.array(sp("[TOOL_CALLS]"), tx(c["name"])), ids(c), F.array(sp("[ARGS]"), tx(F.get(value, j))))))
    id_ = lambda c: F.when(F.coalesce(c["id"], F.lit("null")).isin("null", ""), F.lit("")).otherwise(F.concat(F.lit(', "id": "'), c["id"], F.lit('"'))) if v.number >= 3 else F.lit("")
    one = lambda c, j: F.concat(F.lit('{"name": '), F.get(name, j), F.lit(', "arguments": '), F.get(value, j), id_(c), F.lit("}"))
    return F.array(sp("[TOOL_CALLS]"), tx(F.concat(F.lit("["), F.array_join(F.transform(calls, one), ", "), F.lit("]"))))


def _assistant(m: Column, i: Column, last: Column, value: Column, name: Column, v: Version, image: ImageConfig, audio: AudioConfig) -> Column:
    text = F.get(m["chunks"], F.lit(0))["text"]
    goes_on = F.col("continue_final_message") & (i == F.size("messages") - 1)
    end = F.when(m["prefix"] | goes_on, F.array().cast(_NONE)).otherwise(F.array(sp("</s>")))
    if v.number == 1:
        return F.concat(F.array(tx(text)), end)
    told = F.coalesce(schema.has_content(m), F.lit(False))
    body = F.when(m["content_kind"] == "list", _of_chunks(m["chunks"], image, audio)).otherwise(F.array(tx(F.rtrim(text))))
    content = F.when(told, body).otherwise(F.array().cast(_NONE))
    calls = F.when(schema.has_calls(m), _calls(m, value, name, v)).otherwise(F.array().cast(_NONE))
    out = F.concat(content, calls, end)
    return out if v.history else F.when(schema.has_calls(m) & (i < last), F.array().cast(_NONE)).otherwise(out)


def _tool(m: Column, i: Column, last: Column, value: Column, name: Column, v: Version, image: ImageConfig, audio: AudioConfig) -> Column:
    text = F.get(m["chunks"], F.lit(0))["text"]
    if v.number >= 13:
        body = F.when(m["content_kind"] == "list", _of_chunks(m["chunks"], image, audio)).otherwise(F.array(tx(text)))
    elif v.number >= 7:
        body = F.array(tx(m["tool_call_id"]), sp("[TOOL_CONTENT]"), tx(text))
    elif v.number == 3:
        body = F.array(tx(F.concat(F.lit('{"content": '), F.get(value, F.lit(0)), F.lit(', "call_id": "'), m["tool_call_id"], F.lit('"}'))))
    else:
        body = F.array(tx(F.concat(F.lit('[{"name": '), F.coalesce(F.get(name, F.lit(0)), F.lit("null")), F.lit(', "content": '), F.get(value, F.lit(0)), F.lit("}]"))))
    out = F.concat(F.array(sp("[TOOL_RESULTS]")), body, F.array(sp("[/TOOL_RESULTS]")))
    return out if v.history else F.when(i < last, F.array().cast(_NONE)).otherwise(out)


def encode_error(messages: Column, v: Version) -> Column:
    """What only shows when encoding."""
    last = F.get(messages, F.size(messages) - 1)
    goes_on = F.col("continue_final_message")
    bad = lambda rule: F.exists(messages, rule)
    assistant = lambda m: m["role"] == "assistant"
    rules = []
    if v.number in (7, 11):
        audio = lambda m: (m["role"] == "user") & (m["content_kind"] == "list") & F.exists(m["chunks"], lambda c: c["type"] == "input_audio")
        rules.append(when(bad(audio) & bad(lambda m: m["role"] == "system"), "encode", "system messages and audio exclude each other"))
    rules += [
        when(goes_on & (last["role"] != "assistant"), "encode", "only an assistant message can be continued"),
        when(goes_on & last["prefix"], "encode", "a prefix can't be continued"),
        when(bad(lambda m: assistant(m) & ~F.coalesce(schema.has_content(m), F.lit(False)) & ~schema.has_calls(m)), "encode", "an assistant message is empty"),
    ]
    if v.number == 1:
        rules.append(when(bad(lambda m: (m["role"] == "tool") | assistant(m) & schema.has_calls(m)), "encode", "v1 has no tools"))
    if not v.think:
        rules.append(when(bad(lambda m: F.exists(m["chunks"], lambda c: c["type"] == "thinking")), "encode", "this version has no thinking marks"))
    if v.number >= 15:
        rules.append(when(bad(lambda m: (m["role"] == "system") & F.exists(m["chunks"], lambda c: c["type"] == "thinking")), "encode", "no thinking in system messages"))
    if v.number >= 13:
        rules.append(when(bad(lambda m: assistant(m) & F.exists(m["tool_calls"], lambda c: F.coalesce(c["id"], F.lit("null")).isin("null", ""))), "encode", "a call needs an id"))
    if not v.content_with_calls:
        rules.append(when(bad(lambda m: assistant(m) & F.coalesce(schema.has_content(m), F.lit(False)) & schema.has_calls(m)), "encode", "either content or calls"))
    return first_present(rules)


def tools_json(tools: Column, strings: Column, parameters: Column) -> Column:
    """The tools' JSON. strings: names and descriptions in turn as JSON strings; parameters: as JSON."""
    one = lambda t, i: F.concat(F.lit('{"type": "function", "function": {"name": '), F.get(strings, 2 * i), F.lit(', "description": '), F.get(strings, 2 * i + 1), F.lit(', "parameters": '), F.get(parameters, i), F.lit("}}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tools, one), ", "), F.lit("]"))


def segments(df: DataFrame, v: Version, json_text: bool = True, image: ImageConfig = ImageConfig(), audio: AudioConfig = AudioConfig()) -> DataFrame:
    """Normalized df with `segments`, an array of segments for each message, and `encode_error`.

    json_text=False spares the Python steps for tables without tools.
    """
    for name, kind in (("system_prompt", "string"), ("effort", "string"), ("tools", f"array<{schema.TOOL}>"), ("continue_final_message", "boolean")):
        df = df.withColumn(name, F.col(name) if name in df.columns else F.lit(None).cast(kind))
    df = df.withColumn("continue_final_message", F.coalesce("continue_final_message", F.lit(False)))
    none = F.array().cast("array<string>")
    if json_text:
        own = lambda m: F.when(m["role"] == "tool", F.array(F.get(m["chunks"], F.lit(0))["text"])).otherwise(F.coalesce(F.transform(m["tool_calls"], lambda c: c["arguments"]), none))
        names = lambda m: F.when(m["role"] == "tool", F.array(m["name"])).otherwise(F.coalesce(F.transform(m["tool_calls"], lambda c: c["name"]), none))
        tools = F.coalesce("tools", F.array().cast(f"array<{schema.TOOL}>"))
        df = df.withColumn("__values", values(F.flatten(F.transform("messages", own)))).withColumn("__names", quoted(F.flatten(F.transform("messages", names))))
        df = df.withColumn("__parameters", values(F.transform(tools, lambda t: F.coalesce(t["parameters"], F.lit("{}")))))
        df = df.withColumn("__strings", quoted(F.flatten(F.transform(tools, lambda t: F.array(t["name"], F.coalesce(t["description"], F.lit("")))))))
        df = df.withColumn("__tools", tools_json(tools, F.col("__strings"), F.col("__parameters")))
        sizes = F.transform("messages", lambda m: F.size(own(m)))
        df = df.withColumn("__at", F.transform(indexes(F.col("messages")), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)))
    else:
        df = df.withColumn("__values", none).withColumn("__names", none).withColumn("__tools", F.lit("[]")).withColumn("__at", F.array().cast("array<int>"))
    first, last = first_last_user(F.col("messages"))
    df = df.withColumn("__users", F.struct(first.alias("first"), last.alias("last")))
    users = F.col("__users")

    def one(m: Column, i: Column) -> Column:
        at = F.coalesce(F.get(F.col("__at"), i), F.lit(0))
        value, name = (F.slice(F.col(c), at + 1, F.greatest(F.size(c) - at, F.lit(0))) for c in ("__values", "__names"))
        body = _of_chunks(m["chunks"], image, audio)
        system = F.concat(F.array(sp("[SYSTEM_PROMPT]")), body, F.array(sp("[/SYSTEM_PROMPT]"))) if v.system_in_place else F.array().cast(_NONE)
        return (
            F.when(m["role"] == "user", _user(m, i, users["first"], users["last"], v, image, audio))
            .when(m["role"] == "assistant", _assistant(m, i, users["last"], value, name, v, image, audio))
            .when(m["role"] == "tool", _tool(m, i, users["last"], value, name, v, image, audio)).otherwise(system)
        )

    done = df.withColumn("segments", F.transform("messages", one)).withColumn("encode_error", encode_error(F.col("messages"), v))
    return done.drop(*(c for c in done.columns if c.startswith("__")))


def segment_text(s: Column) -> Column:
    """How a segment reads in debug text."""
    row = F.concat(F.repeat(F.lit("[IMG]"), s["a"]), F.lit("[IMG_BREAK]"))
    image = let(F.repeat(row, s["b"]), lambda r: F.concat(F.substr(r, F.lit(1), F.length(r) - len("[IMG_BREAK]")), F.lit("[IMG_END]")))
    return F.when(s["kind"] == "im", image).when(s["kind"] == "au", F.repeat(F.lit("[AUDIO]"), s["a"])).otherwise(s["val"])


def prompt_text(segments: Column) -> Column:
    """The debug text of a whole conversation. Ids are the authority: text may itself hold what special tokens read like."""
    return F.concat(F.lit("<s>"), F.array_join(F.transform(F.flatten(segments), segment_text), ""))
