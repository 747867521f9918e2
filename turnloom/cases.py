"""Registered queries over literal requests, for what the test tables lack: calls, results, chunk lists, thinking, media,
broken requests. Inputs stand beside the results that they should have, worked out by hand, which the SQL gives as VALUES.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import jsontext, media
from turnloom.operators import convert, encode, normalize
from turnloom.plans.chat import Engine
from turnloom.queries import ORACLES, QUERIES
from turnloom.sources import media as media_source
from turnloom.sources import vocabulary
from turnloom.special import SpecialTokens, speech_tokens
from turnloom.versions import version

A, B = "abcdefghi", "abcdefghj"


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper()


def cases(names: str, rows: list[tuple]) -> Callable:
    """Register a query with the rows that it should give."""
    lines = ", ".join(f"({', '.join(map(_sql, r))})" for r in rows)

    def add(f: Callable[[SparkSession], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {lines}) t({names})"
        return f

    return add


def _user(content: object = "x") -> dict:
    return {"role": "user", "content": content}


def _assistant(content: object = None, **more) -> dict:
    return {"role": "assistant", **({} if content is None else {"content": content}), **more}


def _call(id_: str = A, name: str = "f", arguments: object = "{}") -> dict:
    return {"id": id_, "function": {"name": name, "arguments": arguments}}


def _result(id_: str = A, content: object = "r", **more) -> dict:
    return {"role": "tool", "tool_call_id": id_, "content": content, **more}


def _thought(text: str, **more) -> dict:
    return {"type": "thinking", "thinking": text, **more}


def _text(text: str) -> dict:
    return {"type": "text", "text": text}


TOOL = {"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {}}}}
TOOL_TEXT = '{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {}}}}'


def _read(spark: SparkSession, requests: list[dict]) -> DataFrame:
    return convert.from_json(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "conv_id long, request string"))


def _prompts(spark: SparkSession, given: list[tuple[int, str, dict]]) -> DataFrame:
    """(case, code, prompt) of (version, mode, request): the first error's code, or the prompt."""
    out = None
    for v, mode in sorted({g[:2] for g in given}):
        own = [(i, g[2]) for i, g in enumerate(given) if g[:2] == (v, mode)]
        e = Engine.of(v, mode=mode)
        read = convert.from_json(spark.createDataFrame([(i, json.dumps(r)) for i, r in own], "conv_id long, request string"))
        checked = e.checked(read)
        first = checked.select("conv_id", F.col("error.code").alias("code"), F.lit(None).cast("string").alias("prompt")).filter("code is not null")
        done = e.encoded(checked.filter("error is null")).select("conv_id", F.col("error.code").alias("code"), F.when(F.col("error").isNull(), F.col("prompt")).alias("prompt"))
        both = first.union(done)
        out = both if out is None else out.union(both)
    return out.withColumnRenamed("conv_id", "case_id")


def _numbered(results: list) -> list[tuple]:
    return [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(results)]


# Requests that are refused, each for its first fault -------------------------------------------------------------------

_REFUSED: list[tuple[int, str, dict, str | None]] = [
    (7, "test", {"messages": []}, "structure"), (7, "test", {"messages": [_assistant("x")]}, "structure"),
    (7, "serving", {"messages": [_user()]}, "request"), (7, "finetuning", {"messages": [_user()]}, "structure"),
    (7, "test", {"messages": [_user(), _result()]}, "structure"), (7, "test", {"messages": [_user(), _assistant("y")]}, "structure"),
    (3, "test", {"messages": [_user(), _assistant(), _user()]}, "assistant"), (7, "test", {"messages": [_user(), _assistant(), _user()]}, "encode"),
    (3, "test", {"messages": [_user(), _assistant(tool_calls=[_call("short")]), _user()]}, "call"), (3, "test", {"messages": [_user(), _assistant(tool_calls=[_call(name="f g")]), _user()]}, "call"),
    (7, "finetuning", {"messages": [_user(), _assistant("y", weight=0.5)]}, "assistant"), (7, "test", {"messages": [_user(), _assistant([_thought("t")]), _user()]}, "assistant"),
    (15, "test", {"messages": [{"role": "system", "content": [_thought("t")]}, _user()]}, "system"), (7, "test", {"messages": [{"role": "system", "content": None}, _user()]}, "system"),
    (7, "test", {"messages": [_user()], "reasoning_effort": "high"}, "request"), (15, "test", {"messages": [_user()], "reasoning_effort": "odd"}, "request"),
    (7, "test", {"messages": [_user()], "tools": [{"type": "function", "function": {"name": "f", "parameters": {"type": "no such"}}}]}, "schema"),
    (7, "test", {"messages": [_user()], "tools": [{"type": "function", "function": {"name": "f g"}}]}, "tools"),
    (7, "test", {"messages": [_user()], "truncate_for_context_length": True}, "encode"), (7, "test", {"messages": [_user()], "temperature": 2}, "construction"),
]


@cases("case_id, code", _numbered([r[3] for r in _REFUSED]))
def refused_requests(spark: SparkSession) -> DataFrame:
    return _prompts(spark, [r[:3] for r in _REFUSED]).select("case_id", "code")


# Prompts with calls, results, thinking and chunks --------------------------------------------------------------------------

_FULL = {"tools": [TOOL], "messages": [
    {"role": "system", "content": "S"}, _user("a"), _user([_text("b"), _text("c")]), _assistant(tool_calls=[_call(A, "f", {"x": 1.0}), _call(B, "g", '{"y":2}')]),
    _result(B, '{"k":1}', name="g"), _result(A, "r", name="f"), _assistant("ok  "), _user("z"),
]}
_CALLS = '[TOOL_CALLS][{"name": "f", "arguments": {"x": 1.0}%s}, {"name": "g", "arguments": {"y": 2}%s}]</s>'
_WITH_IDS = _CALLS % (f', "id": "{A}"', f', "id": "{B}"')
_TOOLS = f"[AVAILABLE_TOOLS][{TOOL_TEXT}][/AVAILABLE_TOOLS]"
_CALLED = f'[TOOL_CALLS]f[CALL_ID]{A}[ARGS]{{"x": 1.0}}[TOOL_CALLS]g[CALL_ID]{B}[ARGS]{{"y": 2}}</s>'
_SHORT = '[TOOL_CALLS]f[ARGS]{"x": 1.0}[TOOL_CALLS]g[ARGS]{"y": 2}</s>[TOOL_RESULTS]r[/TOOL_RESULTS][TOOL_RESULTS]{"k":1}[/TOOL_RESULTS]ok</s>[INST]z[/INST]'
_RENDERED: list[tuple[int, str, dict, str]] = [
    (2, "test", _FULL, f"<s>[INST]a\n\nb\n\nc[/INST]ok</s>{_TOOLS}[INST]S\n\nz[/INST]"),
    (3, "test", _FULL, f'<s>[INST]a\n\nb\n\nc[/INST]{_WITH_IDS}[TOOL_RESULTS]{{"content": {{"k": 1}}, "call_id": "{B}"}}[/TOOL_RESULTS][TOOL_RESULTS]{{"content": "r", "call_id": "{A}"}}[/TOOL_RESULTS]ok</s>{_TOOLS}[INST]S\n\nz[/INST]'),
    (7, "test", _FULL, f'<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]a\n\nb\n\nc[/INST]{_WITH_IDS}[TOOL_RESULTS]{B}[TOOL_CONTENT]{{"k":1}}[/TOOL_RESULTS][TOOL_RESULTS]{A}[TOOL_CONTENT]r[/TOOL_RESULTS]ok</s>{_TOOLS}[INST]z[/INST]'),
    (11, "test", _FULL, f'<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]a\n\nb\n\nc[/INST]{_CALLED}[TOOL_RESULTS]{A}[TOOL_CONTENT]r[/TOOL_RESULTS][TOOL_RESULTS]{B}[TOOL_CONTENT]{{"k":1}}[/TOOL_RESULTS]ok</s>{_TOOLS}[INST]z[/INST]'),
    (13, "test", _FULL, f"<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT]{_TOOLS}[INST]a\n\nb\n\nc[/INST]{_SHORT}"),
    (15, "test", _FULL, f"<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT]{_TOOLS}[INST]a\n\nbc[/INST]{_SHORT}"),
    (13, "test", {"messages": [_user(), _assistant([_thought("t"), _text("y ")]), _user("z")]}, "<s>[INST]x[/INST][THINK]t[/THINK]y </s>[INST]z[/INST]"),
    (13, "test", {"messages": [_user(), _assistant([_thought("t", closed=False)], prefix=True)]}, "<s>[INST]x[/INST][THINK]t"),
    (15, "test", {"messages": [_user()], "reasoning_effort": "high"}, '<s>[MODEL_SETTINGS]{"reasoning_effort": "high"}[/MODEL_SETTINGS][INST]x[/INST]'),
    (7, "test", {"messages": [_user(), _assistant("y", prefix=True)]}, "<s>[INST]x[/INST]y"),
]


@cases("case_id, prompt", _numbered([r[3] for r in _RENDERED]))
def rendered_requests(spark: SparkSession) -> DataFrame:
    return _prompts(spark, [r[:3] for r in _RENDERED]).select("case_id", "prompt")


@cases("prompt, tokens", [("<s>[INST][IMG][IMG][IMG][IMG_BREAK][IMG][IMG][IMG][IMG_END]a[/INST]", "1,3,10,10,10,12,10,10,10,13,197,4")])
def image_prompt(spark: SparkSession) -> DataFrame:
    read = _read(spark, [{"messages": [_user([_text("a"), {"type": "image_url", "image_url": {"url": "u"}}])]}])
    sized = F.transform("messages", lambda m: m.withField("chunks", F.transform(m["chunks"], lambda c: c.withField("width", F.lit(33)).withField("height", F.lit(17)))))
    return Engine.of(13).tokens(read.withColumn("messages", sized)).select("prompt", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


_NAMED = [
    ([_user(), _assistant(tool_calls=[_call(A, "f"), _call(B, "g")]), _result(B), _result(A)], "g f"),
    ([_user(), _result(A), _assistant(tool_calls=[_call(A, "f")]), _result(A), _assistant(tool_calls=[_call(A, "h")]), _result(A), _result(B), _result(A, name="own")], "- f h - own"),
]


@cases("case_id, names", _numbered([n for _, n in _NAMED]))
def results_named_by_calls(spark: SparkSession) -> DataFrame:
    read = _read(spark, [{"messages": m} for m, _ in _NAMED]).select("conv_id", normalize.named_results(F.col("messages")).alias("m"))
    names = F.transform(F.filter("m", lambda m: m["role"] == "tool"), lambda m: F.coalesce(m["name"], F.lit("-")))
    return read.select(F.col("conv_id").alias("case_id"), F.array_join(names, " ").alias("names"))


# Generated ids back to messages --------------------------------------------------------------------------------------------

_ANSWERS = [
    (13, [_thought("é"), _text("y")], [_call(A, "f", '{"a": [1, 2.0]}')], "think:é text:y", 'null*9:f:{"a": [1, 2.0]}'),
    (11, "c", [_call(A), _call(B, "g")], "c", f"{A}:f:{{}} {B}:g:{{}}"),
    (7, "c", [_call(A, "f", '{"k": "[ARGS]"}')], "c", f'{A}:f:{{"k": "[ARGS]"}}'),
]


@cases("case_id, content, calls", _numbered([a[3:] for a in _ANSWERS]))
def parsed_answers(spark: SparkSession) -> DataFrame:
    out = None
    for i, (v, content, calls, _, _) in enumerate(_ANSWERS):
        e = Engine.of(v)
        read = _read(spark, [{"messages": [_user("q"), _assistant(content, tool_calls=calls), *(_result(c["id"]) for c in calls)]}])
        back = e.messages(e.tokens(read).select(F.get("message_ids", F.lit(1)).alias("tokens")))
        chunks = F.array_join(F.transform("content", lambda c: F.concat(F.when(c["think"], F.lit("think:")).otherwise(F.lit("text:")), c["text"])), " ")
        id_ = lambda c: F.when(c["id"] == "null", F.lit("null*9")).otherwise(c["id"])  # noqa: E731  this version's texts hold no ids
        called = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(":", id_(c), c["name"], c["arguments"])), " ")
        row = back.select(F.lit(i).alias("case_id"), (chunks if isinstance(content, list) else F.col("content_text")).alias("content"), called.alias("calls"))
        out = row if out is None else out.union(row)
    return out


_LISTS = [([], True, None, None), (["[/THINK]"], True, None, None), (["[THINK]", "[THINK]"], True, None, None), (["[TOOL_CALLS]", 200], True, None, None),
          ([200, "</s>"], False, "text:d", False), (["[THINK]", 200], False, "think:d", True), (["</s>"], False, "", False)]


@cases("case_id, failed, content, unfinished", _numbered([x[1:] for x in _LISTS]))
def parsed_lists(spark: SparkSession) -> DataFrame:
    s = SpecialTokens()
    rows = [(i, [s.id(t) if isinstance(t, str) else t for t in x[0]]) for i, x in enumerate(_LISTS)]
    back = Engine.of(13).messages(spark.createDataFrame(rows, "case_id int, tokens array<int>"))
    good = F.col("parse_error").isNull()
    chunks = F.array_join(F.transform("content", lambda c: F.concat(F.when(c["think"], F.lit("think:")).otherwise(F.lit("text:")), c["text"])), " ")
    plain = F.when(F.size("content") == 0, F.lit("")).otherwise(chunks)
    content = F.when(F.col("content_text") != "", F.concat(F.lit("text:"), F.col("content_text"))).otherwise(plain)
    return back.select("case_id", (~good).alias("failed"), F.when(good, content).alias("content"), F.when(good, F.col("prefix")).alias("unfinished"))


# Truncation, settings, JSON ------------------------------------------------------------------------------------------------

_KEPT = [(26, "1111111", 0), (25, "1001111", 0), (16, "1001111", 0), (15, "1000011", 0), (10, "1000011", 0), (9, "1000010", 0), (6, "1000010", 0)]


@cases("budget, kept, over", _KEPT)
def kept_messages(spark: SparkSession) -> DataFrame:
    roles, counts = ["system", "user", "assistant", "user", "assistant", "user", "assistant"], [2, 5, 5, 3, 3, 4, 4]
    df = spark.createDataFrame([(roles, counts, b) for b, _, _ in _KEPT], "r array<string>, n array<int>, budget int")
    k = encode.kept_messages(F.col("r"), F.col("n"), F.col("budget"))
    return df.select("budget", F.array_join(F.transform(k["kept"], lambda x: x.cast("int").cast("string")), "").alias("kept"), k["over"].alias("over"))


_SETTINGS = [(None, True, None, None, None), (None, True, "high", "high", None), ("odd", True, None, None, "request"), (None, False, None, None, "request"), ("none", True, "high", "none", None)]


@cases("case_id, effort, code", _numbered([s[3:] for s in _SETTINGS]))
def settings_cases(spark: SparkSession) -> DataFrame:
    out = None
    for i, (effort, accepts, default, _, _) in enumerate(_SETTINGS):
        made = normalize.built_settings(F.lit(effort).cast("string"), version(15), accepts_none=accepts, default=default)
        row = spark.range(1).select(F.lit(i).alias("case_id"), made["effort"].alias("effort"), made["error"]["code"].alias("code"))
        row = row.withColumn("effort", F.when(F.col("code").isNull(), F.col("effort")))
        out = row if out is None else out.union(row)
    return out


_JSON = [('{"b":1.0,"a":[1e2,"é"],"b":2}', '{"b": 2, "a": [100.0, "é"]}', None), ("", "{}", "{}"), (None, "{}", None), ("{x", "{x", '"{x"'), ("[1,2]", "[1, 2]", "[1, 2]")]


@cases("case_id, normal, dumped", _numbered([(n, d) for _, n, d in _JSON]))
def json_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(i, t, d is not None) for i, (t, _, d) in enumerate(_JSON)], "case_id int, t string, told boolean")
    f = df.select("case_id", "told", F.get(jsontext.forms(F.array("t")), F.lit(0)).alias("f"))
    return f.select("case_id", F.col("f.normal").alias("normal"), F.when(F.col("told"), F.col("f.dumped")).alias("dumped"))


_SCHEMAS = [
    ("{}", True), ("true", True), ('{"type": ["string", "null"]}', True), ('{"properties": {"a": {"enum": []}}, "required": ["a"]}', True), ('{"items": [{"type": "object"}], "minItems": 2.0}', True),
    ("1", False), ('{"type": "no"}', False), ('{"type": []}', False), ('{"required": "a"}', False), ('{"required": ["a", "a"]}', False), ('{"properties": {"a": 1}}', False),
    ('{"anyOf": []}', False), ('{"minLength": -1}', False), ('{"multipleOf": 0}', False), ('{"pattern": 3}', False), ('{"not": {"type": 4}}', False),
]


@cases("case_id, good", _numbered([g for _, g in _SCHEMAS]))
def schema_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(_SCHEMAS)], "case_id int, s string")
    return df.select("case_id", F.get(jsontext.schema_faults(F.array("s")), F.lit(0)).isNull().alias("good"))


# Speech, streaming and infilling -------------------------------------------------------------------------------------------


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _with_ids(df: DataFrame) -> DataFrame:
    return df.select("case_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@cases("case_id, tokens", [(0, _joined([1, 25] + [24] * 52 + [35, 204, 205, 36, 25])), (1, _joined([1, 25] + [24] * 76 + [35, 36, 25]))])
def speech_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "hi", None, None, "female"), (1, "", None, None, "male")], "case_id int, input string, n_samples int, sampling_rate int, voice string")
    return _with_ids(encode.speech(df, vocabulary.Vocabulary(special=speech_tokens()), media.AudioConfig(voices={"female": 52, "male": 76})))


@cases("case_id, tokens", [(0, _joined([1] + [39] * 38))])
def streaming_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, 40_800, "en")], "case_id int, n_samples int, language string")
    return _with_ids(encode.streaming_transcription(df, vocabulary.Vocabulary(), media.AudioConfig(streaming=True), 480.0))


@cases("case_id, tokens", [(0, _joined([1, 16, 0xBA + 100, ord("s") + 100, 14, ord("p") + 100])), (1, _joined([1, 16, 14, ord("p") + 100])), (2, "1,16,14")])
def infilling_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "p", "s"), (1, "p", None), (2, "", "")], "case_id int, prompt string, suffix string")
    return _with_ids(encode.fill_in_middle(df, vocabulary.Vocabulary()))


# Conversion and media ------------------------------------------------------------------------------------------------------

_UNREAD = [
    {"messages": [{"role": "odd"}]}, {"messages": "x"}, {"messages": [], "seed": 1, "random_seed": 2}, {"messages": [_user([{"type": "image"}])]}, {"messages": [_assistant(reasoning="a", reasoning_content="b")]},
    {"messages": [_assistant([_thought("t")], reasoning="a")]}, {"messages": [_user([{"type": "input_audio", "input_audio": ""}])]}, {"messages": [_user()]},
]


@cases("conv_id, failed", [(i, i < len(_UNREAD) - 1) for i in range(len(_UNREAD))])
def unread_requests(spark: SparkSession) -> DataFrame:
    return _read(spark, _UNREAD).select("conv_id", F.col("convert_error").isNotNull().alias("failed"))


@cases("form, reasoning, content, seed, choice, tool", [
    ("reasoning", "t", "a", 5, "required", "f"), ("reasoning_content", "t", "a", 5, "required", "f"), ("thinking_chunks", None, '[{"type":"thinking","thinking":"t","closed":true},{"type":"text","text":"a"}]', 5, "required", "f"),
])
def written_requests(spark: SparkSession) -> DataFrame:
    read = _read(spark, [{"messages": [_user("q"), _assistant("a", reasoning="t")], "seed": 5, "tools": [TOOL], "tool_choice": "any"}])
    out = None
    for form in ("reasoning", "reasoning_content", "thinking_chunks"):
        at = lambda path: F.get_json_object("request", path)
        reasoning = F.coalesce(at("$.messages[1].reasoning"), at("$.messages[1].reasoning_content"))
        row = convert.to_json(read, form).select(F.lit(form).alias("form"), reasoning.alias("reasoning"), at("$.messages[1].content").alias("content"), at("$.seed").cast("int").alias("seed"), at("$.tool_choice").alias("choice"), at("$.tools[0].function.name").alias("tool"))
        out = row if out is None else out.union(row)
    return out


@cases("case_id, format, width, height, same", [(0, "png", 37, 11, True), (1, "gif", 5, 7, True), (2, None, None, None, True)])
def picture_headers(spark: SparkSession) -> DataFrame:
    data = [media_source.gray_png(37, 11), b"GIF89a" + (5).to_bytes(2, "little") + (7).to_bytes(2, "little"), b"none"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "case_id int, b binary")
    d, again = media_source.image_dimensions(F.col("b")), media_source.inline_bytes(media_source.data_url(F.col("b")))
    return df.select("case_id", media_source.image_format(F.col("b")).alias("format"), d["width"].cast("int").alias("width"), d["height"].cast("int").alias("height"), (again == F.col("b")).alias("same"))
