"""Requests through the whole engine, with texts worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom.operators import convert, encode, grammar
from turnloom.plans.chat import Engine
from turnloom.sources import vocabulary
from turnloom.special import SpecialTokens
from turnloom.versions import VERSIONS, version

A, B = "abcdefghi", "abcdefghj"
TOOLS = [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {}}}}]
TOOLS_TEXT = '[{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {}}}}]'
FULL = [
    {"role": "system", "content": "S"}, {"role": "user", "content": "a"}, {"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]},
    {"role": "assistant", "tool_calls": [{"id": A, "function": {"name": "f", "arguments": {"x": 1.0}}}, {"id": B, "function": {"name": "g", "arguments": '{"y":2}'}}]},
    {"role": "tool", "tool_call_id": B, "content": '{"k":1}', "name": "g"}, {"role": "tool", "tool_call_id": A, "content": "r", "name": "f"},
    {"role": "assistant", "content": "ok  "}, {"role": "user", "content": "z"},
]


@pytest.fixture(scope="module")
def read(spark):
    def make(messages, **more):
        rows = [(i, json.dumps({"messages": m, **more})) for i, m in enumerate(messages)]
        return convert.from_json(spark.createDataFrame(rows, "conv_id long, request string"))

    return make


def prompt(read, v, messages, mode="test", **more):
    e = Engine.of(v, mode=mode)
    checked = e.checked(read([messages], **more))
    row = checked.select("error").first()
    if row.error:
        return row.error.code
    r = e.encoded(checked).select("prompt", "error").first()
    return r.error.code if r.error else r.prompt


def test_all_versions_of_one_request(read):
    got = {n: prompt(read, n, FULL, tools=TOOLS) for n in VERSIONS}
    calls = '[TOOL_CALLS][{"name": "f", "arguments": {"x": 1.0}%s}, {"name": "g", "arguments": {"y": 2}%s}]</s>'
    with_ids = calls % (f', "id": "{A}"', f', "id": "{B}"')
    tools = f"[AVAILABLE_TOOLS]{TOOLS_TEXT}[/AVAILABLE_TOOLS]"
    assert got[1] == "encode"
    assert got[2] == f"<s>[INST]a\n\nb\n\nc[/INST]ok</s>{tools}[INST]S\n\nz[/INST]"
    assert got[3] == f'<s>[INST]a\n\nb\n\nc[/INST]{with_ids}[TOOL_RESULTS]{{"content": {{"k": 1}}, "call_id": "{B}"}}[/TOOL_RESULTS][TOOL_RESULTS]{{"content": "r", "call_id": "{A}"}}[/TOOL_RESULTS]ok</s>{tools}[INST]S\n\nz[/INST]'
    assert got[7] == f'<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]a\n\nb\n\nc[/INST]{with_ids}[TOOL_RESULTS]{B}[TOOL_CONTENT]{{"k":1}}[/TOOL_RESULTS][TOOL_RESULTS]{A}[TOOL_CONTENT]r[/TOOL_RESULTS]ok</s>{tools}[INST]z[/INST]'
    called = f'[TOOL_CALLS]f[CALL_ID]{A}[ARGS]{{"x": 1.0}}[TOOL_CALLS]g[CALL_ID]{B}[ARGS]{{"y": 2}}</s>'
    assert got[11] == f'<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]a\n\nb\n\nc[/INST]{called}[TOOL_RESULTS]{A}[TOOL_CONTENT]r[/TOOL_RESULTS][TOOL_RESULTS]{B}[TOOL_CONTENT]{{"k":1}}[/TOOL_RESULTS]ok</s>{tools}[INST]z[/INST]'
    short = '[TOOL_CALLS]f[ARGS]{"x": 1.0}[TOOL_CALLS]g[ARGS]{"y": 2}</s>[TOOL_RESULTS]r[/TOOL_RESULTS][TOOL_RESULTS]{"k":1}[/TOOL_RESULTS]ok</s>[INST]z[/INST]'
    assert got[13] == f"<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT]{tools}[INST]a\n\nb\n\nc[/INST]{short}"
    assert got[15] == f"<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT]{tools}[INST]a\n\nbc[/INST]{short}"


@pytest.mark.parametrize(("mode", "messages", "v", "code"), [
    ("test", [], 7, "structure"), ("test", [{"role": "assistant", "content": "x"}], 7, "structure"), ("test", [{"role": "system", "content": "x"}], 7, None),
    ("serving", [{"role": "user", "content": "x"}], 7, "request"), ("finetuning", [{"role": "user", "content": "x"}], 7, "structure"),
    ("test", [{"role": "user", "content": "x"}, {"role": "tool", "content": "y"}], 7, "structure"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}], 7, "structure"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y", "prefix": True}], 7, None),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant"}, {"role": "user", "content": "z"}], 3, "assistant"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant"}, {"role": "user", "content": "z"}], 7, "encode"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "tool_calls": [{"id": "short", "function": {"name": "f"}}]}, {"role": "user", "content": "z"}], 3, "call"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "tool_calls": [{"id": A, "function": {"name": "f g"}}]}, {"role": "user", "content": "z"}], 3, "call"),
    ("finetuning", [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y", "weight": 0.5}], 7, "assistant"),
    ("finetuning", [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y", "weight": 1}], 7, None),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}]}, {"role": "user", "content": "z"}], 7, "assistant"),
    ("test", [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}]}, {"role": "user", "content": "z"}], 11, "encode"),
    ("test", [{"role": "system", "content": [{"type": "thinking", "thinking": "t"}]}, {"role": "user", "content": "x"}], 15, "system"),
    ("test", [{"role": "system", "content": None}, {"role": "user", "content": "x"}], 7, "system"),
])
def test_first_errors(read, mode, messages, v, code):
    got = prompt(read, v, messages, mode)
    assert got == code if code else got.startswith("<s>")


def test_effort_tools_and_truncation_flags(read):
    user = [{"role": "user", "content": "x"}]
    assert prompt(read, 7, user, reasoning_effort="high") == "request"
    assert prompt(read, 15, user, reasoning_effort="high") == '<s>[MODEL_SETTINGS]{"reasoning_effort": "high"}[/MODEL_SETTINGS][INST]x[/INST]'
    assert prompt(read, 15, user, reasoning_effort="odd") == "request"
    bad = [{"type": "function", "function": {"name": "f", "parameters": {"type": "no such"}}}]
    assert prompt(read, 7, user, tools=bad) == "schema"
    assert prompt(read, 7, user, tools=[{"type": "function", "function": {"name": "f g"}}]) == "tools"
    assert prompt(read, 7, user, truncate_for_context_length=True) == "encode"
    assert prompt(read, 7, user, temperature=2) == "construction"


def test_images_thinking_and_order_of_chunks(read):
    image = {"type": "image_url", "image_url": {"url": "u"}}
    e = Engine.of(13)
    content = [{"type": "text", "text": "a"}, image]
    sized = read([[{"role": "user", "content": content}]]).withColumn("messages", F.transform("messages", lambda m: m.withField("chunks", F.transform(m["chunks"], lambda c: c.withField("width", F.lit(33)).withField("height", F.lit(17))))))
    r = e.tokens(sized).select("prompt", "tokens", "error").first()
    assert r.error is None
    assert r.prompt == "<s>[INST]" + "[IMG][IMG][IMG][IMG_BREAK][IMG][IMG][IMG][IMG_END]" + "a[/INST]"
    assert r.tokens == [1, 3, 10, 10, 10, 12, 10, 10, 10, 13, 197, 4]
    think = [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "y "}]}, {"role": "user", "content": "z"}]
    assert prompt(read, 13, think) == "<s>[INST]x[/INST][THINK]t[/THINK]y </s>[INST]z[/INST]"
    open_ = [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t", "closed": False}], "prefix": True}]
    assert prompt(read, 13, open_) == "<s>[INST]x[/INST][THINK]t"


@pytest.mark.parametrize(("v", "message"), [
    (13, {"role": "assistant", "content": [{"type": "thinking", "thinking": "é"}, {"type": "text", "text": "y"}], "tool_calls": [{"id": A, "function": {"name": "f", "arguments": '{"a": [1, 2.0]}'}}]}),
    (11, {"role": "assistant", "content": "c", "tool_calls": [{"id": A, "function": {"name": "f", "arguments": "{}"}}, {"id": B, "function": {"name": "g", "arguments": "{}"}}]}),
    (7, {"role": "assistant", "content": "c", "tool_calls": [{"id": A, "function": {"name": "f", "arguments": '{"k": "[ARGS]"}'}}]}),
])
def test_parsing_gives_back_what_was_encoded(read, v, message):
    e = Engine.of(v)
    tail = [{"role": "tool", "tool_call_id": c["id"], "content": "r"} for c in message["tool_calls"]]
    x = e.tokens(read([[{"role": "user", "content": "q"}, message, *tail]])).select(F.get("message_ids", F.lit(1)).alias("tokens"))
    r = e.messages(x).first()
    assert r.parse_error is None and r.prefix is False
    want = message["content"]
    if isinstance(want, str):
        assert r.content_text == want
    else:
        assert [(c.text, c.think) for c in r.content] == [(c.get("text", c.get("thinking")), c["type"] == "thinking") for c in want]
    ids = ["null"] * 9 if v == 13 else [c["id"] for c in message["tool_calls"]]
    assert [(c.id, c.name, c.arguments) for c in r.tool_calls] == [(i, c["function"]["name"], c["function"]["arguments"]) for i, c in zip(ids, message["tool_calls"], strict=False)]


def test_parse_errors(spark):
    e, s = Engine.of(13), SpecialTokens()
    lists = [[], [s.id("[/THINK]")], [s.id("[THINK]"), s.id("[THINK]")], [s.id("[TOOL_CALLS]"), 200], [200, s.id("</s>")], [s.id("[THINK]"), 200], [s.id("</s>")]]
    rows = e.messages(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, tokens array<int>")).orderBy("i").collect()
    assert [r.parse_error is not None for r in rows] == [True, True, True, True, False, False, False]
    assert rows[4].content_text == "d" and rows[4].prefix is False
    assert [(c.text, c.think, c.closed) for c in rows[5].content] == [("d", True, False)] and rows[5].prefix is True
    assert rows[6].content == []


def test_truncation(spark):
    roles, counts = ["system", "user", "assistant", "user", "assistant", "user", "assistant"], [2, 5, 5, 3, 3, 4, 4]
    df = spark.createDataFrame([(roles, counts, b) for b in (26, 25, 16, 15, 10, 9, 6, 5)], "r array<string>, n array<int>, b int")
    got = {x.b: (x.k.kept, x.k.over) for x in df.select("b", encode.kept_messages(F.col("r"), F.col("n"), F.col("b")).alias("k")).collect()}
    t, f = True, False
    assert got[26] == ([t] * 7, 0)
    assert got[25] == got[16] == ([t, f, f, t, t, t, t], 0)
    assert got[15] == got[10] == ([t, f, f, f, f, t, t], 0)
    assert got[9] == got[6] == ([t, f, f, f, f, t, f], 0)  # even the last message can go
    assert got[5][1] == 1


def test_vocabulary_files(tmp_path):
    import base64

    words = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    data = {
        "config": {"pattern": "(?s:.+)", "default_vocab_size": 257 + 100, "default_num_special_tokens": 100, "version": "v7"},
        "vocab": [{"rank": i, "token_bytes": base64.b64encode(w).decode(), "token_str": None} for i, w in enumerate(words)],
    }
    path = tmp_path / "words.json"
    path.write_text(json.dumps(data))
    v = vocabulary.load(str(path))
    assert len(v.words) == 257 and v.special.id("[INST]") == 3 and v.size == 357
    for bad in ({"version": "v99"}, {"version": "v13"}):
        path.write_text(json.dumps(data | {"config": data["config"] | bad}))
        with pytest.raises(ValueError):
            vocabulary.load(str(path))
    path.write_text(json.dumps(data | {"vocab": data["vocab"][1:]}))
    with pytest.raises(ValueError):
        vocabulary.load(str(path))
    assert vocabulary.choose(["a/x.model.v3", "b/words.json", "c/y.model.v7"]) == "b/words.json"
    assert vocabulary.choose(["a/x.model.v3", "c/y.model.v7", "d/readme"]) == "c/y.model.v7"
    assert [vocabulary.piece_model(p) for p in ("x.model", "x.model.v3", "x.model.v7m1", "x.json")] == [(1, False), (3, False), (7, True), None]


def test_special_tokens():
    with pytest.raises(ValueError):
        SpecialTokens(10)
    with pytest.raises(ValueError):
        SpecialTokens().id("[NO]")
    assert SpecialTokens().names()[20] == "<SPECIAL_20>"
    assert version("v7m1").number == 7
    with pytest.raises(ValueError):
        version(4)


def test_conversion(read, spark):
    refused = [
        {"messages": [{"role": "odd"}]}, {"messages": "x"}, {"messages": [], "seed": 1, "random_seed": 2}, {"messages": [{"role": "user", "content": [{"type": "image"}]}]},
        {"messages": [{"role": "assistant", "reasoning": "a", "reasoning_content": "b"}]}, {"messages": [{"role": "assistant", "reasoning": "a", "content": [{"type": "thinking", "thinking": "t"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "input_audio", "input_audio": ""}]}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(refused)] + [(99, "no json"), (98, None)], "conv_id long, request string")
    assert all(r.convert_error is not None for r in convert.from_json(df).collect())
    m = [{"role": "user", "content": "q"}, {"role": "assistant", "reasoning": "t", "content": "a"}]
    for form, key in (("reasoning", "reasoning"), ("reasoning_content", "reasoning_content")):
        out = json.loads(convert.to_json(read([m], seed=5, tools=TOOLS, tool_choice="any"), form).first().request)
        assert out["messages"][1] == {"role": "assistant", key: "t", "content": "a"}
        assert out["seed"] == 5 and out["tool_choice"] == "required" and out["tools"][0]["function"]["name"] == "f"
    chunks = json.loads(convert.to_json(read([m])).first().request)["messages"][1]["content"]
    assert chunks == [{"type": "thinking", "thinking": "t", "closed": True}, {"type": "text", "text": "a"}]
    assert convert.to_json(read([m], truncate_for_context_length=True)).first().error


def test_grammars_and_templates(spark):
    s = SpecialTokens()
    assert grammar.supported(version(11), True) and not grammar.supported(version(7), True)
    assert [grammar.variant(version(n), s, r) for n, r in ((13, False), (11, False), (11, True))] == ["think", "base", "plain"]
    none = F.lit(None).cast("string")
    rows = spark.range(1).select(*(grammar.grammar(k, F.lit("auto"), F.lit("CALLS"), F.lit("{}"), s, think_with_json=True).alias(k) for k in ("base", "plain", "think")), grammar.grammar("base", F.lit("none"), F.lit(""), none, s).alias("n")).first()
    assert rows.think.startswith("start: body | json_grammar\njson_grammar: think? SAFE_WS? %json {}\nbody: think? (content | fcalls)\nfcalls: content? CALLS\n")
    assert "think: <[35]> content <[36]>" in rows.think and "NO_THINK" in rows.plain and rows.n.startswith("start: body\nbody: content\n")
    for n in VERSIONS:
        t = grammar.chat_template(version(n), thinking=n >= 13, images=n >= 3)
        assert t.count("{%-") == t.count("%}") and t.count("{{-") == t.count("}}")
    with pytest.raises(ValueError):
        grammar.chat_template(version(7), thinking=True)


def test_vocabulary_decides():
    image, audio = {"image_patch_size": 14, "max_image_size": 1540, "spatial_merge_size": 2}, {"sampling_rate": 16000, "frame_rate": 12.5, "audio_encoding_config": {"num_mel_bins": 128, "hop_length": 160, "window_size": 400}, "chunk_length_s": 30.0}
    effort = {"reasoning_effort": {"type": "enum", "accepts_none": False, "default": "none", "values": ["none", "high"]}}
    words = vocabulary.Vocabulary(version="v15", image=json.dumps(image), audio=json.dumps(audio), settings=json.dumps(effort))
    e = Engine.for_vocabulary(words, mode="serving")
    assert (e.version.number, e.mode, e.image.patch, e.image.merge, e.audio.chunk_samples) == (15, "serving", 14, 2, 480_000)
    assert (e.efforts, e.effort_default, e.effort_may_lack) == (("none", "high"), "none", False)
    assert "[THINK]" in grammar.template_for(words) and "[IMG]" in grammar.template_for(words)
    plain = Engine.for_vocabulary(vocabulary.Vocabulary())
    assert plain.version.number == 7 and "[IMG]" not in grammar.template_for(plain.vocabulary)


def test_audio_requests_as_json(spark):
    df = spark.createDataFrame([('{"audio": "AQID", "language": "en", "seed": 4, "extra": 1}', '{"input": "hi", "voice": {"id": "v1"}}'), ('{"audio": "AQID"}', '{"input": "hi", "voice": "v2", "ref_audio": "AQID"}')], "t string, s string")
    rows = df.select(convert.transcription_from_json(F.col("t")).alias("t"), convert.speech_from_json(F.col("s")).alias("s"))
    a, b = rows.collect()
    assert (bytes(a.t.audio), a.t.language, a.t.streaming, a.t.seed, b.t.seed, a.s.voice, b.s.voice, bytes(b.s.ref_audio)) == (b"\x01\x02\x03", "en", "disabled", 4, None, "v1", "v2", b"\x01\x02\x03")
    out = rows.select(convert.transcription_to_json(F.col("t")).alias("t"), convert.speech_to_json(F.col("s")).alias("s")).collect()
    assert json.loads(out[0].t) == {"audio": "AQID", "language": "en", "streaming": "disabled", "temperature": 0.7, "seed": 4}
    assert json.loads(out[1].s) == {"input": "hi", "voice": "v2", "ref_audio": "AQID"}
