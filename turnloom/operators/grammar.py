"""Text that steers generation: grammars for constrained decoding, and chat templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.arrays import let
from turnloom.sources.vocabulary import Vocabulary
from turnloom.special import SpecialTokens
from turnloom.versions import Version, version

CHOICES = ("auto", "any", "required", "none")
_ANY_OBJECT = '{"type": "object"}'
_NO_ARGUMENTS = '{"type": "object", "properties": {}, "additionalProperties": false}'
# Terminals of the grammars, in the notation of the constraint engine they are written for.
_BLANK = r"SAFE_WS: /[ \t\r\n]{1,8}/"
_ANY_TEXT = r"/(.|\n)+/"
_NO_TAGS = r"NO_THINK: /(.|\n)+/ & ~/(?s:.*)(<\/think>|<think>)(?s:.*)/"
_TAG_END = r"end_think[capture, lazy]: /(.|\n)*<\/think>/"


def supported(v: Version, with_bytes: bool) -> bool:
    """Grammars need a byte vocabulary and calls in the form of v11 or later."""
    return with_bytes and v.number >= 11


def variant(v: Version, s: SpecialTokens, reasoning: bool = False) -> str:
    """'think' where thinking has special marks, 'plain' where it is asked for without them, else 'base'."""
    marked = v.think and "[THINK]" in s.ranks and "[/THINK]" in s.ranks
    return "think" if marked else "plain" if reasoning else "base"


def _mark(s: SpecialTokens, name: str) -> str:
    return f"<[{s.id(name)}]>"


def calls_rule(tools: Column, choice: Column, named: Column, parallel: bool, s: SpecialTokens) -> Column:
    """What calls may look like: one alternative per tool if any is strict, else any call; '' where none is allowed."""
    head, args = _mark(s, "[TOOL_CALLS]"), _mark(s, "[ARGS]")
    one = lambda name, json: F.concat(F.lit(f"{head} SAFE_WS? "), name, F.lit(f" {args} SAFE_WS? %json "), json, F.lit(" SAFE_WS?"))
    quoted = lambda n: F.concat(F.lit('"'), n, F.lit('"'))
    loose = one(F.when(named.isNotNull(), quoted(named)).otherwise(F.lit("/.+/")), F.lit(_ANY_OBJECT))
    schema = lambda t: F.when(~t["strict"], F.lit(_ANY_OBJECT)).when(F.coalesce(t["parameters"], F.lit("{}")).isin("{}", ""), F.lit(_NO_ARGUMENTS)).otherwise(t["parameters"])
    usable = F.filter(tools, lambda t: named.isNull() | (t["name"] == named))
    strict = let(F.transform(usable, lambda t: one(quoted(t["name"]), schema(t))), lambda parts: F.when(
        F.size(parts) > 1, F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), p, F.lit(")"))), " | ")).otherwise(F.get(parts, F.lit(0))))
    rule = F.when(F.coalesce(F.exists(tools, lambda t: t["strict"]), F.lit(False)), strict).otherwise(loose)
    return F.when(choice == "none", F.lit("")).otherwise(F.concat(F.lit("("), rule, F.lit(")+")) if parallel else rule)


def grammar(kind: str, choice: Column, calls: Column, json_schema: Column, s: SpecialTokens, json_only: bool = False, think_with_json: bool = False) -> Column:
    """A whole grammar. json_schema: null where answers needn't be JSON; json_only: then nothing else is allowed."""
    eol = F.lit("\n")
    json = F.concat(F.lit("SAFE_WS? %json "), json_schema)
    if kind == "think":
        own = F.lit("json_grammar")
        extra = F.when(json_schema.isNotNull(), F.concat(F.lit("json_grammar: think? " if think_with_json else "json_grammar: "), json, eol)).otherwise(F.lit(""))
    else:
        own, extra = json, F.lit("")
    start = F.when(json_schema.isNull(), F.lit("start: body")).otherwise(F.concat(F.lit("start: " if json_only else "start: body | "), own))
    bodies = {
        "base": {"auto": "content | (content? fcalls)", "any": "fcalls", "required": "content? fcalls", "none": "content"},
        "plain": {"auto": "think (content | fcalls)", "any": "think fcalls", "required": "think fcalls", "none": "think content"},
        "think": {"auto": "think? (content | fcalls)", "any": "think? fcalls", "required": "think? fcalls", "none": "think? content"},
    }[kind]
    body = F.lit(None).cast("string")
    for name, rule in bodies.items():
        body = F.when(choice == name, F.lit(f"body: {rule}")).otherwise(body)
    call = F.concat(F.lit("fcalls: content? " if kind == "think" else "fcalls: "), calls)
    tail = {
        "base": [f"content: ({_ANY_TEXT})+"],
        "plain": [_NO_TAGS, _TAG_END, "text_first_optional: (NO_THINK)*", "content: NO_THINK", "think: SAFE_WS? /<think>/ text_first_optional end_think"],
        "think": [f"content: ({_ANY_TEXT})+"] + ([f"think: {_mark(s, '[THINK]')} content {_mark(s, '[/THINK]')}"] if kind == "think" else []),
    }[kind]
    return F.concat(start, eol, extra, body, eol, call, eol, F.lit("\n".join([*tail, _BLANK]) + "\n"))


def chat_template(v: Version, thinking: bool = False, images: bool = False) -> str:
    """A Jinja chat template that writes what render.prompt_text() reads, for text, calls and, if asked for, thinking and
    image placeholders. Merging and ordering of messages are the caller's, as the template language has no clean way."""
    if thinking and not v.think:
        raise ValueError("this version has no thinking marks")
    if images and v.number < 3:
        raise ValueError("this version has no images")
    lines = ["{{- bos_token }}"]
    kinds = ["{%- if part.type == 'text' %}{{- part.text }}"]
    if thinking:
        kinds.append("{%- elif part.type == 'thinking' %}{{- '[THINK]' + part.thinking }}{%- if part.closed is not defined or part.closed %}{{- '[/THINK]' }}{%- endif %}")
    if images:
        kinds.append("{%- elif part.type in ('image', 'image_url') %}{{- '[IMG]' }}")
    kinds.append("{%- else %}{{- raise_exception('no such content here: ' + part.type) }}{%- endif %}")
    lines.append("{%- macro content(c) %}{%- if c is string %}{{- c }}{%- else %}{%- for part in c %}" + "".join(kinds) + "{%- endfor %}{%- endif %}{%- endmacro %}")
    at = {"last": "loop.last or (messages[loop.index0 + 1:] | selectattr('role', 'equalto', 'user') | list | length == 0)", "first": "(messages[:loop.index0] | selectattr('role', 'equalto', 'user') | list | length == 0)"}
    tools = "{%- if tools is defined and tools and " + at.get(v.tools_on or "last", "") + " %}{{- '[AVAILABLE_TOOLS]' + (tools | tojson) + '[/AVAILABLE_TOOLS]' }}{%- endif %}" if v.tools_on else ""
    settings = "{%- if reasoning_effort is defined and reasoning_effort and " + at["first"] + " %}{{- '[MODEL_SETTINGS]{\"reasoning_effort\": \"' + reasoning_effort + '\"}[/MODEL_SETTINGS]' }}{%- endif %}" if v.settings else ""
    system = at["first"] if v.system_on == "first" else at["last"]
    lead = "" if v.system_in_place else "{%- if messages[0].role == 'system' and " + system + " %}{{- content(messages[0].content) + '\\n\\n' }}{%- endif %}"
    marks = ("[INST] ", " [/INST]") if not v.markers else ("[INST]", "[/INST]")
    lines.append("{%- for m in messages %}")
    lines.append("{%- if m.role == 'user' %}" + tools + settings + "{{- '" + marks[0] + "' }}" + lead + "{{- content(m.content) + '" + marks[1] + "' }}")
    if v.system_in_place:
        lines.append("{%- elif m.role == 'system' %}{{- '[SYSTEM_PROMPT]' + content(m.content) + '[/SYSTEM_PROMPT]' }}")
    else:
        lines.append("{%- elif m.role == 'system' %}")
    if v.number >= 11:
        ids = "{{- '[CALL_ID]' + c.id }}" if v.number == 11 else ""
        calls = "{%- for c in m.tool_calls or [] %}{{- '[TOOL_CALLS]' + c.function.name }}" + ids + "{{- '[ARGS]' + (c.function.arguments if c.function.arguments is string else c.function.arguments | tojson) }}{%- endfor %}"
    elif v.number > 1:
        id_ = " + ', \"id\": \"' + c.id + '\"'" if v.number >= 3 else ""
        calls = "{%- if m.tool_calls %}{{- '[TOOL_CALLS][' }}{%- for c in m.tool_calls %}{{- '{\"name\": \"' + c.function.name + '\", \"arguments\": ' + (c.function.arguments if c.function.arguments is string else c.function.arguments | tojson)" + id_ + " + '}' }}{%- if not loop.last %}{{- ', ' }}{%- endif %}{%- endfor %}{{- ']' }}{%- endif %}"
    else:
        calls = "{%- if m.tool_calls %}{{- raise_exception('v1 has no tools') }}{%- endif %}"
    lines.append("{%- elif m.role == 'assistant' %}{%- if m.content %}{{- content(m.content) }}{%- endif %}" + calls + "{{- eos_token }}")
    if v.number >= 13:
        result = "{{- '[TOOL_RESULTS]' + content(m.content) + '[/TOOL_RESULTS]' }}"
    elif v.number >= 7:
        result = "{{- '[TOOL_RESULTS]' + m.tool_call_id + '[TOOL_CONTENT]' + content(m.content) + '[/TOOL_RESULTS]' }}"
    elif v.number == 3:
        result = "{{- '[TOOL_RESULTS]{\"content\": ' + content(m.content) + ', \"call_id\": \"' + m.tool_call_id + '\"}[/TOOL_RESULTS]' }}"
    elif v.number == 2:
        result = "{{- '[TOOL_RESULTS][{\"name\": \"' + m.name + '\", \"content\": ' + content(m.content) + '}][/TOOL_RESULTS]' }}"
    else:
        result = "{{- raise_exception('v1 has no tools') }}"
    lines.append("{%- elif m.role == 'tool' %}" + result)
    lines.append("{%- else %}{{- raise_exception('no such role: ' + m.role) }}{%- endif %}")
    lines.append("{%- endfor %}")
    return "\n".join(lines) + "\n"


def template_for(words: Vocabulary) -> str:
    """The chat template for a vocabulary: with thinking if it has the marks, with images if it has their block."""
    v = version(words.version)
    return chat_template(v, v.think and {"[THINK]", "[/THINK]"} <= words.special.ranks.keys(), v.number >= 3 and words.image is not None)
