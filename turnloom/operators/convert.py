"""Conversion between requests as JSON in the common chat-API form and the engine's columns.

Content is text or a list, arguments text or an object, so the JSON has no one schema; it is read in Arrow batches. What
a request breaks is its row's `error`; the batch goes on.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom import schema

THINKING_FORMS = ("thinking_chunks", "reasoning", "reasoning_content")
_EMPTY = dict.fromkeys(("text", "closed", "url", "detail", "data", "width", "height", "n_samples", "sampling_rate"))


class Refused(ValueError):
    """A request that doesn't follow the form."""


@lru_cache(maxsize=8)
def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(kind))


def _bytes(data: str) -> bytes:
    try:
        return base64.b64decode(data.split(",", 1)[1] if data.startswith("data:") else data, validate=True)
    except (ValueError, IndexError) as e:
        raise Refused("data isn't base64") from e


def chunk_in(c: dict) -> dict:
    kind = c.get("type") if isinstance(c, dict) else None
    if kind == "text":
        return _EMPTY | {"type": kind, "text": str(c["text"])}
    if kind == "thinking":
        return _EMPTY | {"type": kind, "text": str(c["thinking"]), "closed": bool(c.get("closed", True))}
    if kind in ("image_url", "audio_url"):
        at = c[kind]
        return _EMPTY | {"type": kind, "url": at["url"] if isinstance(at, dict) else str(at), "detail": at.get("detail") if isinstance(at, dict) else None}
    if kind == "input_audio":
        audio = c[kind]
        data = _bytes(audio["data"] if isinstance(audio, dict) else audio)
        if not data:
            raise Refused("audio is empty")
        return _EMPTY | {"type": kind, "data": data, "detail": audio.get("format") if isinstance(audio, dict) else None}
    raise Refused(f"no chunk of type {kind}")  # 'image' has no form in this API: pictures come as image_url


def chunk_out(c: dict) -> dict:
    kind = c["type"]
    if kind == "text":
        return {"type": kind, "text": c["text"]}
    if kind == "thinking":
        return {"type": kind, "thinking": c["text"], "closed": True if c["closed"] is None else c["closed"]}
    if kind in ("image_url", "audio_url"):
        return {"type": kind, kind: {"url": c["url"]} | ({"detail": c["detail"]} if c["detail"] else {})}
    if kind == "image":
        return {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(c["data"]).decode()}}
    return {"type": kind, "input_audio": {"data": base64.b64encode(c["data"]).decode()} | ({"format": c["detail"]} if c["detail"] else {})}


def _call_in(c: dict) -> dict:
    f = c["function"]
    arguments = f.get("arguments")
    text = "{}" if arguments is None else arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)
    return {"id": c.get("id") or "null", "name": f["name"], "arguments": text}


def message_in(m: dict) -> dict:
    role = m.get("role")
    if role not in ("system", "user", "assistant", "tool"):
        raise Refused(f"no such role: {role}")
    content = m.get("content")
    if content is not None and not isinstance(content, (str, list)):
        raise Refused("content is text or a list")
    kind = "null" if content is None else "str" if isinstance(content, str) else "list"
    chunks = [] if content is None else [_EMPTY | {"type": "text", "text": content}] if kind == "str" else [chunk_in(c) for c in content]
    calls = m.get("tool_calls")
    if calls is not None and not isinstance(calls, list):
        raise Refused("tool_calls is a list")
    told = {m[k] for k in ("reasoning", "reasoning_content") if role == "assistant" and m.get(k) is not None}
    if len(told) > 1:
        raise Refused("reasoning and reasoning_content differ")
    if told:
        if any(c["type"] == "thinking" for c in chunks):
            raise Refused("thinking is given twice")
        kind, chunks = "list", [_EMPTY | {"type": "thinking", "text": told.pop(), "closed": True}, *chunks]
    return {
        "role": role, "content_kind": kind, "chunks": chunks, "tool_calls": None if calls is None or role != "assistant" else [_call_in(c) for c in calls],
        "prefix": bool(m.get("prefix", False)), "weight": m.get("weight"), "tool_call_id": m.get("tool_call_id") if role == "tool" else None, "name": m.get("name") if role == "tool" else None,
    }


def message_out(m: dict, thinking: str = "thinking_chunks") -> dict:
    out: dict = {"role": m["role"]}
    if m["tool_calls"] is not None:
        out["tool_calls"] = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in m["tool_calls"]]
    out |= {k: m[k] for k in ("tool_call_id", "name") if m[k] is not None}
    if m["content_kind"] == "null":
        return out
    if m["content_kind"] == "str":
        return out | {"content": m["chunks"][0]["text"]}
    chunks = m["chunks"]
    n = sum(c["type"] == "thinking" for c in chunks) if m["role"] == "assistant" else 0
    if any(c["type"] == "thinking" for c in chunks[n:]) and m["role"] == "assistant":
        raise Refused("thinking must come first")
    if thinking == "thinking_chunks" or m["role"] != "assistant":
        return out | {"content": [chunk_out(c) for c in chunks]}
    if n:
        out[thinking] = "\n".join(c["text"] for c in chunks[:n])
    rest = chunks[n:]
    if len(rest) == 1:
        out["content"] = rest[0]["text"]
    elif rest:
        out["content"] = [chunk_out(c) for c in rest]
    return out


def tool_in(t: dict) -> dict:
    f = t["function"]
    return {"name": f["name"], "description": f.get("description") or "", "parameters": json.dumps(f.get("parameters") or {}, ensure_ascii=False), "strict": bool(f.get("strict", False))}


def tool_out(t: dict) -> dict:
    return {"type": "function", "function": {"name": t["name"], "description": t["description"], "parameters": json.loads(t["parameters"] or "{}"), "strict": bool(t["strict"])}}


def request_in(conv_id: int | None, text: str | None) -> dict:
    try:
        r = json.loads(text or "")
        if not isinstance(r, dict) or not isinstance(r.get("messages"), list):
            raise Refused("a request has a list of messages")
        if "seed" in r and "random_seed" in r:
            raise Refused("seed and random_seed exclude each other")
        choice = r.get("tool_choice", "auto")
        form = r.get("response_format") or {"type": "text"}
        return {
            "conv_id": conv_id, "model": r.get("model"), "messages": [message_in(m) for m in r["messages"]],
            "tools": None if r.get("tools") is None else [tool_in(t) for t in r["tools"]],
            "tool_choice": "named" if isinstance(choice, dict) else choice, "named_function": choice["function"]["name"] if isinstance(choice, dict) else None,
            "response_format": form.get("type"), "reasoning_effort": r.get("reasoning_effort"), "continue_final_message": bool(r.get("continue_final_message", False)),
            "truncate_for_context_length": bool(r.get("truncate_for_context_length", False)), "temperature": float(r.get("temperature", 0.7)), "top_p": float(r.get("top_p", 1.0)),
            "max_tokens": r.get("max_tokens"), "random_seed": r["seed"] if r.get("seed") is not None else r.get("random_seed"), "convert_error": None,
        }
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return {"conv_id": conv_id, "messages": [], "convert_error": {"code": "convert", "message": str(e)}}


def request_out(r: dict, thinking: str) -> tuple[str | None, str | None]:
    try:
        if r["truncate_for_context_length"]:
            raise Refused("truncation has no form in this API")
        out = {k: r[k] for k in ("temperature", "top_p", "max_tokens", "model", "reasoning_effort") if r[k] is not None}
        out |= {"response_format": {"type": r["response_format"] or "text"}, "continue_final_message": bool(r["continue_final_message"])}
        if r["random_seed"] is not None:
            out["seed"] = r["random_seed"]
        out["messages"] = [message_out(m, thinking) for m in r["messages"]]
        if r["tools"] is not None:
            out["tools"] = [tool_out(t) for t in r["tools"]]
        choice = r["tool_choice"] or "auto"
        named = {"type": "function", "function": {"name": r["named_function"]}}
        return json.dumps(out | {"tool_choice": named if choice == "named" else "required" if choice in ("any", "required") else choice}, ensure_ascii=False), None
    except (ValueError, KeyError, TypeError) as e:
        return None, str(e)


def from_json(df: DataFrame, json_col: str = "request", id_col: str = "conv_id") -> DataFrame:
    """Request columns and `convert_error` (struct(code, message), null where all is well) from JSON text. Unknown fields
    are dropped."""
    fields = T._parse_datatype_string(schema.REQUEST + f", convert_error {schema.ERROR}")
    kind = fields.simpleString()
    arrow = _arrow_type(kind)  # here, as parsing a type needs the session

    @F.arrow_udf(kind)
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([request_in(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], arrow)

    return df.select(run.asNondeterministic()(F.col(id_col).cast("bigint"), F.col(json_col)).alias("r")).select("r.*")


def to_json(requests: DataFrame, thinking: str = "thinking_chunks") -> DataFrame:
    """(conv_id, request, error) with requests as JSON text. Thinking is written as chunks or into one of two fields."""
    if thinking not in THINKING_FORMS:
        raise ValueError(f"thinking must be one of {THINKING_FORMS}")

    @F.arrow_udf("struct<request:string,error:string>")
    def run(a: pa.Array) -> pa.Array:
        rows = [request_out(r, thinking) for r in a.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["request", "error"])

    every = F.struct(*(F.col(f.name) for f in T._parse_datatype_string(schema.REQUEST).fields))
    return requests.select("conv_id", run.asNondeterministic()(every).alias("r")).select("conv_id", "r.*")


def random_ids() -> Column:
    """Random identifiers of 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def only(chunks: Column, kind: str) -> Column:
    """Whether all chunks are of one type."""
    return F.forall(chunks, lambda c: c["type"] == kind)


def transcription_from_json(json: Column) -> Column:
    """struct(audio, language, streaming, target_streaming_delay_ms, temperature, seed) of a transcription request."""
    kind = "struct<audio:string,language:string,streaming:string,target_streaming_delay_ms:double,temperature:double,seed:bigint,random_seed:bigint>"
    r = F.from_json(json, kind)
    return F.struct(
        F.try_to_binary(r["audio"], F.lit("base64")).alias("audio"), r["language"].alias("language"), F.coalesce(r["streaming"], F.lit("disabled")).alias("streaming"),
        r["target_streaming_delay_ms"].alias("target_streaming_delay_ms"), F.coalesce(r["temperature"], F.lit(0.7)).alias("temperature"), F.coalesce(r["seed"], r["random_seed"]).alias("seed"),
    )


def speech_from_json(json: Column) -> Column:
    """struct(input, voice, ref_audio) of a speech request; a voice is a name or an object with an id."""
    r = F.from_json(json, "struct<input:string,voice:string,ref_audio:string>")
    voice = F.coalesce(F.get_json_object(r["voice"], "$.id"), r["voice"])
    return F.struct(r["input"].alias("input"), voice.alias("voice"), F.try_to_binary(r["ref_audio"], F.lit("base64")).alias("ref_audio"))


def transcription_to_json(r: Column) -> Column:
    """JSON text of transcription_from_json()'s struct; null fields are left out."""
    audio = F.regexp_replace(F.base64(r["audio"]), "[\\r\\n]", "")
    return F.to_json(F.struct(audio.alias("audio"), *(r[n].alias(n) for n in ("language", "streaming", "target_streaming_delay_ms", "temperature", "seed"))))


def speech_to_json(r: Column) -> Column:
    """JSON text of speech_from_json()'s struct; null fields are left out."""
    audio = F.regexp_replace(F.base64(r["ref_audio"]), "[\\r\\n]", "")
    return F.to_json(F.struct(r["input"].alias("input"), r["voice"].alias("voice"), audio.alias("ref_audio")))
