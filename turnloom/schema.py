"""Spark types of requests: one row per conversation, messages nested.

Content is text, a list of chunks, or absent, and the difference is visible downstream, so `content_kind` says which:
'str' (one text chunk), 'list' or 'null' (no chunks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = "struct<type:string,text:string,closed:boolean,url:string,detail:string,data:binary,width:int,height:int,n_samples:bigint,sampling_rate:int>"
CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = (
    f"struct<role:string,content_kind:string,chunks:array<{CHUNK}>,tool_calls:array<{CALL}>,prefix:boolean,weight:double,tool_call_id:string,name:string>"
)
TOOL = "struct<name:string,description:string,parameters:string,strict:boolean>"
REQUEST = (
    f"conv_id bigint, model string, messages array<{MESSAGE}>, tools array<{TOOL}>, tool_choice string, named_function string, response_format string, "
    "reasoning_effort string, continue_final_message boolean, truncate_for_context_length boolean, temperature double, top_p double, max_tokens bigint, random_seed bigint"
)
ERROR = "struct<code:string,message:string>"

_CHUNK_FIELDS = {"type": "string", "text": "string", "closed": "boolean", "url": "string", "detail": "string", "data": "binary", "width": "int", "height": "int", "n_samples": "bigint", "sampling_rate": "int"}
_MESSAGE_FIELDS = {"role": "string", "content_kind": "string", "chunks": f"array<{CHUNK}>", "tool_calls": f"array<{CALL}>", "prefix": "boolean", "weight": "double", "tool_call_id": "string", "name": "string"}


def _struct(kinds: dict[str, str], given: dict[str, Column]) -> Column:
    return F.struct(*((given[n] if n in given else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def chunk(**fields: Column) -> Column:
    return _struct(_CHUNK_FIELDS, fields)


def text_chunk(text: Column) -> Column:
    return chunk(type=F.lit("text"), text=text)


def message(**fields: Column) -> Column:
    return _struct(_MESSAGE_FIELDS, {"prefix": F.lit(False), **fields})


def with_fields(m: Column, **fields: Column) -> Column:
    """A message with some fields replaced."""
    return _struct(_MESSAGE_FIELDS, {n: m[n] for n in _MESSAGE_FIELDS} | fields)


def text_message(role: Column, text: Column) -> Column:
    """A message whose content is text; null text is absent content."""
    none = F.array().cast(f"array<{CHUNK}>")
    return message(
        role=role, content_kind=F.when(text.isNull(), F.lit("null")).otherwise(F.lit("str")),
        chunks=F.when(text.isNull(), none).otherwise(F.array(text_chunk(text))),
    )


def has_content(m: Column) -> Column:
    """Whether content counts as given: text that isn't empty, or a list with chunks."""
    return F.when(m["content_kind"] == "str", F.length(F.get(m["chunks"], F.lit(0))["text"]) > 0).otherwise(F.size(m["chunks"]) > 0)


def has_calls(m: Column) -> Column:
    return F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0
