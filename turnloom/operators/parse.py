"""Parsing: generated ids back to an assistant message."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import indexes, let, split_by_value, when
from turnloom.functions.tokens import decoded
from turnloom.sources.vocabulary import Vocabulary
from turnloom.versions import Version

_PARTS = "array<array<int>>"
_SPANS = "array<struct<ids:array<int>,think:boolean>>"


def split_once(ids: Column, mark: int) -> Column:
    """struct(before, after, error): the ids around a mark that must stand there exactly once."""
    n = F.size(F.filter(ids, lambda x: x == mark))
    at = F.array_position(ids, mark).cast("int")
    none = F.lit(None).cast("array<int>")
    return F.struct(
        F.when(n == 1, F.slice(ids, F.lit(1), at - 1)).otherwise(none).alias("before"),
        F.when(n == 1, F.slice(ids, at + 1, F.size(ids) - at)).otherwise(none).alias("after"),
        F.when(n != 1, F.lit("the mark must stand there exactly once")).alias("error"),
    )


def content_and_calls(ids: Column, call_mark: int) -> Column:
    """struct(content, calls): what stands before the first call mark, and the parts that begin with one."""

    def parted(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        told = F.get(first, F.lit(0)) != call_mark
        rest = F.when(told, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.struct(F.when(told, first).otherwise(F.array().cast("array<int>")).alias("content"), F.coalesce(rest, F.array().cast(_PARTS)).alias("calls"))

    return let(split_by_value(ids, F.lit(call_mark)), parted)


def think_spans(ids: Column, begin: int, end: int) -> Column:
    """struct(spans, error): ids in and outside thinking marks. Marks belong to the span; an open one stays a think span;
    marks in the wrong place are an error. Spans are cut at the marks' places, so long lists cost no more than reading."""

    def cut(ids: Column) -> Column:
        at = lambda i: F.get(ids, i)
        marks = F.filter(indexes(ids), lambda i: at(i).isin(begin, end))
        wrong = lambda m: F.filter(indexes(m), lambda k: F.when(at(F.get(m, k)) == begin, (k > 0) & (at(F.get(m, k - 1)) == begin)).otherwise((k == 0) | (at(F.get(m, k - 1)) == end)))
        error = let(marks, lambda m: let(F.get(wrong(m), F.lit(0)), lambda k: F.when(k.isNotNull(), F.when(
            at(F.get(m, k)) == begin, F.lit("thinking begins inside thinking")).otherwise(F.lit("thinking ends outside thinking")))))
        heads = F.transform(marks, lambda i: F.when(at(i) == begin, i).otherwise(i + 1))
        starts = F.array_distinct(F.array_sort(F.filter(F.concat(F.array(F.lit(0)), heads), lambda i: i < F.size(ids))))
        span = lambda st: F.transform(st, lambda s, k: let(F.slice(ids, s + 1, F.coalesce(F.get(st, k + 1), F.size(ids)) - s), lambda x: F.struct(x.alias("ids"), (F.get(x, F.lit(0)) == begin).alias("think"))))
        return F.struct(let(starts, span).alias("spans"), error.alias("error"))

    return let(ids, cut)


def _one_call(ids: list[int], v: Version, vocabulary: Vocabulary) -> list[dict]:
    n, pieces = vocabulary.n_special, vocabulary.pieces()
    text = lambda xs: b"".join(pieces[x - n] for x in xs if x >= n).decode("utf-8", "replace")
    ranks = vocabulary.special.ranks
    if v.number <= 7:
        calls = json.loads(text(ids))
        if not isinstance(calls, list):
            raise ValueError("calls are a list")
        for c in calls:
            if not isinstance(c, dict) or not isinstance(c.get("arguments"), dict):
                raise ValueError("arguments are an object")
        return [{"id": c.get("id", "null"), "name": c["name"], "arguments": json.dumps(c["arguments"], ensure_ascii=False)} for c in calls]

    def parted(xs: list[int], mark: int | None) -> tuple[list[int], list[int]]:
        if xs.count(mark) != 1:
            raise ValueError("a mark must stand there exactly once")
        at = xs.index(mark)
        return xs[:at], xs[at + 1 :]

    id_ = "null"
    name, rest = ids, ids
    if v.number == 11 and ranks.get("[CALL_ID]") in ids:
        name, rest = parted(ids, ranks["[CALL_ID]"])
        own, args = parted(rest, ranks.get("[ARGS]"))
        id_ = text(own)
    else:
        name, args = parted(ids, ranks.get("[ARGS]"))
    return [{"id": id_, "name": text(name), "arguments": json.dumps(json.loads(text(args)), ensure_ascii=False)}]


def parsed_calls(parts: Column, v: Version, vocabulary: Vocabulary) -> Column:
    """struct(calls, error) of the parts that content_and_calls() gives. JSON needs Python."""
    kind = pa.struct([("calls", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))), ("error", pa.string())])

    @F.arrow_udf("struct<calls:array<struct<id:string,name:string,arguments:string>>,error:string>")
    def run(a: pa.Array) -> pa.Array:
        out: list[dict] = []
        for row in a.to_pylist():
            try:
                out.append({"calls": [c for p in row or [] for c in _one_call(p, v, vocabulary)], "error": None})
            except (ValueError, KeyError, TypeError) as e:
                out.append({"calls": None, "error": str(e)})
        return pa.array(out, kind)

    return run.asNondeterministic()(parts)


def assistant_messages(df: DataFrame, v: Version, vocabulary: Vocabulary, ids_col: str = "tokens") -> DataFrame:
    """df with `content` (array<struct(text, think, closed)>), `content_text` (where it is one text), `tool_calls`, `prefix`
    and `parse_error`."""
    ranks = vocabulary.special.ranks
    eos = vocabulary.special.id("</s>")
    ids = F.col(ids_col)
    marks = (ranks.get("[THINK]"), ranks.get("[/THINK]")) if v.think else (None, None)
    whole = F.struct(ids.alias("content"), F.array().cast(_PARTS).alias("calls"))
    df = df.withColumn("__parts", whole if v.number == 1 else content_and_calls(ids, vocabulary.special.id("[TOOL_CALLS]")))
    told = F.col("__parts.content")
    plain = F.struct(F.when(F.size(told) > 0, F.array(F.struct(told.alias("ids"), F.lit(False).alias("think")))).otherwise(F.array().cast(_SPANS)).alias("spans"), F.lit(None).cast("string").alias("error"))
    thinks = marks[0] is not None and marks[1] is not None
    df = df.withColumn("__spans", think_spans(told, *marks) if thinks else plain)
    spans = F.filter("__spans.spans", lambda s: ~((F.size(s["ids"]) == 1) & (F.get(s["ids"], F.lit(0)) == eos))) if thinks else F.col("__spans.spans")
    df = df.withColumn("__spans", F.struct(spans.alias("spans"), F.col("__spans.error").alias("error")))
    df = df.withColumn("__texts", _texts(F.transform("__spans.spans", lambda s: s["ids"]), vocabulary)).withColumn("__calls", parsed_calls(F.col("__parts.calls"), v, vocabulary))
    content = F.transform("__spans.spans", lambda s, i: F.struct(F.get(F.col("__texts"), i).alias("text"), s["think"].alias("think"), (F.get(s["ids"], F.size(s["ids"]) - 1) == F.lit(marks[1] if thinks else -1)).alias("closed")))
    error = F.coalesce(
        when(F.size(ids) == 0, "parse", "no ids"), when(F.col("__spans.error").isNotNull(), "parse", F.col("__spans.error")),
        when(F.col("__calls.error").isNotNull(), "parse", F.col("__calls.error")),
    )
    df = df.withColumn("content", content).withColumn("tool_calls", F.when(F.size("__parts.calls") > 0, F.col("__calls.calls")))
    one = (F.size("content") == 1) & ~F.get(F.col("content"), F.lit(0))["think"]
    df = df.withColumn("content_text", F.when(one, F.get(F.col("content"), F.lit(0))["text"])).withColumn("parse_error", error)
    return df.withColumn("prefix", F.get(ids, F.size(ids) - 1) != eos).drop("__parts", "__spans", "__texts", "__calls")


def _texts(parts: Column, vocabulary: Vocabulary) -> Column:
    """array<string> of array<array<int>>, special ids left out."""
    n, pieces = vocabulary.n_special, vocabulary.pieces()

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        rows = [None if row is None else [b"".join(pieces[x - n] for x in p if x >= n).decode("utf-8", "replace") for p in row] for row in a.to_pylist()]
        return pa.array(rows, pa.list_(pa.string()))

    return run.asNondeterministic()(parts)


__all__ = ["assistant_messages", "content_and_calls", "decoded", "parsed_calls", "split_once", "think_spans"]
