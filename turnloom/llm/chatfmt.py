"""Chat formatting of typed content parts, and reading it back. Column expressions only.

A message's parts are visited in order: text is escaped, images, audio and documents become placeholders with their
place among the conversation's attachments. Escaping doubles every backslash and puts one behind the first character
of each control string, so no control string of the template occurs in escaped text; a backslash and a tilde, which
stand for nothing, keep two texts apart that follow each other and could form one together. One pass undoes all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import let

START, END = "<s>", "</s>"
#: Marks around a turn by role; a role of another name stands in the generic mark.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", END)}
OTHER = ("[TURN]", "[/TURN]")
#: Placeholders of parts that aren't text.
KINDS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = [START, END, *(m for pair in (*MARKS.values(), OTHER) for m in pair if m != END), "[NAME]", *KINDS.values()]

PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "[]/<>\\" else c for c in s)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    rest = "|".join(_quoted(c[1:]) for c in CONTROL)
    return F.regexp_replace(doubled, f"([\\[<])(?={rest})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(?:~|(.))", "$1")


def tokens_of(part: Column, patch: int = 16, audio_rate: float = 12.5, page_tokens: int = 512) -> Column:
    """Tokens that a part's placeholder expands to: one for each image patch with a break a row, audio by its duration,
    documents by pages; null measures count as the least, one. Text expands to none here."""
    across = F.ceil(F.greatest(F.coalesce(part["width"], F.lit(1)), F.lit(1)) / patch)
    down = F.ceil(F.greatest(F.coalesce(part["height"], F.lit(1)), F.lit(1)) / patch)
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate), F.lit(1))
    pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens
    kind = part["type"]
    return F.when(kind == "image", (across + 1) * down).when(kind == "audio", audio).when(kind == "document", pages).otherwise(F.lit(0)).cast("long")


def visit(parts: Column) -> Column:
    """struct(body, attachments): the parts' text with placeholders, in order, and array<struct(type, ref, tokens)>.

    Null arrays count as none; null parts and null texts as empty text; parts of unknown type as text.
    """
    apart = lambda p, i: F.when((i > 0) & ~_attached(p) & ~_attached(F.get(parts, i - 1)), F.lit("\\~")).otherwise(F.lit(""))
    placed = F.transform(parts, lambda p, i: F.concat(apart(p, i), _placed(p)))
    kept = F.filter(parts, lambda p: p["type"].isin(*KINDS))
    attachments = F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    none = F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>")
    return F.struct(F.coalesce(F.concat_ws("", placed), F.lit("")).alias("body"), F.coalesce(attachments, none).alias("attachments"))


def _attached(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*KINDS), F.lit(False))


def _placed(p: Column) -> Column:
    out = None
    for kind, mark in KINDS.items():
        out = F.when(p["type"] == kind, F.lit(mark)) if out is None else out.when(p["type"] == kind, F.lit(mark))
    return out.otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def _turn(m: Column) -> Column:
    """A turn in its marks. Other roles write their name, escaped, before the body."""
    out = None
    for role, (a, z) in MARKS.items():
        text = F.concat(F.lit(a), m["body"], F.lit(z))
        out = F.when(m["role"] == role, text) if out is None else out.when(m["role"] == role, text)
    return out.otherwise(F.concat(F.lit(OTHER[0]), escape(F.coalesce(m["role"], F.lit(""))), F.lit("[NAME]"), m["body"], F.lit(OTHER[1])))


def text_parts(text: Column) -> Column:
    """One text part, as conversations without attachments have them."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return F.array(part)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: id, formatted, loss_spans (array<struct(start, end)> of assistant bodies in code points,
    end exclusive), attachments (in order, over all turns) and expanded_tokens (their tokens).

    Turns go by turn number; ties by role, then body; rows alike are a turn each; a null turn comes first. A null id is a
    conversation of its own; other columns play no part; no rows give none. A conversation is one row, so its length
    bounds a task's memory; texts of any length are escaped in one pass.
    """
    slim = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), visit(F.col(parts_col)).alias("v"))
    laid = slim.select("conv_id", "turn", "role", "v.body", "v.attachments", _turn(F.struct("role", "v.body")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("seq", F.row_number().over(order)).withColumn("at", F.coalesce(before, F.lit(0)) + len(START))
    grouped = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text", "at", "attachments"))).alias("m"))
    head, tail = (len(x) for x in MARKS["assistant"])
    learned = F.filter("m", lambda m: m["role"] == "assistant")
    span = lambda m: F.struct((m["at"] + head).alias("start"), (m["at"] + F.length(m["text"]) - tail).alias("end"))
    return grouped.select(
        "conv_id", F.concat(F.lit(START), F.concat_ws("", F.transform("m", lambda m: m["text"]))).alias("formatted"),
        F.transform(learned, span).alias("loss_spans"), F.flatten(F.transform("m", lambda m: m["attachments"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("m", lambda m: m["attachments"])), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def _read(formatted: Column, content: Callable[[Column], Column], name: str) -> Column:
    """array<struct(role, name)> of a formatted conversation, with content(escaped body) as what is called name."""
    closing = "|".join(_quoted(z) for _, z in (*MARKS.values(), OTHER))
    body = F.substring(formatted, len(START) + 1, 2**31 - 1 - len(START))
    pieces = F.filter(F.split(body, f"(?<={closing})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        out = None
        for role, (a, z) in MARKS.items():
            inner = F.struct(F.lit(role).alias("role"), content(F.substr(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(z))).alias(name))
            out = F.when(F.startswith(p, F.lit(a)), inner) if out is None else out.when(F.startswith(p, F.lit(a)), inner)
        inside = F.substr(p, F.lit(len(OTHER[0]) + 1), F.length(p) - len(OTHER[0]) - len(OTHER[1]))
        named = let(F.split(inside, "\\[NAME\\]", 2), lambda x: F.struct(unescape(x[0]).alias("role"), content(x[1]).alias(name)))
        return out.otherwise(named)

    return F.transform(pieces, turn)


def read_turns(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation. Placeholders stay in the text as their control strings; where
    texts may hold such strings themselves, read_parts() tells them apart."""
    return _read(formatted, unescape, "text")


def read_parts(formatted: Column) -> Column:
    """array<struct(role, parts)> of a formatted conversation, parts an array<struct(type, text)>: placeholders by their type,
    with null text, and the texts between them: those that follow each other have become one, and empty ones are gone."""
    marks = "|".join(_quoted(m) for m in KINDS.values())

    def part(piece: Column) -> Column:
        kind = F.coalesce(*(F.when(piece == m, F.lit(k)) for k, m in KINDS.items()))
        return F.struct(F.coalesce(kind, F.lit("text")).alias("type"), F.when(kind.isNull(), unescape(piece)).alias("text"))

    split = lambda body: F.filter(F.split(body, f"(?={marks})|(?<={marks})"), lambda x: x != "")
    told = lambda body: F.filter(F.transform(split(body), part), lambda p: p["text"].isNull() | (p["text"] != ""))
    return _read(formatted, told, "parts")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and loss mask give back."""
    turns = read_turns(F.col("formatted"))
    masked = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"), "expanded_tokens")
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens",
    )
