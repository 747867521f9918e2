"""Tables of conversations: by turn, by request, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import schema


def from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, messages) from one row per turn. The one shuffle of the engine; turns are in order of their number."""
    m = schema.text_message(F.col(role_col), F.col(text_col))
    grouped = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), m.alias("m")))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"))


def to_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): one row per message; the text of a list is that of its text chunks, joined."""
    rows = conversations.select("conv_id", F.posexplode("messages").alias("turn", "m"))
    text = F.array_join(F.transform(F.filter(F.col("m.chunks"), lambda c: c["type"] == "text"), lambda c: c["text"]), "")
    return rows.select("conv_id", "turn", "m.role", F.when(F.col("m.content_kind") != "null", text).alias("text"))
