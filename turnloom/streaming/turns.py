"""Conversations out of a stream of turns.

Requests that arrive whole need no state: Engine's methods take a streaming table as they take any other. Turns that
arrive one by one are gathered in a session window by conversation, given out when event time has passed the last turn
by `quiet`. State is a row a turn, merged by Spark, so each batch costs what it brings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import schema


def gathered(turns: DataFrame, quiet_ms: int, late: str = "1 minute", id_col: str = "conv_id", time_col: str = "ts") -> DataFrame:
    """(conv_id, n_turns, turns) for each conversation that has been quiet for quiet_ms of event time. Turns come with
    columns conv_id, turn, role, text and a timestamp; those later than the watermark are dropped, as the stream's
    contract has it. A turn after its conversation was given out begins a new one."""
    slim = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col(time_col).alias("ts"))
    quiet = F.session_window("ts", f"{quiet_ms} milliseconds")
    sessions = slim.withWatermark("ts", late).groupBy("conv_id", quiet).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return sessions.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns")


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages) from gathered()."""
    return conversations.select("conv_id", F.transform("turns", lambda t: schema.text_message(t["role"], t["text"])).alias("messages"))
