"""Registered queries over the engine's operators, each with SQL that computes the same from the same tables.

The test tables hold plain text conversations only, so several queries first derive, by arithmetic on ids, roles in any
order, calls and results, and ids; the SQL derives them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import schema
from turnloom.functions import arrays, media, tokens
from turnloom.operators import convert, encode, grammar, normalize, parse, render, validate
from turnloom.plans.chat import Engine
from turnloom.sources import conversations as conv
from turnloom.sources import media as media_source
from turnloom.sources import vocabulary
from turnloom.special import SpecialTokens, speech_tokens
from turnloom.versions import VERSIONS, version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BYTES = vocabulary.Vocabulary()


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, none of them judged."""
    return conv.from_turns(_table(spark, sf_dir, "conversations")).withColumn("error", F.lit(None).cast(schema.ERROR))


# Derived conversations -----------------------------------------------------------------------------------------------


def _k() -> Column:
    return F.col("conv_id") * 7 + F.col("turn") * 5


_MIXED_SQL = "CASE (conv_id * 7 + turn * 5) % 6 WHEN 0 THEN 'user' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 3 THEN 'assistant' WHEN 4 THEN 'system' ELSE 'user' END"


def _mixed_role() -> Column:
    return F.when(_k() % 6 == 4, "system").when((_k() % 6).isin(2, 3), "assistant").otherwise("user")


#: Roles with tools: the first turn as it is, later ones by arithmetic; assistants call (turn % 3) tools.
_TOOLED_SQL = "CASE WHEN turn = 0 THEN role ELSE CASE (conv_id * 7 + turn * 5) % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' WHEN 3 THEN 'tool' ELSE 'assistant' END END"


def _tooled_role() -> Column:
    later = F.when(_k() % 5 == 0, "user").when((_k() % 5).isin(2, 3), "tool").otherwise("assistant")
    return F.when(F.col("turn") == 0, F.col("role")).otherwise(later)


_CALL_ID_SQL = "substr(md5((conv_id % 3)::VARCHAR || '-' || ({n})::VARCHAR), 1, 9)"


def _call_id(n: Column) -> Column:
    return F.substring(F.md5(F.concat((F.col("conv_id") % 3).cast("string"), F.lit("-"), n.cast("string"))), 1, 9)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("role", _mixed_role())
    return conv.from_turns(turns).withColumn("error", F.lit(None).cast(schema.ERROR))


def _tooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants at turn t call t % 3 tools, with ids by t and the call's place; results at turn t have the id of turn
    t - 1's call in place t % 2."""
    turns = _table(spark, sf_dir, "conversations").withColumn("role", _tooled_role())
    calls = F.transform(arrays.indexes(F.array_repeat(F.lit(0), (F.col("turn") % 3).cast("int"))), lambda i: F.struct(
        _call_id(F.col("turn") * 2 + i).alias("id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments")))
    is_call = (F.col("role") == "assistant") & (F.col("turn") % 3 > 0)
    m = schema.message(
        role=F.col("role"), content_kind=F.when(is_call, "null").otherwise("str"),
        chunks=F.when(is_call, F.array().cast(f"array<{schema.CHUNK}>")).otherwise(F.array(schema.text_chunk(F.col("text")))),
        tool_calls=F.when(is_call, calls), tool_call_id=F.when(F.col("role") == "tool", _call_id((F.col("turn") - 1) * 2 + F.col("turn") % 2)),
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"))


def _flat(df: DataFrame) -> DataFrame:
    """(conv_id, idx, role, text) of nested messages."""
    rows = df.select("conv_id", F.posexplode("messages").alias("idx", "m"))
    return rows.select("conv_id", F.col("idx").cast("long").alias("idx"), "m.role", F.get(F.col("m.chunks"), F.lit(0))["text"].alias("text"))


_T = "conversations"
_MIX = f"(SELECT conv_id, turn, {_MIXED_SQL} AS role, text FROM conversations)"
_TOOL = f"(SELECT conv_id, turn, {_TOOLED_SQL} AS role, text FROM conversations)"


# Reading, grouping, normalization ------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversations_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    return r.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations")
def turns_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conv.to_turns(_requests(spark, sf_dir))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


_ISLANDS = f"""SELECT conv_id, turn, role, text, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM {_MIX})"""


@query(f"SELECT conv_id, (g - 1)::BIGINT AS island, any_value(role) AS role, count(*) AS n FROM ({_ISLANDS}) GROUP BY conv_id, g")
def role_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _mixed(spark, sf_dir).select("conv_id", F.posexplode(normalize.islands(F.col("messages"))).alias("island", "g"))
    return groups.select("conv_id", F.col("island").cast("long").alias("island"), F.get(F.col("g"), F.lit(0))["role"].alias("role"), F.size("g").cast("long").alias("n"))


_MERGED_V7 = f"""WITH i AS ({_ISLANDS}),
m AS (SELECT conv_id, g * 1000000 AS spot, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i WHERE role <> 'system' GROUP BY conv_id, g
      UNION ALL SELECT conv_id, g * 1000000 + turn, role, text FROM i WHERE role = 'system')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot) - 1 AS idx, role, text FROM m"""


@query(_MERGED_V7)
def merged_messages_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(normalize.normalize(_mixed(spark, sf_dir), version(7), json_text=False))


_MERGED_V3 = f"""WITH i AS ({_ISLANDS}),
m AS (SELECT conv_id, g, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i WHERE role <> 'system' GROUP BY conv_id, g),
f AS (SELECT c.conv_id, min_by(m.role, m.g) AS first FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id) GROUP BY c.conv_id),
u AS (SELECT conv_id, g, role, text FROM m UNION ALL SELECT conv_id, -1, 'user', '' FROM f WHERE first IS NULL OR first <> 'user')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS idx, role, text FROM u"""


@query(_MERGED_V3)
def merged_messages_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(normalize.normalize(_mixed(spark, sf_dir), version(3), json_text=False))


@query(f"SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS system_prompt FROM {_MIX} GROUP BY conv_id")
def system_prompt_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(_mixed(spark, sf_dir), version(3), json_text=False).select("conv_id", "system_prompt")


_WEIGHT_SQL = "CASE WHEN role = 'assistant' THEN (turn % 4) // 2 END"


@query(
    f"""WITH w AS (SELECT conv_id, turn, role, {_WEIGHT_SQL} AS weight FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations)),
n AS (SELECT *, CASE WHEN role = lag(role) OVER o AND weight IS NOT DISTINCT FROM lag(weight) OVER o THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM n)
SELECT conv_id, (g - 1)::BIGINT AS idx, any_value(role) AS role, any_value(weight)::DOUBLE AS weight, count(*) AS n FROM g GROUP BY conv_id, g"""
)
def weight_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("turn") % 5 == 0, "user").otherwise("assistant")
    weight = F.when(role == "assistant", F.floor(F.col("turn") % 4 / 2).cast("double"))
    m = schema.message(role=role, content_kind=F.lit("str"), chunks=F.array(schema.text_chunk(F.col("text"))), weight=weight)
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))).alias("t"))
    groups = rows.select("conv_id", F.posexplode(normalize.islands(F.transform("t", lambda x: x["m"]))).alias("idx", "g"))
    first = F.get(F.col("g"), F.lit(0))
    return groups.select("conv_id", F.col("idx").cast("long").alias("idx"), first["role"].alias("role"), first["weight"].alias("weight"), F.size("g").cast("long").alias("n"))


@query(
    """WITH r AS (SELECT conv_id, turn, (turn * 7 + conv_id) % 5 AS id FROM conversations),
c AS (SELECT conv_id, [3, 1, (conv_id % 5), 0] AS called FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, turn, id, coalesce(list_last(list_filter([1, 2, 3, 4], lambda i: called[i] = id)), 1000) AS call, max(turn) OVER (PARTITION BY conv_id, id) AS last FROM r JOIN c USING (conv_id))
SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY call, last, turn) AS ids, string_agg(turn::VARCHAR, ',' ORDER BY call, last, turn) AS places FROM k GROUP BY conv_id"""
)
def ordered_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    m = schema.message(role=F.lit("tool"), content_kind=F.lit("str"), chunks=F.array(schema.text_chunk(F.col("turn").cast("string"))), tool_call_id=((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("string"))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))).alias("t"))
    called = F.array(F.lit("3"), F.lit("1"), (F.col("conv_id") % 5).cast("string"), F.lit("0"))
    done = rows.select("conv_id", normalize.ordered_results(F.transform("t", lambda x: x["m"]), called).alias("m"))
    return done.select("conv_id", F.array_join(F.transform("m", lambda m: m["tool_call_id"]), ",").alias("ids"), F.array_join(F.transform("m", lambda m: F.get(m["chunks"], F.lit(0))["text"]), ",").alias("places"))


@query(
    """SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN 'high' WHEN conv_id % 4 = 2 THEN 'none' ELSE 'odd' END AS effort,
CASE WHEN conv_id % 4 = 3 THEN 'request' END AS code FROM conversations GROUP BY conv_id"""
)
def model_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("conv_id") % 4 == 1, "high").when(F.col("conv_id") % 4 == 2, "none").when(F.col("conv_id") % 4 == 3, "odd")
    r = _requests(spark, sf_dir).withColumn("s", normalize.built_settings(asked, version(15)))
    return r.select("conv_id", "s.effort", F.col("s.error.code").alias("code"))


# Validation ----------------------------------------------------------------------------------------------------------


def _codes(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    r = _mixed(spark, sf_dir).drop("error").withColumn("model", F.lit("m"))
    return validate.validate(r, version(7), mode).select("conv_id", "error.code", "error.message")


_BAD_PAIR = """bad AS (SELECT conv_id, min_by('role ' || role || ' may not follow role ' || before, turn) AS pair FROM (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m) WHERE (before IN ('system', 'user') AND role NOT IN ('user', 'assistant', 'system')) OR (before IN ('assistant', 'tool') AND role NOT IN ('assistant', 'user', 'tool')) GROUP BY conv_id)"""


def _first_error_sql(last: str) -> str:
    return f"""WITH m AS {_MIX}, {_BAD_PAIR},
s AS (SELECT conv_id, count(*) AS n, max_by(role, turn) AS last, any_value(role) AS one FROM m GROUP BY conv_id),
e AS (SELECT s.conv_id, CASE WHEN n = 1 AND one NOT IN ('user', 'system') THEN 'a conversation begins with the user''s or a system message' {last} ELSE pair END AS message FROM s LEFT JOIN bad USING (conv_id))
SELECT conv_id, CASE WHEN message IS NOT NULL THEN 'structure' END AS code, message FROM e"""


_OPEN = "WHEN n > 1 AND last = 'assistant' THEN 'the last message must be the user''s or a tool''s, or one of the assistant to go on with'"


@query(_first_error_sql(_OPEN))
def first_error_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir, "serving")


@query(_first_error_sql(_OPEN))
def first_error_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir, "test")


@query(_first_error_sql("WHEN last <> 'assistant' THEN 'the last message must be the assistant''s, not of role ' || last"))
def first_error_finetuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir, "finetuning")


@query(f"WITH m AS {_TOOL}, {_BAD_PAIR} SELECT c.conv_id, pair FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN bad USING (conv_id)")
def role_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tooled(spark, sf_dir).select("conv_id", validate.order_error(F.col("messages"))["message"].alias("pair"))


def _pairing_sql(final: str) -> str:
    return f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM {_TOOL}),
g AS (SELECT *, sum(CASE WHEN role = 'assistant' AND idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS g FROM m),
a AS (SELECT conv_id, g, sum(CASE WHEN role = 'assistant' AND idx > 0 THEN turn % 3 ELSE 0 END) - sum(CASE WHEN role = 'tool' AND idx > 0 THEN 1 ELSE 0 END) AS open, max(g) OVER (PARTITION BY conv_id) AS last FROM g GROUP BY conv_id, g)
SELECT conv_id, bool_or(CASE WHEN g < last THEN open <> 0 ELSE {final} END) AS broken FROM a GROUP BY conv_id"""


def _pairing(spark: SparkSession, sf_dir: str, mode: str, by_id: bool) -> DataFrame:
    return _tooled(spark, sf_dir).select("conv_id", validate.pairing_error(F.col("messages"), mode, by_id).isNotNull().alias("broken"))


@query(_pairing_sql("open <> 0"))
def pairing_count_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairing(spark, sf_dir, "serving", False)


@query(_pairing_sql("open < 0"))
def pairing_count_finetuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairing(spark, sf_dir, "finetuning", False)


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM {_TOOL}),
g AS (SELECT *, sum(CASE WHEN role = 'assistant' AND idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS g FROM m WHERE idx > 0),
c AS (SELECT conv_id, g, {_CALL_ID_SQL.format(n="turn * 2 + i")} AS id FROM (SELECT conv_id, g, turn, unnest(range(turn % 3)) AS i FROM g WHERE role = 'assistant')),
r AS (SELECT conv_id, g, turn, {_CALL_ID_SQL.format(n="(turn - 1) * 2 + turn % 2")} AS id FROM g WHERE role = 'tool'),
x AS (SELECT conv_id, true AS bad FROM r LEFT JOIN c USING (conv_id, g, id) WHERE c.id IS NULL
      UNION ALL SELECT conv_id, true FROM r GROUP BY conv_id, g, id HAVING count(*) > 1
      UNION ALL SELECT conv_id, true FROM c GROUP BY conv_id, g, id HAVING count(*) > 1
      UNION ALL SELECT conv_id, true FROM (SELECT conv_id, g, sum(k) AS k FROM (SELECT conv_id, g, 1 AS k FROM c UNION ALL SELECT conv_id, g, -1 FROM r) GROUP BY conv_id, g) WHERE k <> 0)
SELECT v.conv_id, count(x.bad) > 0 AS broken FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN x USING (conv_id) GROUP BY v.conv_id"""
)
def pairing_ids_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairing(spark, sf_dir, "serving", True)


@query("SELECT p_partkey AS id, NOT regexp_full_match(replace(p_name, 'a', ' '), '[a-zA-Z0-9_-]{1,64}\\n?') AS broken FROM part")
def function_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (~F.translate("p_name", "a", " ").rlike(validate.NAME)).alias("broken"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND NOT regexp_full_match(substr(md5(text), 1, 9 + turn % 2), '[a-zA-Z0-9]{9}\\n?') THEN 'not a call id: ' || substr(md5(text), 1, 9 + turn % 2)
WHEN turn % 3 = 1 THEN 'a call needs an id' WHEN turn % 3 = 0 OR regexp_full_match(substr(md5(text), 1, 9), '[a-zA-Z0-9]{9}') THEN NULL END AS message FROM conversations"""
)
def tool_call_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    odd = F.substr(F.md5("text"), F.lit(1), (9 + F.col("turn") % 2).cast("int"))
    id_ = F.when(F.col("turn") % 3 == 0, odd).when(F.col("turn") % 3 == 1, "null").otherwise(F.substring(F.md5("text"), 1, 9))
    call = F.struct(id_.alias("id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"))
    return t.select("conv_id", "turn", validate.call_error(call, "serving", F.lit(True), version(7))["message"].alias("message"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 12 > 1 THEN 'temperature is out of range' WHEN l_tax * 13 > 1 THEN 'top_p is out of range' WHEN l_quantity < 5 THEN 'max_tokens is out of range' END AS message FROM lineitem")
def sampling_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    df = t.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("temperature"), (F.col("l_tax") * 13).alias("top_p"), (F.col("l_quantity") - 5).cast("bigint").alias("max_tokens"), F.lit(1).alias("random_seed"))
    return df.select("l_orderkey", "l_linenumber", validate.ranges_error(df)["message"].alias("message"))


@query(
    """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'user messages can''t hold image, input_audio' WHEN conv_id % 3 = 1 THEN 'user messages can''t hold audio_url' END AS v3,
CASE WHEN conv_id % 3 = 0 THEN 'system prompts at 0 and audio at 1' WHEN conv_id % 3 = 1 THEN 'system prompts at 0 and audio at 1' END AS v7 FROM conversations GROUP BY conv_id"""
)
def chunk_kinds_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: schema.chunk(type=F.lit(k), text=F.lit("x"))
    chunks = F.when(F.col("conv_id") % 3 == 0, F.array(c("input_audio"), c("text"), c("image"), c("image"))).when(F.col("conv_id") % 3 == 1, F.array(c("audio_url"), c("text"))).otherwise(F.array(c("text")))
    user = schema.message(role=F.lit("user"), content_kind=F.lit("list"), chunks=chunks)
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    r = ids.withColumn("messages", F.array(schema.text_message(F.lit("system"), F.lit("s")), user))
    v2 = validate.chunks_error(F.get(F.col("messages"), F.lit(1)), version(2), "user")["message"]
    v3 = validate.chunks_error(F.get(F.col("messages"), F.lit(1)), version(3), "user")["message"]
    return r.select("conv_id", F.when(F.col("conv_id") % 3 == 0, v2).otherwise(v3).alias("v3"), validate.system_audio_error(F.col("messages"))["message"].alias("v7"))


# Rendering and encoding ----------------------------------------------------------------------------------------------


def _prompts(spark: SparkSession, sf_dir: str, v: int, **more: Column) -> DataFrame:
    r = _requests(spark, sf_dir)
    for name, value in more.items():
        r = r.withColumn(name, value)
    return Engine.of(v, json_text="tools" in more).rendered(r).select("conv_id", "prompt")


_V7_TURN = "CASE role WHEN 'system' THEN '[SYSTEM_PROMPT]' || text || '[/SYSTEM_PROMPT]' WHEN 'user' THEN '[INST]' || text || '[/INST]' ELSE rtrim(text, ' ') || '</s>' END"


@query(f"SELECT conv_id, '<s>' || string_agg({_V7_TURN}, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 7)


def _prompt_old_sql(where: str, turn: str) -> str:
    return f"""WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS prompt, {where}(turn) FILTER (WHERE role = 'user') AS spot FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, turn, role, CASE WHEN turn = spot AND coalesce(prompt, '') <> '' THEN prompt || chr(10) || chr(10) || text ELSE text END AS text FROM conversations JOIN s USING (conv_id) WHERE role <> 'system')
SELECT conv_id, '<s>' || string_agg({turn}, '' ORDER BY turn) AS prompt FROM u GROUP BY conv_id"""


@query(_prompt_old_sql("min", "CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' ELSE text || '</s>' END"))
def prompt_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 1)


@query(_prompt_old_sql("max", "CASE role WHEN 'user' THEN '[INST]' || text || '[/INST]' ELSE rtrim(text, ' ') || '</s>' END"))
def prompt_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 2)


@query(_prompt_old_sql("max", "CASE role WHEN 'user' THEN '[INST]' || text || '[/INST]' ELSE rtrim(text, ' ') || '</s>' END"))
def prompt_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 3)


_TOOL_TEXT = '[{"type": "function", "function": {"name": "look_up", "description": "", "parameters": {"type": "object"}}}]'


def _with_tools_sql(where: str, more: str = "''") -> str:
    return f"""WITH s AS (SELECT conv_id, {where}(turn) FILTER (WHERE role = 'user') AS spot FROM conversations GROUP BY conv_id)
SELECT conv_id, '<s>' || string_agg(CASE WHEN turn = spot THEN '[AVAILABLE_TOOLS]{_TOOL_TEXT}[/AVAILABLE_TOOLS]' || {more} ELSE '' END || {_V7_TURN}, '' ORDER BY turn) AS prompt FROM conversations JOIN s USING (conv_id) GROUP BY conv_id"""


def _tools() -> Column:
    return F.array(F.struct(F.lit("look_up").alias("name"), F.lit("").alias("description"), F.lit('{"type": "object"}').alias("parameters"), F.lit(False).alias("strict")))


@query(_with_tools_sql("max"))
def prompt_v7_tools_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 7, tools=_tools())


@query(_with_tools_sql("min"))
def prompt_v13_tools_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 13, tools=_tools())


@query(_with_tools_sql("min", "CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '[MODEL_SETTINGS]{\"reasoning_effort\": \"high\"}[/MODEL_SETTINGS]' ELSE '[MODEL_SETTINGS]{\"reasoning_effort\": \"none\"}[/MODEL_SETTINGS]' END"))
def prompt_v15_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    effort = F.when(F.col("conv_id") % 3 == 1, "high").when(F.col("conv_id") % 3 == 2, "none")
    return _prompts(spark, sf_dir, 15, tools=_tools(), reasoning_effort=effort)


@query(
    f"""SELECT conv_id, '<s>' || string_agg(CASE WHEN role = 'assistant' AND turn = last THEN rtrim(text, ' ') ELSE {_V7_TURN} END, '' ORDER BY turn) AS prompt
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id"""
)
def prompt_v7_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, 7, continue_final_message=F.get(F.col("messages"), F.size("messages") - 1)["role"] == "assistant")


@query("SELECT conv_id, coalesce(min(i) FILTER (WHERE role = 'user'), -1) AS first_user, coalesce(max(i) FILTER (WHERE role = 'user'), -1) AS last_user FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
def first_last_user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, z = render.first_last_user(F.col("messages"))
    return _requests(spark, sf_dir).select("conv_id", a.cast("long").alias("first_user"), z.cast("long").alias("last_user"))


_N_TURN = "octet_length(encode(CASE WHEN role = 'assistant' THEN rtrim(text, ' ') ELSE text END)) + CASE WHEN role = 'assistant' THEN 1 ELSE 2 END"


def _encoded(spark: SparkSession, sf_dir: str, v: int, budget: int | None = None, words: vocabulary.Vocabulary = _BYTES) -> DataFrame:
    return Engine.of(v, json_text=False, max_input_tokens=budget, vocabulary=words).encoded(_requests(spark, sf_dir))


@query(f"SELECT conv_id, 1 + sum({_N_TURN})::BIGINT AS n_tokens, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 2 END)::BIGINT + 1 AS n_special FROM conversations GROUP BY conv_id")
def token_counts_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, 7)
    return e.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t < _BYTES.n_special)).cast("long").alias("n_special"))


_BYTE_AT = "('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INTEGER"


@query(f"SELECT doc_id, count(*) AS n, sum(t)::BIGINT AS total, sum(t * (i % 97 + 1))::BIGINT AS weighted FROM (SELECT doc_id, i, {_BYTE_AT} + 100 AS t FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY doc_id")
def byte_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the ids' number, sum and sum weighted by place, which tell lists of ids apart."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", tokens.byte_ids(F.col("text"), _BYTES.n_special).alias("ids")).filter(F.size("ids") > 0)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n"), add(F.col("ids")).alias("total"), add(F.transform("ids", lambda x, i: x * (i % 97 + 1))).alias("weighted"))


@query(f"SELECT conv_id, role, sum({_N_TURN})::BIGINT AS n_tokens FROM conversations GROUP BY conv_id, role")
def token_counts_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, 7).select("conv_id", F.explode(F.arrays_zip("messages", "message_ids")).alias("x"))
    return e.groupBy("conv_id", F.col("x.messages.role").alias("role")).agg(F.sum(F.size("x.message_ids")).cast("long").alias("n_tokens"))


@query(f"SELECT conv_id, CASE WHEN max_by(role, turn) = 'assistant' THEN max_by({_N_TURN}, turn) END AS n_prefix FROM conversations GROUP BY conv_id")
def prefix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, 7).select("conv_id", F.when(F.col("prefix_ids").isNotNull(), F.size("prefix_ids")).cast("long").alias("n_prefix"))


def _truncated_sql(budget: int) -> str:
    return f"""WITH RECURSIVE m AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {_N_TURN} AS n FROM conversations),
t AS (SELECT conv_id, sum(n) - {budget} AS over0, coalesce(max(i) FILTER (WHERE role = 'user'), -1) AS last FROM m GROUP BY conv_id),
x AS (SELECT m.*, over0, last FROM m JOIN t USING (conv_id)),
f AS (SELECT conv_id, -1::BIGINT AS i, over0 AS over, false AS grp, false AS dropped, 0::BIGINT AS n FROM t
  UNION ALL
  SELECT x.conv_id, x.i, CASE WHEN ((f.grp AND x.role <> 'user') OR f.over > 0) AND x.role <> 'system' AND x.i <> x.last THEN f.over - x.n ELSE f.over END,
    (x.role = 'user' AND f.over > 0) OR (f.grp AND x.role <> 'user'), ((f.grp AND x.role <> 'user') OR f.over > 0) AND x.role <> 'system' AND x.i <> x.last, x.n
  FROM f JOIN x ON x.conv_id = f.conv_id AND x.i = f.i + 1)
SELECT conv_id, string_agg(CASE WHEN dropped THEN '0' ELSE '1' END, '' ORDER BY i) FILTER (WHERE i >= 0) AS kept, 1 + coalesce(sum(n) FILTER (WHERE NOT dropped AND i >= 0), 0)::BIGINT AS n_tokens,
  max_by(over, i) > 0 AS failed FROM f GROUP BY conv_id"""


def _truncated(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    e = _encoded(spark, sf_dir, 7, budget)
    kept = F.array_join(F.transform("kept", lambda k: F.when(k, "1").otherwise("0")), "")
    return e.select("conv_id", kept.alias("kept"), F.size("tokens").cast("long").alias("n_tokens"), F.col("truncate_error").isNotNull().alias("failed"))


@query(_truncated_sql(1000))
def truncated_v7_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 1000)


@query(_truncated_sql(400))
def truncated_v7_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 400)


@query("SELECT doc_id, 3 + octet_length(encode(text)) + CASE WHEN lang = '' THEN 0 ELSE 1 + octet_length(encode(lang)) END AS n_tokens FROM documents")
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode.fill_in_middle(_table(spark, sf_dir, "documents"), _BYTES, "text", "lang")
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def merging_vocabulary() -> vocabulary.Vocabulary:
    """Bytes and a few merges, for tests of byte-pair encoding."""
    return vocabulary.Vocabulary(r"\s*\S+|\s+", tuple(bytes([i]) for i in range(256)) + (b"th", b"the", b" t", b"in", b"er", b"an", b"on"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = merging_vocabulary()
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.get(tokens.bpe_ids(F.array("text"), v), F.lit(0)).alias("ids"))
    return docs.select("doc_id", tokens.decoded(F.col("ids"), v).alias("d")).select("doc_id", F.sha2("d.text", 256).alias("text_hash"))


def _times(x: str) -> str:
    return f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}"


# merges apply by rank: 'th' before ' t', and 'the' takes its 'e' before 'er' can
@query(f"SELECT doc_id, octet_length(encode(text)) - {_times('th')} - {_times('the')} - ({_times(' t')} - {_times(' th')}) - {_times('in')} - ({_times('er')} - {_times('ther')}) - {_times('an')} - {_times('on')} AS n_tokens FROM documents")
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = merging_vocabulary()
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(F.get(tokens.bpe_ids(F.array("text"), v), F.lit(0))).cast("long").alias("n_tokens"))


@query()
def tool_prompts_v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Engine.of(13).rendered(_tooled(spark, sf_dir).withColumn("error", F.lit(None).cast(schema.ERROR)))
    return done.select("conv_id", "prompt", F.col("encode_error.message").alias("message"))


# Parsing -------------------------------------------------------------------------------------------------------------

#: Token lists to parse: a text's bytes, folded to 0..12, so that marks are frequent.
_IDS_SQL = f"(SELECT doc_id, i, {_BYTE_AT} % 13 AS x FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents))"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(tokens.byte_ids(F.col("text"), 0), lambda x: x % 13)
    return _table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", own.alias("ids"))


@query(
    f"""SELECT doc_id, count(*) AS n_parts, max(n) AS longest, sum(first)::BIGINT AS firsts FROM (SELECT doc_id, g, count(*) AS n, min_by(x, i) AS first FROM (
SELECT *, sum(CASE WHEN x = 9 AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM {_IDS_SQL}) GROUP BY doc_id, g) GROUP BY doc_id"""
)
def split_by_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).select("doc_id", arrays.split_by_value(F.col("ids"), F.lit(9)).alias("p"))
    firsts = F.aggregate(F.transform("p", lambda p: F.get(p, F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.array_max(F.transform("p", F.size)).cast("long").alias("longest"), firsts.alias("firsts"))


@query(
    f"""SELECT doc_id, special, count(*) AS n_runs, sum(n)::BIGINT AS n_ids, max(n) AS longest FROM (SELECT doc_id, g, any_value(x < 4) AS special, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN (x < 4) = lag(x < 4) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM {_IDS_SQL})) GROUP BY doc_id, g) GROUP BY doc_id, special"""
)
def special_run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).select("doc_id", F.explode(tokens.special_runs(F.col("ids"), 4)).alias("r"))
    n = F.size("r.ids").cast("long")
    return rows.groupBy("doc_id", "r.special").agg(F.count("*").alias("n_runs"), F.sum(n).alias("n_ids"), F.max(n).alias("longest"))


@query(
    f"""WITH s AS (SELECT doc_id, count(*) FILTER (WHERE x = 5) AS n, min(i) FILTER (WHERE x = 5) AS spot, count(*) AS size FROM {_IDS_SQL} GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 1 THEN spot END AS before, CASE WHEN n = 1 THEN size - spot - 1 END AS after, CASE WHEN n <> 1 THEN 'the mark must stand there exactly once' END AS error FROM s"""
)
def single_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).select("doc_id", parse.split_once(F.col("ids"), 5).alias("s"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return rows.select("doc_id", size("s.before").alias("before"), size("s.after").alias("after"), "s.error")


@query(
    f"""SELECT doc_id, count(*) FILTER (WHERE g = 0 AND NOT (first = 9)) AS n_content, max(g) + CASE WHEN any_value(first) = 9 THEN 1 ELSE 0 END AS n_calls FROM (
SELECT *, sum(CASE WHEN x = 9 AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS g, first(x) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM {_IDS_SQL}) GROUP BY doc_id"""
)
def content_and_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).select("doc_id", parse.content_and_calls(F.col("ids"), 9).alias("s"))
    return rows.select("doc_id", F.size("s.content").cast("long").alias("n_content"), F.size("s.calls").cast("long").alias("n_calls"))


#: Lists with marks that mostly alternate: capitals begin, full stops end.
_SENTENCES_SQL = f"(SELECT doc_id, i, CASE WHEN b BETWEEN 65 AND 90 THEN 1 WHEN b = 46 THEN 2 ELSE 3 END AS x FROM (SELECT doc_id, i, {_BYTE_AT} AS b FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents)))"


@query(
    f"""WITH e AS (SELECT *, CASE x WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS d FROM {_SENTENCES_SQL}),
p AS (SELECT *, last(CASE WHEN d <> 0 THEN d END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
b AS (SELECT doc_id, bool_or((d = 1 AND before = 1) OR (d = -1 AND coalesce(before, -1) = -1)) AS broken FROM p GROUP BY doc_id),
g AS (SELECT p.doc_id, i, coalesce(before, -1) = 1 OR d = 1 AS think, sum(CASE WHEN d = 1 OR before = -1 AND lag_d = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY i) AS g
  FROM (SELECT *, lag(d) OVER (PARTITION BY doc_id ORDER BY i) AS lag_d FROM p) p JOIN b USING (doc_id) WHERE NOT broken)
SELECT doc_id, think, count(*) AS n_spans, sum(n)::BIGINT AS n_ids, max(n) AS longest FROM (SELECT doc_id, g, bool_or(think) AS think, count(*) AS n FROM g GROUP BY doc_id, g) GROUP BY doc_id, think"""
)
def think_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(tokens.byte_ids(F.col("text"), 0), lambda b: F.when(b.between(65, 90), 1).when(b == 46, 2).otherwise(3))
    docs = _table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", own.alias("ids"))
    rows = docs.select("doc_id", parse.think_spans(F.col("ids"), 1, 2).alias("s")).filter("s.error is null").select("doc_id", F.explode("s.spans").alias("x"))
    n = F.size("x.ids").cast("long")
    return rows.groupBy("doc_id", "x.think").agg(F.count("*").alias("n_spans"), F.sum(n).alias("n_ids"), F.max(n).alias("longest"))


@query("SELECT conv_id, turn, sha256(rtrim(text, ' ')) AS text_hash, false AS prefix FROM conversations WHERE role = 'assistant'")
def assistant_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, 13)
    rows = e.select("conv_id", F.posexplode(F.arrays_zip("messages", "message_ids")).alias("turn", "x")).filter("x.messages.role = 'assistant'")
    places = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("t")).withColumn("turn", (F.row_number().over(_by_turn()) - 1).cast("int"))
    rows = rows.select("conv_id", "turn", F.col("x.message_ids").alias("tokens")).join(places, ["conv_id", "turn"])
    done = Engine.of(13).messages(rows)
    return done.select("conv_id", F.col("t").alias("turn"), F.sha2("content_text", 256).alias("text_hash"), "prefix")


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("t")


@query(
    f"""WITH v AS (SELECT {_BYTE_AT} + 100 AS token_id FROM (SELECT text, unnest(range(octet_length(encode(text)))) AS i FROM benchmark))
SELECT token_id, count(*) AS n, lpad(upper(to_hex(token_id - 100)), 2, '0') AS piece FROM v GROUP BY token_id"""
)
def piece_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "benchmark").select(F.explode(tokens.byte_ids(F.col("text"), 100)).alias("token_id"))
    counts = ids.groupBy("token_id").agg(F.count("*").alias("n"))
    return tokens.with_pieces(counts, vocabulary.table(spark, _BYTES)).select("token_id", "n", F.hex("piece").alias("piece"))


# Media ---------------------------------------------------------------------------------------------------------------

_W, _H = "(l_partkey * 37 % 3000 + 1)", "(l_suppkey * 53 + l_linenumber * 411) % 2500 + 1"
_ROUND = "CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round(floor({x}) / 2.0 + 0.25) ELSE round({x}) END"


def _grid_sql() -> str:
    w = "CASE WHEN ratio > 1 THEN " + _ROUND.format(x="(w / ratio)") + " ELSE w END"
    h = "CASE WHEN ratio > 1 THEN " + _ROUND.format(x="(h / ratio)") + " ELSE h END"
    return f"""SELECT l_orderkey, l_linenumber, w, h, (floor((({w}) - 1) / 16) + 1)::INTEGER AS tokens_w, (floor((({h}) - 1) / 16) + 1)::INTEGER AS tokens_h FROM (
SELECT l_orderkey, l_linenumber, {_W} AS w, {_H} AS h, greatest({_W}, {_H})::DOUBLE / 1024 AS ratio FROM lineitem)"""


@query(_grid_sql())
def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_partkey") * 37 % 3000 + 1).withColumn("h", (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 411) % 2500 + 1)
    g = media.image_grid(F.col("w"), F.col("h"))
    return t.select("l_orderkey", "l_linenumber", "w", "h", g["w"].alias("tokens_w"), g["h"].alias("tokens_h"))


@query("SELECT p_partkey, ((p_size % 7 + 1) + 1) * (p_partkey % 5 + 1) AS n, 13 AS last, (p_partkey % 5 + 1) - 1 AS lines FROM part")
def image_token_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") % 7 + 1).cast("int"), (F.col("p_partkey") % 5 + 1).cast("int")
    rows = _table(spark, sf_dir, "part").select("p_partkey", media.image_run(w, h, 10, 12, 13).alias("r"))
    return rows.select("p_partkey", F.size("r").cast("long").alias("n"), F.get(F.col("r"), F.size("r") - 1).alias("last"), F.size(F.filter("r", lambda x: x == 12)).cast("long").alias("lines"))


_SAMPLES = "(event_id * 7919 % 500000)"


@query(f"SELECT event_id, ceil((CASE WHEN n % 160 <> 0 THEN ceil(n / 160.0 - 1) ELSE n // 160 END) / 12.0)::INTEGER AS n_tokens FROM (SELECT event_id, {_SAMPLES} AS n FROM events)")
def audio_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", media.audio_tokens(F.col("event_id") * 7919 % 500000).alias("n_tokens"))


@query(f"SELECT event_id, CASE event_type WHEN 'click' THEN 52 WHEN 'view' THEN 76 ELSE CASE WHEN user_id % 2 = 0 THEN (ceil({_SAMPLES} / 24000.0 * 12.5) + 1)::INTEGER END END AS n_tokens FROM events")
def speech_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = media.AudioConfig(voices={"click": 52, "view": 76})
    named = F.col("event_type").isin("click", "view")
    samples = F.when(~named & (F.col("user_id") % 2 == 0), F.col("event_id") * 7919 % 500000)
    return _table(spark, sf_dir, "events").select("event_id", media.speech_tokens(samples, F.lit(24000), F.col("event_type"), c).alias("n_tokens"))


@query(f"SELECT event_id, (ceil({_SAMPLES} / 1920.0) * 1920)::BIGINT + (32 + 6 + 1 + 10) * 1920 AS streaming, greatest({_SAMPLES}, 400) AS plain, (ceil({_SAMPLES} / 720000.0) * 720000)::BIGINT AS chunked FROM events")
def audio_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 7919 % 500000
    streaming, chunks = media.AudioConfig(streaming=True, delay_ms=480.0), media.AudioConfig(chunk_s=30.0)
    return _table(spark, sf_dir, "events").select("event_id", media.padded_samples(n, streaming).alias("streaming"), media.padded_samples(n, media.AudioConfig()).alias("plain"), media.padded_samples(n, chunks).alias("chunked"))


@query(
    """SELECT o_orderkey, round(CASE WHEN hz >= 1000 THEN 15.0 + ln(hz / 1000.0) * 27.0 / ln(6.4) ELSE hz * 3 / 200.0 END, 6) AS mel, round(hz, 6) AS back FROM (SELECT o_orderkey, o_totalprice / 30 AS hz FROM orders)"""
)
def mel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 30).alias("hz"))
    mel = media.hertz_to_mel(F.col("hz"))
    return t.select("o_orderkey", F.round(mel, 6).alias("mel"), F.round(media.mel_to_hertz(mel), 6).alias("back"))


@query(
    """WITH e AS (SELECT i, CASE WHEN m >= 15 THEN 1000.0 * exp((m - 15) * ln(6.4) / 27.0) ELSE m * 200.0 / 3 END AS hz FROM (SELECT i, i * (15.0 + ln(8.0) * 27.0 / ln(6.4)) / 81 AS m FROM range(82) r(i)))
SELECT f.i AS frequency, a.i AS mel, round(greatest(0.0, least((f.i * 40.0 - a.hz) / (b.hz - a.hz), (c.hz - f.i * 40.0) / (c.hz - b.hz))) * 2 / (c.hz - a.hz), 9) AS weight
FROM range(201) f(i), e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2"""
)
def mel_filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = media.mel_filters(spark, 201, 80, 0.0, 8000.0, 16000)
    return bank.select("frequency", F.col("mel").cast("long").alias("mel"), F.round("weight", 9).alias("weight"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'base64' WHEN page_id % 5 = 1 THEN 'file_uri' WHEN page_id % 5 = 2 THEN 'file' WHEN page_id % 5 = 3 THEN 'base64' ELSE 'url' END AS kind,
CASE WHEN page_id % 5 = 0 THEN md5(url) ELSE u END AS bare FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'data:audio/wav;base64,' || md5(url) WHEN 1 THEN 'file:///' || md5(url) WHEN 2 THEN '/' || md5(url) || '.wav' WHEN 3 THEN md5(url) ELSE 'https://' || md5(url) END AS u FROM pages)"""
)
def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = F.col("page_id") % 5, F.md5("url")
    u = F.when(k == 0, F.concat(F.lit("data:audio/wav;base64,"), h)).when(k == 1, F.concat(F.lit("file:///"), h)).when(k == 2, F.concat(F.lit("/"), h, F.lit(".wav"))).when(k == 3, h).otherwise(F.concat(F.lit("https://"), h))
    return _table(spark, sf_dir, "pages").select("page_id", media_source.url_kind(u).alias("kind"), media_source.without_prefix(u).alias("bare"))


@query("SELECT page_id, octet_length(encode(url)) AS n, CASE WHEN page_id % 2 = 0 THEN 'wav' END AS format FROM pages")
def inline_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = media_source.inline_bytes(media_source.data_url(F.encode("url", "UTF-8")))
    wav = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("RIFF").cast("binary"), F.lit("1234").cast("binary"), F.lit("WAVE").cast("binary"))).otherwise(F.lit("none").cast("binary"))
    return _table(spark, sf_dir, "pages").select("page_id", F.octet_length(data).cast("long").alias("n"), media_source.audio_format(wav).alias("format"))


@query(
    """SELECT vec_id, len(embedding) AS n, 16000 AS sampling_rate, NULL::VARCHAR AS error, 'wav' AS format,
round(list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 32767, 0))) / 32768)), 6) AS total FROM embeddings"""
)
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings").select("vec_id", media_source.wav_bytes(F.col("embedding"), F.lit(16000)).alias("wav"))
    back = t.select("vec_id", media_source.wav_samples(F.col("wav")).alias("w"), media_source.audio_format(F.col("wav")).alias("format"))
    total = F.round(F.aggregate("w.samples", F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("vec_id", F.size("w.samples").alias("n"), "w.sampling_rate", "w.error", "format", total.alias("total"))


# Conversion, text generators, JSON -----------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS content, NULL::VARCHAR AS code FROM conversations GROUP BY conv_id")
def api_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir).drop("error")
    none = {"model": "string", "tools": f"array<{schema.TOOL}>", "named_function": "string", "reasoning_effort": "string", "max_tokens": "bigint", "random_seed": "bigint"}
    for name, kind in none.items():
        r = r.withColumn(name, F.lit(None).cast(kind))
    r = r.withColumns({"tool_choice": F.lit("auto"), "response_format": F.lit("text"), "continue_final_message": F.lit(False), "truncate_for_context_length": F.lit(False), "temperature": F.lit(0.7), "top_p": F.lit(1.0)})
    back = convert.from_json(convert.to_json(r))
    content = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.get(m["chunks"], F.lit(0))["text"])), "|")
    return back.select("conv_id", F.size("messages").cast("long").alias("n_messages"), content.alias("content"), F.col("convert_error.code").alias("code"))


@query("SELECT p_partkey, 'start: body' || chr(10) || 'body: content? fcalls' || chr(10) || 'fcalls: (<[9]> SAFE_WS? \"' || p_type || '\" <[32]> SAFE_WS? %json {\"type\": \"object\", \"n\": ' || p_size || '} SAFE_WS?)+' || chr(10) || 'content: (/(.|\\n)+/)+' || chr(10) || 'SAFE_WS: /[ \\t\\r\\n]{1,8}/' || chr(10) AS grammar FROM part")
def tool_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SpecialTokens()
    tools = F.array(F.struct(F.col("p_type").alias("name"), F.lit("").alias("description"), F.concat(F.lit('{"type": "object", "n": '), F.col("p_size").cast("string"), F.lit("}")).alias("parameters"), F.lit(True).alias("strict")))
    calls = grammar.calls_rule(tools, F.lit("required"), F.lit(None).cast("string"), True, s)
    return _table(spark, sf_dir, "part").select("p_partkey", grammar.grammar("base", F.lit("required"), calls, F.lit(None).cast("string"), s).alias("grammar"))


@query("SELECT event_id, props AS normal, props AS dumped FROM events")
def json_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.functions.jsontext import forms

    t = _table(spark, sf_dir, "events").select("event_id", forms(F.array("props")).alias("f"))
    return t.select("event_id", F.get(F.col("f"), F.lit(0))["normal"].alias("normal"), F.get(F.col("f"), F.lit(0))["dumped"].alias("dumped"))


@query("SELECT v AS version, s AS size FROM (VALUES ('v1', 32000), ('v2', 32768), ('v3', 131072), ('v7', 131072), ('v11', 131072), ('v13', 131072), ('v15', 131072)) t(v, s)")
def nominal_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f"v{n}", max(v.vocabulary_sizes.values())) for n, v in VERSIONS.items()], "version string, size int")


@query("SELECT i::INTEGER AS id, CASE WHEN i < 20 THEN t[i + 1] ELSE coalesce(m[i], '<SPECIAL_' || i || '>') END AS name FROM range(100) r(i), (SELECT ['<unk>', '<s>', '</s>', '[INST]', '[/INST]', '[AVAILABLE_TOOLS]', '[/AVAILABLE_TOOLS]', '[TOOL_RESULTS]', '[/TOOL_RESULTS]', '[TOOL_CALLS]', '[IMG]', '<pad>', '[IMG_BREAK]', '[IMG_END]', '[PREFIX]', '[MIDDLE]', '[SUFFIX]', '[SYSTEM_PROMPT]', '[/SYSTEM_PROMPT]', '[TOOL_CONTENT]'] AS t, MAP {24: '[AUDIO]', 25: '[BEGIN_AUDIO]', 32: '[ARGS]', 33: '[CALL_ID]', 35: '[THINK]', 36: '[/THINK]', 37: '[MODEL_SETTINGS]', 38: '[/MODEL_SETTINGS]', 39: '[STREAMING_PAD]', 40: '[STREAMING_WORD]'} AS m)")
def special_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.table(spark, _BYTES).filter("special").select("id", F.col("text").alias("name"))


_PADDED = f"greatest({_SAMPLES}, 400)"  # at least a window
_AUDIO_N = f"ceil((CASE WHEN {_PADDED} % 160 <> 0 THEN ceil({_PADDED} / 160.0 - 1) ELSE {_PADDED} // 160 END) / 12.0)::INTEGER"
_EN = ",".join(str(b + 100) for b in b"lang:en")


@query(
    f"""SELECT event_id, 5 + n + CASE WHEN en THEN 7 ELSE 0 END AS n_tokens, md5('1,3,25' || repeat(',24', n) || ',4' || CASE WHEN en THEN ',{_EN}' ELSE '' END || ',34') AS hash
FROM (SELECT event_id, {_AUDIO_N} AS n, event_id % 2 = 0 AS en FROM events)"""
)
def transcription_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary.Vocabulary(special=speech_tokens())
    t = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 500000).alias("n_samples"), F.when(F.col("event_id") % 2 == 0, "en").alias("language"))
    return encode.transcription(t, v, media.AudioConfig()).select("event_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("hash"))


@query("SELECT conv_id, g AS chunk, count(*) AS n FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS g FROM conversations) GROUP BY conv_id, g")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).select("conv_id", F.posexplode(arrays.chunked(F.col("messages"), 3)).alias("chunk", "c"))
    return rows.select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"))


# Analytics over the engine's outputs -----------------------------------------------------------------------------------


@query(f"SELECT token_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {_BYTE_AT} + 100 AS token_id FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY token_id")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.byte_histogram(_table(spark, sf_dir, "documents"), "text", _BYTES.n_special)


@query("SELECT lang, source, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_tokens FROM documents GROUP BY ROLLUP (lang, source)")
def tokens_by_lang_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "source", F.octet_length("text").alias("n"))
    return docs.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))


@query(f"SELECT role, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS longest FROM (SELECT role, {_N_TURN} AS n FROM conversations) GROUP BY role")
def message_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, 7).select(F.explode(F.arrays_zip("messages", "message_ids")).alias("x"))
    n = e.select(F.col("x.messages.role").alias("role"), F.size("x.message_ids").cast("long").alias("n"))
    return n.groupBy("role").agg(F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").alias("longest"))


@query("SELECT quality, toxic, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS n_tokens FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def tokens_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("k"))
    return _table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("n_tokens"))


from turnloom import cases  # noqa: E402, F401  more queries, which register themselves above
