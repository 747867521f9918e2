"""The registered queries of this package, and SQL for those that SQL expresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import chatfmt, classifier, lm, packing, pii, quality_rules, sentencepiece_ops, simhash, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ops.tokenised(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.found_in(_table(spark, sf_dir, "documents")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chatfmt.digests(chatfmt.format_conversations(turns.withColumn("parts", chatfmt.text_parts(F.col("text")))))


def _typed(turns: DataFrame) -> DataFrame:
    """turns with parts: the text, then pictures, recordings and documents on some turns, and texts that look like them."""
    part = lambda kind, when=None, **given: F.when(F.lit(True) if when is None else F.expr(when), F.struct(
        F.lit(kind).alias("type"), *(F.expr(given.get(c, "null")).cast(t).alias(c) for c, t in (("text", "string"), ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    parts = [
        part("text", text="text"), part("image", "turn % 2 = 0", ref="concat('i', conv_id, '-', turn)", width="1 + (conv_id * 37 + turn * 11) % 700", height="1 + (conv_id * 13 + turn * 29) % 500"),
        part("text", text="'[IMG] [IM'"), part("audio", "turn % 3 = 0", ref="concat('a', conv_id, '-', turn)", seconds="(conv_id + turn) % 400 / 8D"),
        part("document", "turn % 5 = 0", ref="concat('d', conv_id, '-', turn)", pages="1 + (conv_id + turn) % 7"), part("text", text="'G] end'"),
    ]
    return turns.select("conv_id", "turn", "role", F.filter(F.array(*parts), lambda p: p.isNotNull()).alias("parts"))


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visitor's work: placeholders, references, token counts, and what reading back tells of texts and attachments."""
    made = chatfmt.format_conversations(_typed(_table(spark, sf_dir, "conversations")))
    attached = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["type"], a["ref"], a["tokens"].cast("string"))), " ")
    read = F.flatten(F.transform(chatfmt.read_parts(F.col("formatted")), lambda t: t["parts"]))
    told = F.array_join(F.transform(read, lambda p: F.coalesce(p["text"], F.concat(F.lit("\x01"), p["type"], F.lit("\x01")))), "")
    return made.select("conv_id", attached.alias("attachments"), "expanded_tokens", F.length("formatted").cast("long").alias("formatted_chars"), F.sha2(told, 256).alias("parts_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classifier.train(docs, classifier.graded(_table(spark, sf_dir, "labels")))
    return classifier.scored(docs, model)


def queries() -> dict:
    return {f.__name__: f for f in (typed_parts, op1_quality_rules, op2_simhash_dedup, op3_exact_topk, op4_sentencepiece, op5_warc, op6_pii, op7_chat_format, op8_lm_score, op9_packing, op10_quality_classifier)}


_OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 20"""

_OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS d FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 5 * i + 1, 5))::INTEGER >> j) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

_OP7_TURNS = """(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"""


def _op7() -> str:
    # escaping adds a character to every backslash and every control string
    control = "|".join(re.escape(c) for c in chatfmt.CONTROL)
    size = f"length(replace(text, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(text, '{control}'))"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(z)}" for r, (a, z) in chatfmt.MARKS.items())
    return f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  ({len(chatfmt.START)} + sum({size} + CASE role {marks} END))::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens FROM {_OP7_TURNS} GROUP BY conv_id"""


def _typed_sql() -> str:
    control = "|".join(re.escape(c) for c in chatfmt.CONTROL)
    size = f"length(replace(text, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(text, '{control}'))"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(z)}" for r, (a, z) in chatfmt.MARKS.items())
    of = lambda kind, name: f"{name} IS NOT NULL THEN {len(chatfmt.KINDS[kind])}"
    # a text behind a text costs two signs; '[IMG] [IM' costs one for its control string
    return f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
  CASE WHEN turn % 2 = 0 THEN (ceil((1 + (conv_id * 37 + turn * 11) % 700) / 16.0) + 1) * ceil((1 + (conv_id * 13 + turn * 29) % 500) / 16.0) END::BIGINT AS i,
  CASE WHEN turn % 3 = 0 THEN greatest(ceil((conv_id + turn) % 400 / 8.0 * 12.5), 1) END::BIGINT AS a, CASE WHEN turn % 5 = 0 THEN 512 * (1 + (conv_id + turn) % 7) END::BIGINT AS d FROM conversations),
s AS (SELECT *, concat_ws(' ', 'image:i' || conv_id || '-' || turn || ':' || i, 'audio:a' || conv_id || '-' || turn || ':' || a, 'document:d' || conv_id || '-' || turn || ':' || d) AS attached,
  text || CASE WHEN i IS NOT NULL THEN chr(1) || 'image' || chr(1) ELSE '' END || '[IMG] [IM' || CASE WHEN a IS NOT NULL THEN chr(1) || 'audio' || chr(1) ELSE '' END || CASE WHEN d IS NOT NULL THEN chr(1) || 'document' || chr(1) ELSE '' END || 'G] end' AS told,
  {size} + 10 + 6 + CASE WHEN {of("image", "i")} ELSE 2 END + CASE WHEN {of("audio", "a")} ELSE 0 END + CASE WHEN {of("document", "d")} ELSE 0 END + CASE WHEN a IS NULL AND d IS NULL THEN 2 ELSE 0 END + CASE role {marks} END AS chars FROM t)
SELECT conv_id, coalesce(string_agg(attached, ' ' ORDER BY turn) FILTER (WHERE attached <> ''), '') AS attachments, sum(coalesce(i, 0) + coalesce(a, 0) + coalesce(d, 0))::BIGINT AS expanded_tokens,
  ({len(chatfmt.START)} + sum(chars))::BIGINT AS formatted_chars, sha256(string_agg(told, '' ORDER BY turn)) AS parts_sha256 FROM s GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"typed_parts": _typed_sql(), "op3_exact_topk": _OP3, "op5_warc": _OP5, "op7_chat_format": _op7()}
