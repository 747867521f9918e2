"""Encoding: segments to ids, truncation to a budget, and the finished sequence; also the forms without a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import indexes
from turnloom.functions.media import AudioConfig, image_run, padded_samples, speech_tokens, streaming_prefix
from turnloom.functions.media import audio_tokens as count_audio
from turnloom.functions.tokens import bpe_ids, byte_ids
from turnloom.sources.vocabulary import Vocabulary
from turnloom.special import SpecialTokens

_IDS = "array<int>"


def _special_id(name: Column, s: SpecialTokens) -> Column:
    table = F.create_map(*(F.lit(x) for pair in s.ranks.items() for x in pair))
    return F.try_element_at(table, name)


def _of_segment(seg: Column, text_ids: Column, s: SpecialTokens) -> Column:
    ranks = s.ranks
    image = image_run(seg["a"], seg["b"], *(ranks.get(t, -1) for t in ("[IMG]", "[IMG_BREAK]", "[IMG_END]")))
    audio = F.array_repeat(F.lit(ranks.get("[AUDIO]", -1)), seg["a"])
    return F.when(seg["kind"] == "tx", text_ids).when(seg["kind"] == "im", image).when(seg["kind"] == "au", audio).otherwise(F.array(_special_id(seg["val"], s)))


def message_ids(df: DataFrame, v: Vocabulary) -> DataFrame:
    """df with `message_ids`, array<array<int>>. A byte vocabulary stays in columns; others take one Arrow pass over all
    pieces of a conversation."""
    if len(v.words) == 256:
        one = lambda m: F.flatten(F.transform(m, lambda g: _of_segment(g, byte_ids(F.coalesce(g["val"], F.lit("")), v.n_special), v.special)))
        return df.withColumn("message_ids", F.transform("segments", one))
    flat = F.flatten("segments")
    df = df.withColumn("__ids", bpe_ids(F.transform(flat, lambda g: F.when(g["kind"] == "tx", g["val"])), v))
    df = df.withColumn("__at", F.transform(indexes(F.col("segments")), lambda i: F.aggregate(F.slice("segments", F.lit(1), i), F.lit(0), lambda a, m: a + F.size(m))))
    one = lambda m, i: F.flatten(F.transform(m, lambda g, j: _of_segment(g, F.get(F.col("__ids"), F.get(F.col("__at"), i) + j), v.special)))
    return df.withColumn("message_ids", F.transform("segments", one)).drop("__ids", "__at")


def kept_messages(roles: Column, counts: Column, budget: Column | int) -> Column:
    """struct(kept array<boolean>, over): which messages stay when ids must fit the budget, and what is left over it.

    Messages go from the front while too many ids are left; with a user message goes all that follows it up to the
    next; system messages and the last user message never go.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    last = F.coalesce(F.array_max(F.filter(indexes(roles), lambda i: F.get(roles, i) == "user")), F.lit(-1))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)
    start = F.struct((total - budget).alias("over"), F.lit(False).alias("group"), F.array().cast("array<boolean>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        user = x["role"] == "user"
        going = (s["group"] & ~user) | (s["over"] > 0)
        drop = going & (x["role"] != "system") & (x["i"] != last)
        group = (user & (s["over"] > 0)) | (s["group"] & ~user)
        return F.struct((s["over"] - F.when(drop, x["n"]).otherwise(0)).alias("over"), group.alias("group"), F.array_append(s["kept"], ~drop).alias("kept"))

    rows = F.transform(roles, lambda r, i: F.struct(r.alias("role"), F.get(counts, i).cast("bigint").alias("n"), i.alias("i")))
    return F.aggregate(rows, start, step, lambda s: F.struct(s["kept"].alias("kept"), F.greatest(s["over"], F.lit(0)).alias("over")))


def assemble(df: DataFrame, v: Vocabulary, budget: int | None = None) -> DataFrame:
    """df with `tokens`, `prefix_ids` (of a final assistant message), `kept`, and `truncate_error`.

    The budget doesn't count the first token. Media of dropped messages stay where they are, as only ids are dropped."""
    roles = F.transform("messages", lambda m: m["role"])
    if budget is None:
        df = df.withColumn("kept", F.transform("message_ids", lambda m: F.lit(True))).withColumn("truncate_error", F.lit(None).cast("struct<code:string,message:string>"))
    else:
        df = df.withColumn("__k", kept_messages(roles, F.transform("message_ids", F.size), budget))
        error = F.when(F.col("__k.over") > 0, F.struct(F.lit("encode").alias("code"), F.lit("the rest exceeds the budget").alias("message")))
        df = df.withColumn("kept", F.col("__k.kept")).withColumn("truncate_error", error).drop("__k")
    stay = F.filter("message_ids", lambda m, i: F.get(F.col("kept"), i))
    final = F.get(F.col("message_ids"), F.size("messages") - 1)
    is_assistant = F.get(F.col("messages"), F.size("messages") - 1)["role"] == "assistant"
    return df.withColumn("tokens", F.concat(F.array(F.lit(v.special.id("<s>"))), F.flatten(stay))).withColumn("prefix_ids", F.when(is_assistant, final))


def _ids(texts: Column, v: Vocabulary) -> Column:
    """array<array<int>> of array<string>."""
    return F.transform(texts, lambda t: byte_ids(F.coalesce(t, F.lit("")), v.n_special)) if len(v.words) == 256 else bpe_ids(texts, v)


def fill_in_middle(df: DataFrame, v: Vocabulary, prompt_col: str = "prompt", suffix_col: str = "suffix") -> DataFrame:
    """df with `tokens`: start, suffix, prompt, each behind its mark. The suffix is encoded behind a sign whose two ids
    are cut off; a vocabulary that spells the sign in more ids keeps the rest, as the format has it."""
    suffix = F.coalesce(suffix_col, F.lit(""))
    ids = _ids(F.array(F.concat(F.lit("☺"), suffix), F.coalesce(prompt_col, F.lit(""))), v)
    df = df.withColumn("__ids", ids)
    own = F.get(F.col("__ids"), F.lit(0))
    cut = F.when(F.length(suffix) > 0, F.slice(own, F.lit(3), F.greatest(F.size(own) - 2, F.lit(0)))).otherwise(F.array().cast(_IDS))
    s = v.special
    tokens = F.concat(F.array(F.lit(s.id("<s>")), F.lit(s.id("[SUFFIX]"))), cut, F.array(F.lit(s.id("[PREFIX]"))), F.get(F.col("__ids"), F.lit(1)))
    return df.withColumn("tokens", tokens).drop("__ids")


def transcription(df: DataFrame, v: Vocabulary, audio: AudioConfig, samples_col: str = "n_samples", language_col: str = "language") -> DataFrame:
    """df with `tokens` of a transcription request: the audio as a user message, the language, the mark."""
    s, repeat = v.special, lambda n: F.array_repeat(F.lit(v.special.id("[AUDIO]")), n)
    run = repeat(count_audio(padded_samples(F.col(samples_col), audio), audio))
    df = df.withColumn("__lang", F.get(_ids(F.array(F.concat(F.lit("lang:"), F.col(language_col))), v), F.lit(0)))
    lang = F.when(F.col(language_col).isNotNull(), F.col("__lang")).otherwise(F.array().cast(_IDS))
    head = F.array(*(F.lit(s.id(t)) for t in ("<s>", "[INST]", "[BEGIN_AUDIO]")))
    return df.withColumn("tokens", F.concat(head, run, F.array(F.lit(s.id("[/INST]"))), lang, F.array(F.lit(s.id("[TRANSCRIBE]"))))).drop("__lang")


def streaming_transcription(df: DataFrame, v: Vocabulary, audio: AudioConfig, delay_ms: float) -> DataFrame:
    """df with `tokens`: start and pads, the same for every request, and `padded_samples`."""
    tokens = F.concat(F.array(F.lit(v.special.id("<s>"))), streaming_prefix(audio, v.special.id("[STREAMING_PAD]"), delay_ms))
    return df.withColumn("tokens", tokens).withColumn("padded_samples", padded_samples(F.col("n_samples"), audio, delay_ms))


def speech(df: DataFrame, v: Vocabulary, audio: AudioConfig, text_col: str = "input") -> DataFrame:
    """df with `tokens` of a speech request from columns n_samples, sampling_rate (reference audio) or voice."""
    s = v.special
    n = speech_tokens(F.col("n_samples"), F.col("sampling_rate"), F.col("voice"), audio)
    df = df.withColumn("__ids", F.get(_ids(F.array(F.col(text_col)), v), F.lit(0)))
    tokens = F.concat(
        F.array(F.lit(s.id("<s>")), F.lit(s.id("[BEGIN_AUDIO]"))), F.array_repeat(F.lit(s.id("[AUDIO]")), n), F.array(F.lit(s.id("[NEXT_AUDIO_TEXT]"))),
        F.col("__ids"), F.array(F.lit(s.id("[REPEAT_AUDIO_TEXT]")), F.lit(s.id("[BEGIN_AUDIO]"))),
    )
    return df.withColumn("tokens", tokens).drop("__ids")


