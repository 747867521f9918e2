"""Requests to tokens and tokens to messages."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.media import AudioConfig, ImageConfig
from turnloom.operators import encode as enc
from turnloom.operators import normalize as nrm
from turnloom.operators import parse, render
from turnloom.operators.validate import validate
from turnloom.sources.vocabulary import Vocabulary
from turnloom.versions import Version, version


def image_config(words: Vocabulary) -> ImageConfig | None:
    if words.image is None:
        return None
    b = json.loads(words.image)
    return ImageConfig(b["image_patch_size"], b["max_image_size"], b.get("spatial_merge_size", 1))


def audio_config(words: Vocabulary) -> AudioConfig | None:
    if words.audio is None:
        return None
    b = json.loads(words.audio)
    e = b["audio_encoding_config"]
    return AudioConfig(
        b["sampling_rate"], b["frame_rate"], e["num_mel_bins"], e["hop_length"], e["window_size"], b.get("chunk_length_s"), b.get("transcription_delay_ms"),
        left_pad_tokens=b.get("streaming_n_left_pad_tokens") or 0, streaming=b.get("transcription_format") == "streaming", voices=b.get("voice_num_audio_tokens") or {},
    )


@dataclass(frozen=True)
class Engine:
    """Everything that a run needs to know besides its data."""

    version: Version = field(default_factory=lambda: version(7))
    mode: str = "test"
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    image: ImageConfig = field(default_factory=ImageConfig)
    audio: AudioConfig = field(default_factory=AudioConfig)
    max_input_tokens: int | None = None
    json_text: bool = True
    efforts: tuple[str, ...] = ("none", "high")
    effort_default: str | None = None
    effort_may_lack: bool = True

    @classmethod
    def of(cls, name: int | str, **more) -> Engine:
        return cls(version=version(name), **more)

    @classmethod
    def for_vocabulary(cls, words: Vocabulary, **more) -> Engine:
        """With the version and the media and settings blocks that a vocabulary file brings."""
        found: dict = {"version": version(words.version), "vocabulary": words}
        if (image := image_config(words)) is not None:
            found["image"] = image
        if (audio := audio_config(words)) is not None:
            found["audio"] = audio
        if words.settings is not None and (effort := json.loads(words.settings).get("reasoning_effort")):
            found |= {"efforts": tuple(effort["values"]), "effort_default": effort.get("default"), "effort_may_lack": bool(effort["accepts_none"])}
        return cls(**(found | more))

    def checked(self, requests: DataFrame) -> DataFrame:
        """requests with `error`; a request to truncate needs a budget."""
        df = validate(requests, self.version, self.mode, schemas=self.json_text and "tools" in requests.columns)
        if "truncate_for_context_length" in requests.columns and self.max_input_tokens is None:
            asked = F.struct(F.lit("encode").alias("code"), F.lit("truncation needs a budget").alias("message"))
            df = df.withColumn("error", F.coalesce("error", F.when(F.col("truncate_for_context_length"), asked)))
        return df

    def normalized(self, requests: DataFrame) -> DataFrame:
        """Valid requests only, normalized: the costly steps never see the others."""
        df = nrm.normalize(requests.filter(F.col("error").isNull()), self.version, self.json_text)
        effort = F.col("reasoning_effort") if "reasoning_effort" in df.columns else F.lit(None).cast("string")
        built = nrm.built_settings(effort, self.version, self.efforts, self.effort_may_lack, self.effort_default)
        return df.withColumn("effort", built["effort"]).withColumn("settings_error", built["error"])

    def rendered(self, requests: DataFrame) -> DataFrame:
        """With segments and the debug text `prompt`."""
        df = render.segments(self.normalized(requests), self.version, self.json_text, self.image, self.audio)
        return df.withColumn("prompt", render.prompt_text(F.col("segments")))

    def encoded(self, requests: DataFrame) -> DataFrame:
        """With `tokens`, `prefix_ids` and `error`, valid requests only."""
        df = enc.message_ids(self.rendered(requests), self.vocabulary)
        budget = self.max_input_tokens if self.version.truncates else None
        df = enc.assemble(df, self.vocabulary, budget)
        return df.withColumn("error", F.coalesce("settings_error", "encode_error", "truncate_error"))

    def tokens(self, requests: DataFrame) -> DataFrame:
        """From requests: check, normalize, render, encode."""
        return self.encoded(self.checked(requests))

    def messages(self, generated: DataFrame, ids_col: str = "tokens") -> DataFrame:
        """From generated ids: the assistant's messages."""
        return parse.assistant_messages(generated, self.version, self.vocabulary, ids_col)
