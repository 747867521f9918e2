"""Arithmetic of image and audio placeholders."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ImageConfig:
    patch: int = 16
    largest: int = 1024
    merge: int = 1


@dataclass(frozen=True)
class AudioConfig:
    """Rates of an audio encoder. Invalid combinations are refused at construction."""

    sampling_rate: int = 24000
    frame_rate: float = 12.5
    mel_bins: int = 128
    hop: int = 160
    window: int = 400
    chunk_s: float | None = None
    delay_ms: float | None = None
    look_ahead_ms: float = 2.5
    look_back_ms: float = 52.5
    left_pad_tokens: int = 32
    offline_buffer_tokens: int = 10
    streaming: bool = False
    voices: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.mel_bins, self.hop, self.window) <= 0:
            raise ValueError("mel_bins, hop and window must be positive")
        if self.chunk_s is not None and (self.chunk_s <= 0 or int(self.chunk_s * self.sampling_rate) <= 0):
            raise ValueError("a chunk must hold a sample")
        if self.delay_ms is not None and (self.delay_ms < 0 or self.delay_ms % self.frame_ms):
            raise ValueError("the delay must be a multiple of a frame's duration")

    @property
    def frame_ms(self) -> float:
        return 1000.0 / self.frame_rate

    @property
    def chunk_samples(self) -> int:
        if self.chunk_s is None:
            raise ValueError("no chunk length is set")
        return int(self.chunk_s * self.sampling_rate)

    @property
    def samples_per_token(self) -> int:
        return int(self.sampling_rate // self.frame_rate)

    @property
    def hops_per_token(self) -> int:
        return self.samples_per_token // self.hop

    def delay_tokens(self, ms: float) -> int:
        """Tokens of a delay; it must be a multiple of a frame's duration."""
        if ms < 0 or ms % self.frame_ms:
            raise ValueError("the delay must be a multiple of a frame's duration")
        return self.audio_tokens(int(ms / 1000.0 * self.sampling_rate))

    def audio_tokens(self, samples: int) -> int:
        frames = math.ceil(samples / self.hop - 1) if samples % self.hop else samples // self.hop
        return math.ceil(frames / self.hops_per_token)

    def right_pad_tokens(self, ms: float) -> int:
        return self.delay_tokens(ms) + 1 + self.offline_buffer_tokens


def image_grid(width: Column, height: Column, c: ImageConfig = ImageConfig()) -> Column:
    """struct(w, h): tokens across and down. A side beyond the largest shrinks both, rounded half to even."""
    ratio = F.greatest(width, height) / F.lit(float(c.largest))
    small = lambda x: F.when(ratio > 1, F.bround(x / ratio)).otherwise(x.cast("double"))
    tokens = lambda x: (F.floor((small(x) - 1) / (c.patch * c.merge)) + 1).cast("int")
    return F.struct(tokens(width).alias("w"), tokens(height).alias("h"))


def image_size(width: Column, height: Column, c: ImageConfig = ImageConfig()) -> Column:
    """struct(w, h) in pixels after resizing: whole tokens."""
    g = image_grid(width, height, c)
    return F.struct((g["w"] * c.patch * c.merge).alias("w"), (g["h"] * c.patch * c.merge).alias("h"))


def image_run(w: Column, h: Column, img: int, line: int, end: int) -> Column:
    """Ids of an image: h rows of w patches, each closed by a line token, the last by the end token."""
    row = F.concat(F.array_repeat(F.lit(img), w), F.array(F.lit(line)))
    every = F.flatten(F.array_repeat(row, h))
    return F.concat(F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))), F.array(F.lit(end)))


def audio_frames(samples: Column, c: AudioConfig) -> Column:
    return F.when(samples % c.hop != 0, F.ceil(samples / c.hop - 1)).otherwise(F.floor(samples / c.hop))


def audio_tokens(samples: Column, c: AudioConfig = AudioConfig()) -> Column:
    return F.ceil(audio_frames(samples, c) / c.hops_per_token).cast("int")


def padded_samples(samples: Column, c: AudioConfig, delay_ms: float | None = None) -> Column:
    """Length after padding: whole chunks if chunks are set; when streaming, whole tokens with pads on both sides; else
    at least a window."""
    if c.chunk_s is not None:
        return (F.ceil(samples / c.chunk_samples) * c.chunk_samples).cast("bigint")
    if c.streaming:
        unit = c.samples_per_token
        pads = (c.left_pad_tokens + c.right_pad_tokens(delay_ms if delay_ms is not None else c.delay_ms or 0.0)) * unit
        return (F.ceil(samples / unit) * unit + pads).cast("bigint")
    return F.greatest(samples, F.lit(c.window)).cast("bigint")


def padded(samples: Column, c: AudioConfig) -> Column:
    """The samples with zeros behind them to padded_samples()."""
    return F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), (padded_samples(F.size(samples), c) - F.size(samples)).cast("int")))


def streaming_prefix(c: AudioConfig, pad_id: int, delay_ms: float) -> Column:
    return F.array_repeat(F.lit(pad_id), c.left_pad_tokens + c.delay_tokens(delay_ms))


def speech_tokens(samples: Column, rate: Column, voice: Column, c: AudioConfig) -> Column:
    """Audio tokens of a speech request: from the reference audio if given, else by the preset voice; null if neither."""
    preset = F.lit(None).cast("int")
    for name, n in c.voices.items():
        preset = F.when(voice == name, F.lit(n)).otherwise(preset)
    return F.when(samples.isNotNull(), (F.ceil(samples / rate * c.frame_rate) + 1).cast("int")).otherwise(preset)


def duration(samples: Column, rate: Column) -> Column:
    return samples / rate


# The Slaney mel scale, linear below 1000 Hz and logarithmic above.
_LINEAR_HZ, _BREAK_HZ, _BREAK_MEL, _LOG_STEP = 200.0 / 3.0, 1000.0, 15.0, 27.0 / math.log(6.4)


def hertz_to_mel(hz: Column) -> Column:
    return F.when(hz >= _BREAK_HZ, _BREAK_MEL + F.ln(hz / _BREAK_HZ) * _LOG_STEP).otherwise(hz / _LINEAR_HZ)


def mel_to_hertz(mel: Column) -> Column:
    return F.when(mel >= _BREAK_MEL, _BREAK_HZ * F.exp((mel - _BREAK_MEL) / _LOG_STEP)).otherwise(mel * _LINEAR_HZ)


def mel_filters(spark: SparkSession, frequencies: int, mels: int, low: float, high: float, sampling_rate: int) -> DataFrame:
    """(frequency, mel, weight): triangles of unit area over the mel scale. The table's size is fixed by its arguments."""
    a, b = (x / _LINEAR_HZ if x < _BREAK_HZ else _BREAK_MEL + math.log(x / _BREAK_HZ) * _LOG_STEP for x in (low, high))
    edge = lambda i: mel_to_hertz(F.lit(a) + i * ((b - a) / (mels + 1)))
    hz = F.col("frequency") * (sampling_rate / 2.0 / (frequencies - 1))
    grid = spark.range(frequencies).select(F.col("id").alias("frequency"), F.explode(F.sequence(F.lit(0), F.lit(mels - 1))).alias("mel"))
    left, centre, right = edge(F.col("mel")), edge(F.col("mel") + 1), edge(F.col("mel") + 2)
    up, down = (hz - left) / (centre - left), (right - hz) / (right - centre)
    return grid.select("frequency", "mel", (F.greatest(F.lit(0.0), F.least(up, down)) * (2.0 / (right - left))).alias("weight"))
