"""Media in columns: where it is, what it is, and its bytes. Only inline data is loaded; nothing is fetched over a network."""

from __future__ import annotations

import io
import struct
import wave
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def url_kind(url: Column) -> Column:
    """'url', 'base64', 'file_uri', 'file' or 'unknown'. A path counts as a file by its form; whether it exists isn't asked,
    as executors needn't share a disk."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(scheme.isin("http", "https"), "url").when(scheme == "data", "base64").when(scheme == "file", "file_uri")
        .when(url.rlike(r"^[~./]|\.[A-Za-z0-9]{2,5}$"), "file").when(url.rlike("^[A-Za-z0-9+/]+={0,2}$"), "base64").otherwise("unknown")
    )


def without_prefix(data: Column, kind: str = "audio") -> Column:
    """Base64 without a data URL's head, where its subtype is a plain word."""
    return F.regexp_replace(data, rf"^data:{kind}/\w+;base64,", "")


def inline_bytes(url: Column, kind: str = "image") -> Column:
    return F.try_to_binary(F.regexp_replace(url, rf"^data:{kind}/[\w.+-]+;base64,", ""), F.lit("base64"))


def data_url(data: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))


def audio_format(data: Column) -> Column:
    """Container by its first bytes; null if none is known."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645"), "wav").when(head.startswith("664C6143"), "flac")
        .when(head.startswith("4F676753"), "ogg").when(head.startswith("494433") | head.rlike("^FF[EF][0-9A-F]"), "mp3")
        .when(F.substring(head, 9, 8) == "66747970", "mp4").when(head.startswith("1A45DFA3"), "webm")
    )


def image_format(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp")
    )


def image_dimensions(data: Column) -> Column:
    """struct(width, height) from the header of a PNG, GIF or BMP; null for other formats. Pixels aren't decoded."""
    number = lambda at, n: F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("int")
    little = lambda at, n: F.conv(F.hex(F.concat(*(F.substring(data, at + i, 1) for i in reversed(range(n))))), 16, 10).cast("int")
    kind = image_format(data)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(kind == "png", size(number(17, 4), number(21, 4))).when(kind == "gif", size(little(7, 2), little(9, 2))).when(kind == "bmp", size(little(19, 4), little(23, 4)))


def wav_samples(data: Column, strict: bool = True) -> Column:
    """struct(samples, sampling_rate, error) from PCM WAV bytes: mono, or the mean of channels unless strict."""

    def one(b: bytes) -> tuple[list[float] | None, int | None, str | None]:
        try:
            with wave.open(io.BytesIO(b)) as w:
                channels, width, rate, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
                raw = w.readframes(n)
        except (wave.Error, EOFError, struct.error) as e:
            return None, None, f"not a PCM WAV: {e}"
        if channels > 1 and strict:
            return None, rate, "more than one channel"
        if width not in (1, 2, 4):
            return None, rate, f"samples of {width} bytes"
        kind, offset = {1: ("B", 128), 2: ("h", 0), 4: ("i", 0)}[width]
        values = [(x - offset) / float(1 << (8 * width - 1)) for (x,) in struct.iter_unpack("<" + kind, raw)]
        return [sum(values[i : i + channels]) / channels for i in range(0, len(values), channels)], rate, None if values else "no samples"

    kind = pa.struct([("samples", pa.list_(pa.float32())), ("sampling_rate", pa.int32()), ("error", pa.string())])

    @F.arrow_udf("struct<samples:array<float>,sampling_rate:int,error:string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if b is None else dict(zip(("samples", "sampling_rate", "error"), one(b), strict=True)) for b in a.to_pylist()], kind)

    return run.asNondeterministic()(data)


def wav_bytes(samples: Column, rate: Column) -> Column:
    """16-bit mono WAV from samples in -1..1."""

    @F.arrow_udf("binary")
    def run(a: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for xs, hz in zip(a.to_pylist(), r.to_pylist(), strict=True):
            if xs is None or hz is None:
                out.append(None)
                continue
            held = io.BytesIO()
            with wave.open(held, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(hz)
                w.writeframes(b"".join(struct.pack("<h", max(-32768, min(32767, round(x * 32767)))) for x in xs))
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(samples, rate)


def gray_png(width: int, height: int) -> bytes:
    """A small picture for tests and examples."""
    rows = b"".join(b"\0" + bytes(width) for _ in range(height))
    block = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + block(b"IDAT", zlib.compress(rows)) + block(b"IEND", b"")
