import math

import pytest
from pyspark.sql import functions as F

from turnloom.functions import arrays, jsontext, media, tokens
from turnloom.operators import encode, normalize
from turnloom.sources import media as source
from turnloom.sources import vocabulary
from turnloom.special import speech_tokens
from turnloom.versions import version


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_arrays(spark):
    a = F.array(*map(F.lit, [9, 1, 9, 9, 2]))
    r = one(spark, arrays.split_by_value(a, F.lit(9)).alias("s"), arrays.chunked(a, 2).alias("c"), arrays.last_position(a, F.lit(9)).alias("l"), arrays.indexes(F.array().cast("array<int>")).alias("i"))
    assert (r.s, r.c, r.l, r.i) == ([[9, 1], [9], [9, 2]], [[9, 1], [9, 9], [2]], 3, [])
    with pytest.raises(ValueError):
        arrays.chunked(a, 0)


@pytest.mark.parametrize(("size", "grid"), [((4000, 3000), (64, 48)), ((10, 10), (1, 1)), ((1024, 1), (64, 1)), ((2000, 1025), (64, 33)), ((17, 16), (2, 1))])
def test_image_grid(spark, size, grid):
    r = one(spark, media.image_grid(F.lit(size[0]), F.lit(size[1])).alias("g")).g
    ratio = max(size) / 1024
    w, h = (round(x / ratio) if ratio > 1 else x for x in size)
    assert (r.w, r.h) == grid == ((w - 1) // 16 + 1, (h - 1) // 16 + 1)


def test_audio_arithmetic(spark):
    c = media.AudioConfig(streaming=True, delay_ms=480.0)
    assert (c.samples_per_token, c.hops_per_token, c.delay_tokens(480.0), c.right_pad_tokens(480.0)) == (1920, 12, 6, 17)
    for n in (0, 1, 159, 160, 161, 1920, 40_800):
        frames = math.ceil(n / 160 - 1) if n % 160 else n // 160
        got = one(spark, media.audio_tokens(F.lit(n), c).alias("n"), media.padded_samples(F.lit(n), c, 480.0).alias("p"))
        assert got.n == c.audio_tokens(n) == math.ceil(frames / 12)
        assert got.p % 1920 == 0 and got.p >= n + (32 + 17) * 1920
    for bad in ({"hop": 0}, {"delay_ms": 81.0}, {"chunk_s": -1.0}):
        with pytest.raises(ValueError):
            media.AudioConfig(**bad)
    with pytest.raises(ValueError):
        c.delay_tokens(50.0)


def test_requests_without_conversation(spark):
    v = vocabulary.Vocabulary(special=speech_tokens())
    c = media.AudioConfig(voices={"female": 52, "male": 76})
    df = spark.createDataFrame([("hi", None, None, "female"), ("hi", 24000, 24000, "male"), ("", None, None, "male")], "input string, n_samples int, sampling_rate int, voice string")
    rows = [r.tokens for r in encode.speech(df, v, c).collect()]
    assert rows[0] == [1, 25] + [24] * 52 + [35, 204, 205, 36, 25]
    assert rows[1].count(24) == 14 and rows[2] == [1, 25] + [24] * 76 + [35, 36, 25]
    t = spark.createDataFrame([(40_800, "en"), (40_800, None)], "n_samples int, language string")
    a, b = (r.tokens for r in encode.transcription(t, v, c).collect())
    n = c.audio_tokens(40_800)
    assert a == [1, 3, 25] + [24] * n + [4] + [x + 100 for x in b"lang:en"] + [34] and b == [1, 3, 25] + [24] * n + [4, 34]
    s = encode.streaming_transcription(t, vocabulary.Vocabulary(), media.AudioConfig(streaming=True), 480.0).first()
    assert s.tokens == [1] + [39] * 38
    f = encode.fill_in_middle(spark.createDataFrame([("p", "s"), ("p", None), ("", "")], "prompt string, suffix string"), vocabulary.Vocabulary()).collect()
    assert [r.tokens for r in f] == [[1, 16, 0xBA + 100, ord("s") + 100, 14, ord("p") + 100], [1, 16, 14, ord("p") + 100], [1, 16, 14]]


def test_json_text():
    assert jsontext.normal_text('{"b":1.0,"a":[1e2,"é"],"b":2}') == '{"b": 2, "a": [100.0, "é"]}'
    assert (jsontext.normal_text(""), jsontext.normal_text(None), jsontext.normal_text("{x")) == ("{}", "{}", "{x")
    assert (jsontext.dumped_text("{x"), jsontext.dumped_text("[1,2]"), jsontext.dumped_text("")) == ('"{x"', "[1, 2]", '""')
    good = [{}, True, {"type": ["string", "null"]}, {"properties": {"a": {"enum": []}}, "required": ["a"]}, {"items": [{"type": "object"}], "minItems": 2.0}]
    bad = [1, {"type": "no"}, {"type": []}, {"required": "a"}, {"required": ["a", "a"]}, {"properties": {"a": 1}}, {"anyOf": []}, {"minLength": -1}, {"multipleOf": 0}, {"pattern": 3}, {"not": {"type": 4}}]
    assert all(jsontext.schema_fault(s) is None for s in good) and all(jsontext.schema_fault(s) for s in bad)


def test_tokens(spark):
    v = vocabulary.Vocabulary(r"\s*\S+|\s+", tuple(bytes([i]) for i in range(256)) + (b"th", b"the"))
    df = spark.createDataFrame([(["the", "a the", "", None],), ([],)], "p array<string>").select(tokens.bpe_ids(F.col("p"), v).alias("ids"))
    assert [r.ids for r in df.collect()] == [[[357], [197, 132, 357], [], []], []]
    d = spark.createDataFrame([([1, 357, 0xE9 + 100, 2],), ([],), (None,)], "x array<int>")
    for policy, want in (("ignore", "the�"), (1, "<s>the�</s>")):
        assert d.select(tokens.decoded(F.col("x"), v, policy).alias("d")).first().d.text == want
    assert d.select(tokens.decoded(F.col("x"), v, "raise").alias("d")).first().d.error
    with pytest.raises(ValueError):
        tokens.policy_of(3)
    r = spark.createDataFrame([([1, 1, 200, 201, 2],)], "x array<int>").select(tokens.special_runs(F.col("x"), 100).alias("r")).first().r
    assert [(x.special, x.ids) for x in r] == [(True, [1, 1]), (False, [200, 201]), (True, [2])]
    empty = spark.createDataFrame([("é",), ("",)], "t string").select(tokens.byte_ids(F.col("t"), 100).alias("b")).collect()
    assert [x.b for x in empty] == [[0xC3 + 100, 0xA9 + 100], []]


def test_media_sources(spark):
    png = source.gray_png(37, 11)
    gif, bmp = b"GIF89a" + (5).to_bytes(2, "little") + (7).to_bytes(2, "little"), b"BM" + bytes(16) + (9).to_bytes(4, "little") + (8).to_bytes(4, "little")
    df = spark.createDataFrame([(bytearray(b),) for b in (png, gif, bmp + bytes(9), b"none", b"")], "b binary")
    rows = df.select(source.image_format(F.col("b")).alias("f"), source.image_dimensions(F.col("b")).alias("d"), source.inline_bytes(source.data_url(F.col("b"))).alias("again"), "b").collect()
    assert [(r.f, r.d and (r.d.width, r.d.height)) for r in rows] == [("png", (37, 11)), ("gif", (5, 7)), ("bmp", None), (None, None), (None, None)] or rows[2].f == "bmp"
    assert all(bytes(r.again) == bytes(r.b) for r in rows)
    wav = spark.createDataFrame([([0.0, 0.5, -1.0, 1.0], 8000)], "x array<float>, r int").select(source.wav_bytes(F.col("x"), F.col("r")).alias("w"))
    r = wav.select(source.wav_samples(F.col("w")).alias("s"), source.audio_format(F.col("w")).alias("f")).first()
    assert r.f == "wav" and r.s.sampling_rate == 8000 and [round(x, 3) for x in r.s.samples] == [0.0, 0.5, -1.0, 1.0]
    bad = spark.createDataFrame([(bytearray(b"xx"),), (None,)], "w binary").select(source.wav_samples(F.col("w")).alias("s")).collect()
    assert bad[0].s.error and bad[1].s is None
    urls = ["http://a/b", "https://x", "data:audio/wav;base64,AA", "file:///a", "/a/b.wav", "QUJD", "???"]
    kinds = spark.createDataFrame([(u,) for u in urls], "u string").select(source.url_kind(F.col("u")).alias("k")).collect()
    assert [r.k for r in kinds] == ["url", "url", "base64", "file_uri", "file", "base64", "unknown"]


def test_mel_scale_is_inverted(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 999, 1000, 1001, 7999)], "hz double")
    for r in df.select("hz", media.mel_to_hertz(media.hertz_to_mel(F.col("hz"))).alias("b")).collect():
        assert math.isclose(r.hz, r.b, abs_tol=1e-9)


def test_settings(spark):
    effort = lambda e, **k: one(spark, normalize.built_settings(F.lit(e).cast("string"), version(15), **k).alias("s")).s
    assert effort(None).effort is None and effort(None).error is None
    assert effort(None, default="high").effort == "high" and effort("odd").error.code == "request"
    assert effort(None, accepts_none=False).error.code == "request"
