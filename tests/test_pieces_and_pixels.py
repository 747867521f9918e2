import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom import __main__ as cli
from turnloom.functions import pixels
from turnloom.sources import media, piece_model


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path("piece_bpe_32k.model"))


def test_piece_model(spark, model):
    df = spark.createDataFrame([(["Hello world", "a\nb", "", None],), (None,)], "p array<string>").select(piece_model.encode(F.col("p"), model, bos=True, eos=True).alias("ids"))
    rows = [r.ids for r in df.collect()]
    assert rows[0][2] == [1, 2] and rows[0][3] == [] and rows[1] is None
    ids = spark.createDataFrame([(rows[0][0],), ([],), (None,)], "ids array<int>")
    got = {p: ids.select(piece_model.decode(F.col("ids"), model, p).alias("d")).first().d for p in ("ignore", "keep", "raise")}
    assert got["ignore"].text == "Hello world" and got["keep"].text == "<s>▁Hello▁world</s>" and got["raise"].error
    t = piece_model.table(spark, model)
    assert t.count() == 32000 and t.filter("special").count() == 3 and t.filter("byte").count() == 256
    assert piece_model.special_ids(model) == {"<unk>": 0, "<s>": 1, "</s>": 2}


def png(pixels_, kind, filters, extra=b""):
    h, w, c = pixels_.shape
    rows, above = [], np.zeros(w * c, dtype=int)
    for y in range(h):
        row, f = pixels_[y].ravel().astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(c, int), row[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][f]
        rows.append(bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    block = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + block(b"IDAT", zlib.compress(b"".join(rows))) + block(b"IEND", b"")


@pytest.mark.parametrize(("kind", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters_and_transparency(kind, channels):
    x = np.random.default_rng(1).integers(0, 256, size=(11, 7, channels)).astype(np.uint8)
    got = pixels.png_pixels(png(x, kind, [0, 1, 2, 3, 4]))
    colour = np.repeat(x[..., :1], 3, axis=2) if channels < 3 else x[..., :3]
    share = x[..., -1:] / 255 if channels in (2, 4) else 1.0
    assert (got == np.rint(colour * share + 255 * (1 - share))).all()


def test_tensors(spark):
    flat = np.full((40, 24, 3), 128, dtype=np.uint8)
    df = spark.createDataFrame([(bytearray(png(flat, 2, [0])),), (bytearray(b"no"),), (bytearray(media.gray_png(2000, 10)),), (None,)], "b binary").select(pixels.image_tensor(F.col("b")).alias("t"))
    a, b, c, d = (r.t for r in df.collect())
    assert (a.c, a.h, a.w, len(a.data)) == (3, 48, 32, 3 * 48 * 32)
    want = (128 / 255 - np.array(pixels.MEAN)) / np.array(pixels.DEVIATION)
    assert np.allclose(np.array(a.data).reshape(3, -1).T, want, atol=1e-5)
    assert b.error and (c.h, c.w) == (16, 1024) and d is None
    same = np.random.default_rng(2).integers(0, 256, size=(16, 16, 3)).astype(np.uint8)
    back = pixels.tensor(same, 16, 16) * np.array(pixels.DEVIATION)[:, None, None] + np.array(pixels.MEAN)[:, None, None]
    assert np.allclose(back * 255, same.transpose(2, 0, 1), atol=1e-3)  # no resizing, no change


def test_command_line(spark, tmp_path, capsys):
    cli.main(["template", "v13", "--thinking"])
    assert "[THINK]" in capsys.readouterr().out
    rows = [(1, '{"model": "m", "messages": [{"role": "user", "content": "q"}]}'), (2, '{"messages": []}')]
    spark.createDataFrame(rows, "conv_id long, request string").write.parquet(str(tmp_path / "in"))
    cli.main(["tokenize", "v7", str(tmp_path / "in"), str(tmp_path / "out")])
    assert [r.prompt for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["<s>[INST]q[/INST]"]
