"""Pictures to tensors: 8-bit PNG to colours on white, resized, scaled and ordered by channel."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.media import ImageConfig

# Mean and deviation by channel that image encoders of this family expect.
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x 3, transparent parts on white. Raises ValueError for what isn't an 8-bit, plain PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, blocks, head, palette, clear = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, dtype=np.uint8)
        elif kind == b"IDAT":
            blocks.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise ValueError("a PNG of a form that isn't read here")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(blocks)), dtype=np.uint8).reshape(h, 1 + w * c)
    except zlib.error as e:
        raise ValueError("broken data") from e
    rows = np.zeros((h, w * c), dtype=np.uint8)
    above = np.zeros(w * c, dtype=np.int64)
    for y in range(h):
        above = rows[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above.astype(np.int64), c)
    p = rows.reshape(h, w, c)
    if head[3] == 3:
        alpha = np.full(256, 255, dtype=np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        colour, a = palette[p[..., 0]], alpha[p[..., 0]]
    else:
        colour = np.repeat(p[..., :1], 3, axis=2) if c < 3 else p[..., :3]
        a = p[..., -1] if c in (2, 4) else np.full((h, w), 255, dtype=np.uint8)
    share = a[..., None] / 255.0
    return np.rint(colour * share + 255 * (1 - share)).astype(np.uint8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind in (0, 2):
        return (row + (above if kind == 2 else 0)) & 255
    if kind not in (1, 3, 4):
        raise ValueError("no such filter")
    out = row.copy()
    for i in range(len(row)):
        a = out[i - step] if i >= step else 0
        if kind == 1:
            add = a
        elif kind == 3:
            add = (a + above[i]) // 2
        else:
            c = above[i - step] if i >= step else 0
            p = a + above[i] - c
            near = sorted(((abs(p - a), 0, a), (abs(p - above[i]), 1, above[i]), (abs(p - c), 2, c)))
            add = near[0][2]
        out[i] = (out[i] + add) & 255
    return out


def _cubic(n: int, size: int, a: float = -0.75) -> np.ndarray:
    """size x n weights of cubic convolution, centres aligned, edges repeated."""
    x = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(x).astype(int)
    out = np.zeros((size, n))
    for k in range(-1, 3):
        t = np.abs(x - (base + k))
        w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))
        np.add.at(out, (np.arange(size), np.clip(base + k, 0, n - 1)), w)
    return out


def tensor(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """3 x height x width."""
    h, w, _ = pixels.shape
    x = np.einsum("yh,hwc,xw->cyx", _cubic(h, height), pixels.astype(float), _cubic(w, width)) / 255.0
    return ((x - np.array(MEAN)[:, None, None]) / np.array(DEVIATION)[:, None, None]).astype(np.float32)


def image_tensor(data: Column, c: ImageConfig = ImageConfig()) -> Column:
    """struct(c, h, w, data, error) from picture bytes, sized in whole tokens as media.image_size() has it."""

    def one(b: bytes) -> dict:
        try:
            p = png_pixels(b)
        except (ValueError, struct.error) as e:
            return {"error": str(e)}
        ratio = max(p.shape[:2]) / c.largest
        side = c.patch * c.merge
        h, w = ((((round(n / ratio) if ratio > 1 else n) - 1) // side + 1) * side for n in p.shape[:2])
        return {"c": 3, "h": h, "w": w, "data": tensor(p, w, h).ravel().tolist()}

    kind = pa.struct([("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.list_(pa.float32())), ("error", pa.string())])

    @F.arrow_udf("struct<c:int,h:int,w:int,data:array<float>,error:string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if b is None else one(b) for b in a.to_pylist()], kind)

    return run.asNondeterministic()(data)
