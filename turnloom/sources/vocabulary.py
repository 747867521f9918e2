"""Vocabulary files: loading, checking, and their tables."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from turnloom.special import COMMON, SpecialTokens

#: A byte vocabulary needs no other split; a plain '.+' would lose line ends.
BYTES_PATTERN = r"(?s:.+)"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by rank, the pattern that splits text before merging, special tokens, and the blocks for media."""

    pattern: str = BYTES_PATTERN
    words: tuple[bytes, ...] = tuple(bytes([i]) for i in range(256))
    special: SpecialTokens = field(default_factory=SpecialTokens, compare=False)
    version: str = "v7"
    image: str | None = None
    audio: str | None = None
    settings: str | None = None

    def __post_init__(self) -> None:
        if any(w != bytes([i]) for i, w in enumerate(self.words[:256])) or len(self.words) < 256:
            raise ValueError("the first 256 pieces must be the single bytes")
        if len(set(self.words)) != len(self.words):
            raise ValueError("two pieces are equal")

    @property
    def n_special(self) -> int:
        return self.special.size

    @property
    def size(self) -> int:
        return self.n_special + len(self.words)

    def ranks(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def pieces(self) -> tuple[bytes, ...]:
        return self.words


def load(path: str, text: str | None = None) -> Vocabulary:
    """From a JSON vocabulary file: config, vocab by rank, special tokens (the common ones where a file up to v7 has none).

    text: the file's content, where a reader other than this process fetched it."""
    return _parsed(text if text is not None else Path(path).read_text())


@lru_cache(maxsize=4)
def _parsed(text: str) -> Vocabulary:
    data = json.loads(text)
    config = data["config"]
    version = config.get("version")
    number = int(re.sub(r"\D.*", "", str(version).removeprefix("v")) or 0)
    if number not in (3, 7, 11, 13, 15):
        raise ValueError(f"unknown version {version}")
    size, n_special = config["default_vocab_size"], config["default_num_special_tokens"]
    given = data.get("special_tokens")
    if given is None:
        if number > 7:
            raise ValueError("versions beyond v7 list their special tokens")
        ranks = {t: i for i, t in enumerate(COMMON)}
    else:
        ranks = {t["token_str"]: t["rank"] for t in given}
        if len(ranks) != len(given):
            raise ValueError("two special tokens read alike")
    if "multimodal" in data and number > 11:
        raise ValueError("from v13 on the image block is named image")
    vocab = sorted(data["vocab"], key=lambda x: x["rank"])[: size - n_special]
    if [x["rank"] for x in vocab] != list(range(len(vocab))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    blocks = {k: json.dumps(data[k]) if data.get(k) is not None else None for k in ("audio", "model_settings_builder")}
    image = data.get("image", data.get("multimodal"))
    if blocks["model_settings_builder"] is not None and number < 15:
        raise ValueError("settings need v15")
    return Vocabulary(
        config["pattern"], tuple(base64.b64decode(x["token_bytes"]) for x in vocab), SpecialTokens(n_special, ranks), f"v{number}",
        json.dumps(image) if image is not None else None, blocks["audio"], blocks["model_settings_builder"],
    )


def read(spark: SparkSession, path: str) -> Vocabulary:
    """As load(), from wherever Spark can read. One file, of a size fixed by its format."""
    return load(path, spark.read.text(path, wholetext=True).first()[0])


def table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(id, piece, text, special) of all ids."""
    rows = [(i, t.encode(), t, True) for i, t in enumerate(v.special.names())]
    rows += [(v.n_special + i, w, w.decode("utf-8", "replace"), False) for i, w in enumerate(v.words)]
    return spark.createDataFrame([(i, bytearray(b), t, s) for i, b, t, s in rows], "id int, piece binary, text string, special boolean")


def is_vocabulary(path: str) -> bool:
    """A JSON vocabulary, by name."""
    return path.endswith(".json")


def piece_model(path: str) -> tuple[int, bool] | None:
    """(version, with images) of a piece model by the end of its name, such as .model.v3 or .model.v7m1; v1 without one;
    None for other files."""
    m = re.search(r"\.model(?:\.v(\d+)(m\d+)?)?$", path)
    return (int(m[1] or 1), m[2] is not None) if m else None


def choose(paths: list[str]) -> str:
    """The vocabulary file among several: a JSON vocabulary first, else the last by name among piece models."""
    usable = [p for p in paths if is_vocabulary(p) or piece_model(p)]
    if not usable:
        raise ValueError("no vocabulary file")
    json_files = [p for p in usable if is_vocabulary(p)]
    return max(json_files or usable, key=lambda p: Path(p).name)
