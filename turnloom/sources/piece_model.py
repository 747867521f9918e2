"""Piece models (SentencePiece files): encoding, decoding and lookups."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.tokens import policy_of


@lru_cache(maxsize=4)
def _model(path: str):
    """One for a worker process. Workers read the file by its path, which they must share."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(pieces: Column, path: str, bos: bool = False, eos: bool = False) -> Column:
    """array<array<int>> from array<string>, each piece encoded by itself."""

    @F.arrow_udf("array<array<int>>")
    def run(a: pa.Array) -> pa.Array:
        m, rows = _model(path), a.to_pylist()
        head, tail = [m.bos_id()] * bos, [m.eos_id()] * eos
        known = {p: head + m.encode(p) + tail for p in {p for row in rows if row for p in row if p is not None}}
        return pa.array([None if row is None else [known.get(p, []) for p in row] for row in rows], pa.list_(pa.list_(pa.int32())))

    return run.asNondeterministic()(pieces)


def decode(ids: Column, path: str, policy: str | int = "ignore") -> Column:
    """struct(text, error). Kept special tokens are written between the runs of ordinary ones, spaces as the model marks
    them; otherwise all ids are decoded as one text."""
    policy = policy_of(policy)

    @F.arrow_udf("struct<text:string,error:string>")
    def run(a: pa.Array) -> pa.Array:
        m = _model(path)
        special = lambda t: m.is_control(t) or m.is_unknown(t)
        texts, errors = [], []
        for row in a.to_pylist():
            bad = row is not None and policy == "raise" and any(map(special, row))
            errors.append("special tokens are not allowed" if bad else None)
            if row is None or bad:
                texts.append(None)
            elif policy == "keep":
                texts.append("".join(m.id_to_piece(t) for t in row))
            else:
                texts.append(m.decode(row))  # the model itself leaves control tokens out and marks unknown ones
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])

    return run.asNondeterministic()(ids)


def table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score, special, byte) of all ids."""
    m = _model(path)
    rows = [(i, m.id_to_piece(i), float(m.get_score(i)), m.is_control(i) or m.is_unknown(i), m.is_byte(i)) for i in range(m.get_piece_size())]
    return spark.createDataFrame(rows, "id int, piece string, score double, special boolean, byte boolean")


def special_ids(path: str) -> dict[str, int]:
    m = _model(path)
    return {m.id_to_piece(i): i for i in range(m.get_piece_size()) if m.is_control(i) or m.is_unknown(i)}
