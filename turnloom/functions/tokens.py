"""Tokens: byte vocabulary in columns, byte-pair vocabularies in Arrow batches, ids back to text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import runs
from turnloom.sources.vocabulary import Vocabulary

POLICIES = ("ignore", "keep", "raise")


def policy_of(value: str | int) -> str:
    """By name or by number, in the order ignore, keep, raise."""
    name = POLICIES[value] if isinstance(value, int) and 0 <= value < 3 else value
    if name not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    return name


def byte_ids(text: Column, shift: int) -> Column:
    """Ids of a vocabulary of single bytes: the UTF-8 bytes, shifted."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + shift)


@lru_cache(maxsize=8)
def _encoding(v: Vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=dict(v.ranks()), special_tokens={})


def bpe_ids(pieces: Column, v: Vocabulary) -> Column:
    """array<array<int>> from array<string>: each piece encoded by itself; what reads like special tokens is text.

    A batch encodes each distinct piece once. The vocabulary travels with the function and is set up once a worker."""

    @F.arrow_udf("array<array<int>>")
    def run(a: pa.Array) -> pa.Array:
        rows, known, shift = a.to_pylist(), {}, v.n_special
        encode = _encoding(v).encode_ordinary
        for p in {p for row in rows if row for p in row if p is not None}:
            known[p] = [t + shift for t in encode(p)]
        return pa.array([None if row is None else [known.get(p, []) for p in row] for row in rows], pa.list_(pa.list_(pa.int32())))

    return run.asNondeterministic()(pieces)


def decoded(ids: Column, v: Vocabulary, policy: str | int = "ignore") -> Column:
    """struct(text, error) of an array of ids. Runs of ordinary ids are decoded together, bad bytes replaced; special ids
    are left out, written, or an error, by policy."""
    policy, names, n = policy_of(policy), v.special.names(), v.n_special

    def one(row: list[int], pieces: list[bytes]) -> tuple[str | None, str | None]:
        parts, at = [], 0
        for p in [*np.flatnonzero(np.asarray(row, dtype=np.int64) < n).tolist(), len(row)]:
            if p > at:
                parts.append(b"".join(map(pieces.__getitem__, row[at:p])).decode("utf-8", "replace"))
            if p < len(row) and row[p] >= 0 and policy == "raise":
                return None, "special tokens are not allowed"
            if p < len(row) and row[p] >= 0 and policy == "keep":
                parts.append(names[row[p]])
            at = p + 1
        return "".join(parts), None

    @F.arrow_udf("struct<text:string,error:string>")
    def go(a: pa.Array) -> pa.Array:
        pieces = [b""] * n + list(v.pieces())  # by id
        out = [(None, None) if row is None else one(row, pieces) for row in a.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["text", "error"])

    return go.asNondeterministic()(ids)


def byte_histogram(df: DataFrame, text_col: str, n_special: int) -> DataFrame:
    """(token_id, n, n_docs): how often each byte token occurs, and in how many texts. Bytes are counted where they lie; a task
    sends on one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
                    n += found
                    docs += found > 0
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids + n_special, pa.int32()), pa.array(n[ids]), pa.array(docs[ids])], names=["token_id", "n", "n_docs"])

    counted = df.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "token_id int, n long, n_docs long")
    return counted.groupBy("token_id").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def special_runs(ids: Column, n_special: int) -> Column:
    """array<struct(special, ids)>: consecutive ids of one kind together."""
    return F.transform(runs(ids, lambda p, x, i: (p < n_special) != (x < n_special)), lambda r: F.struct((F.get(r, F.lit(0)) < n_special).alias("special"), r.alias("ids")))


def with_pieces(tokens: DataFrame, vocabulary: DataFrame, id_col: str = "token_id") -> DataFrame:
    """tokens joined to the vocabulary table, which is broadcast: its size is fixed by the file, not by the data."""
    return tokens.join(F.broadcast(vocabulary.withColumnRenamed("id", id_col)), id_col, "left")


def is_byte(id_: Column, n_special: int) -> Column:
    return id_.between(n_special, n_special + 255)
