"""Packing documents into fixed-length sequences by the sum-of-squares rule.

An open sequence is known by its gap, the room left in it. A piece goes where the sum over gaps of (number of open
sequences with that gap) squared becomes smallest, a new sequence included among the choices.
"""

from __future__ import annotations

import math
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import written

#: Words of a generation whose ids a worker remembers, at about 200 bytes each.
_REMEMBERED = 700_000
#: Bytes of the longest word that is remembered: a text without white space is one word.
_LONGEST = 64
#: Marks that the tokenizer parts from a letter or digit before them.
_MARKS = b".,;:!?%&$*#|"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's; its threads would wait in spin loops
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ends_plain(core: bytes) -> bool:
    """Whether the last character, normalised and in lower case, is letters or numbers alone; other signs would stay
    together with marks behind them, combining ones included, which some letters end in once they are normalised."""
    if not core or core[-1] < 128:
        return core[-1:].isalnum()
    last = core[-4:].decode("utf-8", "ignore")[-1:]
    return last != "" and all(unicodedata.category(c)[0] in "LN" for c in unicodedata.normalize("NFC", last).lower())


class WordEncoder:
    """Ids of whole texts for a lower-casing tokenizer that drops white space and never joins across it.

    Each distinct word is encoded once and remembered as packed little-endian ids; a word that ends in plain marks is
    looked up without them, as the tokenizer parts marks from what precedes them. What may be a special token, whose
    letters' case counts, goes to the tokenizer as it is. Memory is two generations of words of at most _LONGEST
    bytes: when the younger is full it becomes the older, so words in use stay. Longer words are forgotten with their text.
    """

    def __init__(self, path: str) -> None:
        self.path, self.young, self.old = path, {}, {}

    def packed(self, text: bytes) -> bytes:
        tokens = text.split() if b"<|" in text else text.lower().split()  # at the six ASCII white-space bytes only
        young = self.young
        if new := [w for w in dict.fromkeys(tokens) if w not in young]:
            ids_of = young.__getitem__
            if long := self._learn(new):
                ids_of = lambda w: young[w] if w in young else long[w]
            out = b"".join(map(ids_of, tokens))
            if len(young) > _REMEMBERED:
                self.old, self.young = young, {}
            return out
        return b"".join(map(young.__getitem__, tokens))

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Remember the ids of new words; those of the long ones are returned."""
        young, old, found = self.young, self.old, {}
        parts = {}
        for w in new:
            if w in old:
                young[w] = old[w]
            else:
                core = w if b"<|" in w else w.rstrip(_MARKS)
                parts[w] = (core, w[len(core) :]) if _ends_plain(core) else (w, b"")
        for x in dict.fromkeys(x for pair in parts.values() for x in pair):
            found[x] = young.get(x) or old.get(x) if x else b""
        ask = [x for x, ids in found.items() if ids is None]
        for x, e in zip(ask, _tokenizer(self.path).encode_batch_fast([x.decode() for x in ask], add_special_tokens=False), strict=True):
            found[x] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        found |= {w: found[core] + found[marks] for w, (core, marks) in parts.items()}
        young |= {x: ids for x, ids in found.items() if 0 < len(x) <= _LONGEST}
        return {x: ids for x, ids in found.items() if len(x) > _LONGEST}


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One for a worker process, over all its tasks."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; see pack()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.packed(text or b"") + end
                n = len(ids) // 4
                out += [(doc_id, i, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)])) for i, at in enumerate(range(0, n, capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the order given. Among equal choices the smallest gap wins."""
    open_count = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full sequences (gap 0) don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = open_count[s:]  # gaps s..capacity
        # leaving gap g: -2c(g)+1; entering gap g-s: 2c(g-s)+1, but nothing for a full one
        change = 2 * (open_count[: capacity - s + 1] - here) + 2
        change[0] -= 2 * open_count[0] + 1
        change[-1] = never
        change[here == 0] = never
        g = int(change.argmin())
        fresh = 2 * int(open_count[capacity - s]) + 1 if s < capacity else 0
        if change[g] < never and change[g] <= fresh:
            gap = g + s
            b = stacks[gap].pop()
            open_count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_count[gap - s] += 1
    return sequence, offset


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, shard_pieces: int = 8192, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id; null text counts as empty, so every document has a piece. Only
    documents longer than a sequence are cut. Pieces that fill a sequence have it to themselves; the others are dealt
    by a hash with their row's number into shards of about `shard_pieces`, and each shard is packed by itself, longest
    first (the rule then closes large gaps last, with the smallest pieces), which costs at most a few open sequences a
    shard. Ties in length go by doc_id and piece; repeated rows are packed each; null ids stay null. A very long text
    needs memory in proportion to itself while it is cut. An empty table gives an empty one.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    full, rest = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(rest.count() / shard_pieces))
    row = F.monotonically_increasing_id()  # of a written table; rows alike fall into different shards
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(shards)).cast("long"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        sequence += table["shard"].to_numpy() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("shard").applyInArrow(place, kind)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
