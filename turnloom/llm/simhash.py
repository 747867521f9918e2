"""SimHash fingerprints, their links by pigeonring filtering, and the groups that links form.

Pigeonring: lay the 64 bits as `segments` boxes on a ring. If two fingerprints differ in at most t bits, some box
starts a chain whose every prefix of l boxes holds at most l * t / segments of the differences. Leading boxes whose
budget is below 1 must be equal: they are the join key. The later prefixes' budgets are checked on the joined pair,
before the whole Hamming distance. A bucket larger than `bucket` isn't compared pair by pair: there, each fingerprint
emits its key under every mask of t further bits, and all that agree under one mask hang on the smallest of them;
those are exactly the pairs within t bits, at a cost in proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import HOT_ROWS, joined_by_hot_key, written
from turnloom.llm.graph import connected_components

BITS = 64
#: Bytes hashed into one block of bit counts.
_BLOCK = 8192


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; no words give 0."""
    tokens = text.lower().split() if text else []  # on bytes: A-Z only, and exactly the six white-space bytes
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams = iter([b" ".join(tokens)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
        n = len(tokens) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=">u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. One narrow pass; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, "id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _edges_of_segments(segments: int) -> list[int]:
    """Where the boxes begin, from the top bit, and 64 at the end."""
    size, extra = divmod(BITS, segments)
    at = [0]
    for i in range(segments):
        at.append(at[-1] + size + (i < extra))
    return at


def _mask(first: int, last: int) -> int:
    """Bits first..last-1 counted from the top, as an unsigned long; past 64 they go on from the top."""
    return sum(1 << (BITS - 1 - i % BITS) for i in range(first, last))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _chains(segments: int, bits: int) -> list[dict]:
    """For each start on the ring: the mask of the boxes that must be equal, and (mask, budget) of the longer prefixes."""
    at = _edges_of_segments(segments)
    width = [b - a for a, b in zip(at, at[1:], strict=False)]
    key_boxes = max(n for n in range(1, segments + 1) if n * bits < segments)
    out = []
    for s in range(segments):
        ends = [at[s] + sum(width[(s + j) % segments] for j in range(n)) for n in range(segments + 1)]
        out.append({
            "start": s, "key": _mask(at[s], ends[key_boxes]),
            "prefixes": [(_mask(at[s], ends[n]), n * bits // segments) for n in range(key_boxes + 1, segments)],
        })
    return out


def _wildcards(chain: dict, bits: int) -> list[int]:
    """Masks over the unequal part: every set of `bits` places that keeps the budgets. A smaller budget-keeping
    difference lies in one of them, as places of the last box never break a budget early."""
    free = [i for i in range(BITS) if not chain["key"] >> i & 1]
    masks = (sum(1 << i for i in places) for places in combinations(free, bits))
    return [m for m in masks if all(bin(m & p).count("1") <= c for p, c in chain["prefixes"])]


def link_edges(fps: DataFrame, bits: int = 2, segments: int = 5, bucket: int = 256) -> DataFrame:
    """(a, b) over the distinct fingerprints in column fp: edges that connect exactly what links of <= bits connect.

    Every edge joins two fingerprints within `bits` bits, or two that share a third within `bits` under one mask of
    `bits` bits (so they, too, are within `bits` of each other).
    """
    if not 0 < bits < segments:
        raise ValueError("bits must lie between 1 and segments - 1")
    chains = _chains(segments, bits)
    rows = [F.struct(F.lit(c["start"]).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(c["key"]))).alias("k")) for c in chains]
    keyed = fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.s", "r.k")
    keyed = written(keyed, "ring")
    sizes = keyed.groupBy("s", "k").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(keyed.join(sizes, ["s", "k"]), "ring")
    few = live.filter(F.col("n") <= bucket)
    x, y = few.alias("x"), few.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    budget = None
    for c in chains:
        ok = F.lit(True)
        for m, most in c["prefixes"]:
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) <= most)
        budget = F.when(F.col("x.s") == c["start"], ok) if budget is None else budget.when(F.col("x.s") == c["start"], ok)
    pair = (F.col("x.s") == F.col("y.s")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.fp") < F.col("y.fp"))
    near = x.join(y, pair & budget & (F.bit_count(diff) <= bits))
    edges = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if live.filter(F.col("n") > bucket).limit(1).count():
        many = live.filter(F.col("n") > bucket)
        wild = F.when(F.lit(False), F.array().cast("array<bigint>"))
        for c in chains:
            wild = wild.when(F.col("s") == c["start"], F.array(*[F.lit(_signed(m)) for m in _wildcards(c, bits)]))
        masked = many.select("s", "fp", F.explode(wild).alias("m"))
        masked = masked.withColumn("g", F.col("fp").bitwiseAND(F.bitwise_not("m")))
        least = masked.groupBy("s", "m", "g").agg(F.min("fp").alias("a"), F.count("*").alias("c")).filter("c > 1")
        hung = masked.join(least, ["s", "m", "g"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
        edges = edges.union(hung)
    return edges.distinct()


def segments_for(fingerprints: int, bits: int = 2) -> int:
    """Boxes whose chains of equal ones make keys long enough that few fingerprints of a table share one by chance."""
    for segments in range(2 * bits + 1, 16, bits):
        boxes = max(n for n in range(1, segments + 1) if n * bits < segments)
        if fingerprints <= 64 << (BITS * boxes // segments):
            break
    return segments


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, segments: int | None = None, bucket: int = 256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, fp (signed long) and component_id, the smallest id its links reach.

    Documents with equal fingerprints are one node, so copies never form pairs. Null and empty texts have fingerprint
    0 and link like any other; an empty table gives an empty one; rows with repeated ids stay, each with its text's
    fingerprint. Null ids keep their row but never name a group that has other ids. A very long text is hashed in blocks,
    beside the list of its words. Fingerprints or groups of more than hot_rows rows are joined by broadcast. segments
    go by the number of distinct fingerprints, if not given.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    parts = connected_components(link_edges(nodes.select("fp"), bits, segments or segments_for(nodes.count(), bits), bucket), hot_rows=hot_rows)
    joined = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("c"))
    joined = written(joined, "groups")
    names = written(joined.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "names")
    named = written(joined_by_hot_key(joined.select("c", "fp", "n"), names, "c", "size", hot_rows).select("fp", "component_id", "n"), "named")
    return joined_by_hot_key(prints, named, "fp", "n", hot_rows).select("id", "fp", "component_id")
