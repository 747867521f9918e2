"""Near copies: SimHash links by pigeonring filtering, then links by the words themselves, at Jaccard similarity 0.8 or more.

Fingerprints are SimHashes over a text's distinct five-word shingles. Those within two bits are linked by simhash's
pigeonring join, which loses no link in buckets of any size. SimHash alone can't find edited copies: at similarity 0.8 two
64-bit fingerprints differ in about 10 bits, which no key of equal bits survives. Their candidates come from
sub-fingerprints, each made of `ROWS` minima of the shingles' hashes: one is shared with probability 0.8 ** 3, and none of
all 20 with less than 1e-6. Candidates of fitting sizes whose whole fingerprints differ in at most `BITS_APART` bits are
confirmed by the exact similarity of their shingle sets.

A bucket of up to `bucket` texts is compared pair by pair. In a larger one all are compared with one text, another one for
each key; after that, one text for each group so formed is compared again the same way, until nothing is found. What is
left in the larger buckets belongs to different groups: there, every text outside a bucket's largest group is compared with
every text of other groups, so no link between candidates is lost. That is done in blocks of texts, whose shingles lie side
by side in one task: no pair becomes a row, only links do. Its comparisons, though cheap, grow with the square of a bucket
in which few texts are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm import simhash
from turnloom.llm.common import HOT_ROWS, joined_by_hot_key, small_or_plain, written
from turnloom.llm.graph import connected_components

KEYS, ROWS = 20, 3
#: Texts at similarity 0.8 lie beyond this with a probability of about 1e-6.
BITS_APART = 28
_BLOCK = 4096
#: Texts of a block of a large bucket, and bytes of their shingles.
_CROWD_TEXTS, _CROWD_BYTES = 512, 8 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEEDS, _FACTORS = np.random.default_rng(42).integers(0, 1 << 64, size=(2, KEYS * ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # as in simhash.fingerprint


def shingles(tokens: list[bytes], shingle: int = 5) -> np.ndarray:
    """The distinct hashes of all runs of `shingle` words, ascending; fewer words are one run."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - shingle + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        h = (h ^ w[i : i + n]) * _PRIME
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """The 64-bit fingerprint of a set of hashes, and its KEYS sub-fingerprints."""
    ones = np.zeros(64, dtype=np.int64)
    least = np.full(KEYS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part ^ _SEEDS) * _FACTORS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(KEYS)]
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"), keys


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, node, n, fp, keys): h tells texts apart, node texts that differ in more than case and white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                tokens = _words(text)
                h = shingles(tokens)
                fp, k = _sketch(h)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(tokens), 42))
                sizes.append(len(h))
                fps.append(fp)
                keys.append(k)
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            every = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * KEYS), pa.array(signed(keys).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signed(nodes)), pa.array(sizes, pa.int64()), pa.array(signed(fps)), every], names=["id", "h", "node", "n", "fp", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, "id long, h long, node long, n long, fp long, keys array<long>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


@lru_cache(maxsize=64)
def _set_of(text: bytes) -> np.ndarray:
    return shingles(_words(text))


def similarity(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' shingle sets."""
    x, y = _set_of(a), _set_of(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def _texts(asked: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, t): one text of each node asked for."""
    asked = written(nodes.join(asked, "node", "left_semi").select("node", F.col("one.id").alias("__id"), F.col("one.h").alias("__h")), "asked")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_hash(text_col) == F.col("__h"))
    texts = docs.join(small_or_plain(asked, asked.count()), same).select("node", F.col(text_col).cast("binary").alias("t"))
    return written(texts.dropDuplicates(["node"]), "texts")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more. Only texts that stand in a pair are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, either = similarity(x, y)
                keep.append(5 * both >= 4 * either)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(asked, nodes, docs, id_col, text_col)
    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fits(x: str, y: str) -> Column:
    sizes = 5 * F.least(f"{x}.n", f"{y}.n") >= 4 * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= BITS_APART)


def _pair() -> list[Column]:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _simhash_links(nodes: DataFrame, hot_rows: int) -> DataFrame:
    """(a, b) that connect all nodes whose fingerprints link within two bits: one node of each fingerprint with the
    others, and those of linked fingerprints."""
    of = written(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("rows")), "fps")
    links = simhash.link_edges(of.select("fp"), segments=simhash.segments_for(of.count()))
    name = lambda c: of.select(F.col("fp").alias(f"{c}_"), F.col("a").alias(f"{c}_node"))
    across = links.join(name("a"), F.col("a") == F.col("a_")).join(name("b"), F.col("b") == F.col("b_"))
    same = joined_by_hot_key(nodes.select("fp", "node"), of.filter("rows > 1"), "fp", "rows", hot_rows).filter("node <> a").select("a", F.col("node").alias("b"))
    return across.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).union(same)


def _block_links(block: pa.Table) -> pa.Table:
    """(a, b): of every outsider (side 0) a link to each other group that it has one to, among the block's members (side
    1). A pair that shares several keys is compared under the first one."""
    side = block["side"].to_numpy()
    slot = int(block["slot"][0].as_py())
    column = lambda c, t: t[c].to_numpy()
    x, y = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
    a, b = [], []
    if x.num_rows and y.num_rows:
        xs, ys = ([np.frombuffer(v, dtype=np.uint64) for v in t["set"].to_pylist()] for t in (x, y))
        xk, yk = (np.array(t["many"].to_pylist(), dtype=np.int64) for t in (x, y))
        xn, yn, xg, yg, xf, yf = (column(c, t) for c in ("n", "g", "fp") for t in (x, y))
        names, flat = np.unique(np.concatenate(ys), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(v) for v in ys])[:-1]])
        for i, h in enumerate(xs):
            fits = (yg != xg[i]) & (5 * np.minimum(xn[i], yn) >= 4 * np.maximum(xn[i], yn)) & (np.bitwise_count((xf[i] ^ yf).view(np.uint64)) <= BITS_APART)
            if fits.any():
                shared = (yk == xk[i]) & (xk[i] != 0)
                fits &= shared.argmax(axis=1) == slot
            if fits.any():
                mark = np.zeros(len(names), dtype=bool)
                at = np.searchsorted(names, h)
                at[at == len(names)] = 0
                mark[at[names[at] == h]] = True
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                linked = np.flatnonzero(fits & (5 * both >= 4 * (xn[i] + yn - both)))
                for j in linked[np.unique(yg[linked], return_index=True)[1]]:
                    a.append(x["node"][i].as_py())
                    b.append(y["node"][int(j)].as_py())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(crowds: DataFrame, parts: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join all groups between which there are some in the buckets of crowds, (k, slot, node, n)."""
    of = parts.select(F.col("node").alias("node_"), "component")
    grouped = crowds.join(of, F.col("node") == F.col("node_"), "left").select("k", "slot", "node", "n", F.coalesce("component", "node").alias("g"))
    grouped = written(grouped, "grouped")
    sizes = grouped.groupBy("k", "g").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mains = sizes.groupBy("k").agg(F.max_by(F.struct("g", "c", "s"), F.struct("c", "g")).alias("m"), F.count("*").alias("groups"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda rows, hashes: F.greatest(F.ceil(rows / _CROWD_TEXTS), F.ceil(8 * hashes / _CROWD_BYTES)).cast("int")
    mains = mains.filter("groups > 1").select("k", F.col("m.g").alias("main"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("nx"), blocks(F.col("c"), F.col("s")).alias("ny"))
    mains = written(mains, "mains")
    mixed = written(grouped.join(small_or_plain(mains, mains.count()), "k").drop("n"), "mixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_words(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    sets = _texts(mixed.select("node").distinct(), nodes, docs, id_col, text_col).mapInArrow(run, "node long, set binary")
    by_slot = lambda m: F.transform(F.sequence(F.lit(0), F.lit(KEYS - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long")))
    keyed = mixed.groupBy("node").agg(by_slot(F.map_from_entries(F.collect_list(F.struct("slot", "k")))).alias("many"))
    sets = written(sets.join(keyed, "node").join(nodes.select("node", "n", "fp"), "node"), "sets")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["k", "slot", "node", "g"]
    x = mixed.filter("g <> main").select(*kept, F.lit(0).alias("side"), mine("nx").alias("i"), upto("ny").alias("j"))
    y = mixed.select(*kept, F.lit(1).alias("side"), upto("nx").alias("i"), mine("ny").alias("j"))
    return x.unionByName(y).join(sets, "node").groupBy("k", "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: id, h (xxhash64 of its text), component_id, the smallest id its links of either kind reach, and first:
    whether id and h are those of the one text that stands for the group.

    Texts that differ only in case or white space are one node. Texts without words are alike; null counts as empty; an
    empty table gives an empty one. Null ids keep their row but never name a group that has other ids. Of a very long
    text the hashes of its shingles are held. Texts or groups of more than hot_rows rows are joined by broadcast.
    """
    prints = written(_prints(docs, id_col, text_col), "prints")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "keys")]
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("one")
    nodes = written(prints.groupBy("node").agg(one, F.count("*").alias("rows"), *firsts), "nodes")
    open_ = nodes.select("node", "n", "fp", F.posexplode("keys").alias("slot", "k"))
    edges, turn, crowds = written(_simhash_links(nodes, hot_rows), "links"), 0, None
    while True:
        open_ = written(open_, "keys")
        sizes = open_.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1")
        live = written(open_.join(sizes, "k"), "buckets")
        few, many = live.filter(F.col("c") <= bucket), live.filter(F.col("c") > bucket)
        x, y = few.alias("x"), few.alias("y")
        pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node")) & _fits("x", "y")).select(*_pair())
        large = many.select("k").distinct().count()
        if large:
            lead = many.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", "k", F.lit(turn)).alias("o"), "node", "n", "fp")).alias("l"))
            lead = small_or_plain(lead.select(F.col("k").alias("k_"), "l.node", "l.n", "l.fp"), large).alias("x")
            hung = lead.join(many.alias("y"), (F.col("x.k_") == F.col("y.k")) & (F.col("x.node") != F.col("y.node")) & _fits("x", "y"))
            pairs = pairs.union(hung.select(*_pair()))
        pairs = written(pairs.distinct(), "pairs")
        new = written(_confirmed(pairs, nodes, docs, id_col, text_col), "links")
        edges = edges.union(new)
        if large and crowds is None:
            crowds = many.select("k", "slot", "node", "n")
        parts = connected_components(edges, hot_rows=hot_rows)
        if not large or turn and not new.limit(1).count():
            break
        # one text for each group goes on, and only in the buckets that weren't compared pair by pair
        gone = parts.filter("node <> component").select("node")
        open_ = many.select("node", "n", "fp", "slot", "k").join(gone, "node", "left_anti")
        turn += 1
    if crowds is not None:
        new = written(_across(crowds, parts, nodes, docs, id_col, text_col), "links")
        if new.limit(1).count():
            parts = connected_components(edges.union(new), hot_rows=hot_rows)
    joined = nodes.select("node", "one", "rows").join(parts.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    joined = written(joined.select("node", "one", "rows", F.coalesce("component", "node").alias("c")), "groups")
    names = written(joined.groupBy("c").agg(F.min("one").alias("first"), F.count("*").alias("size")), "names")
    named = joined_by_hot_key(joined.select("c", "node", "rows"), names, "c", "size", hot_rows)
    named = written(named.select("node", F.col("first.id").alias("component_id"), F.col("first.h").alias("first_h"), "rows"), "named")
    first = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first_h"))
    return joined_by_hot_key(prints.select("id", "h", "node"), named, "node", "rows", hot_rows).select("id", "h", "component_id", first.alias("first"))
