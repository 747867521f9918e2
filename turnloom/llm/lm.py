"""Trigram language model as a weighted backoff automaton, learned from and applied to whole tables.

States are the contexts seen in training: every pair of words, every word (the start among them), and the root. State h
has an arc for every word w that followed it, weighing log10 p(w | h) and leading to the longest suffix of hw that is a
state, and one failure arc to the state of its suffix, weighing log10 of mu / (c(h) + mu); the root has an arc for every
known word, weighing log10 P(w), and one for all unknown words together, which leads back to it. Here p(w | h) =
(c(h,w) + mu p(w | suffix of h)) / (c(h) + mu), with one mu for each length of h, and P is absolutely discounted:
(c(w) - D) / N, which leaves D V / N for the unknown. Reading a token takes its arc, or failure arcs until a state has
one; so the weights along a text add up to the log10 of its probability, and the probabilities of all next tokens add
up to one in every state. One pass from left to right carries the state and adds up the weights.

No table of n-grams reaches the driver or every task. Rows are dealt by their number into chunks of bounded size, and a
chunk's tokens are shuffled once, as numbers into its list of words. A chunk asks for exactly the n-grams that occur in
it: sorted keys with its own training counts, as one block for each range of keys. The task of a range adds up all
chunks' counts and answers each with the totals in the order of its keys, which gives the chunk the slice of the
automaton that its texts can reach. Where the ranges that bounded tasks need are more than `fan`, blocks of a range
are merged over groups of chunks first and split again, level by level, so that blocks grow with the table, not with
the square of the chunks.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import written

#: Stands for the token that ends a text and, as a state, for its start; no word holds white space.
_EDGE = b" "
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: Keys, repeated ones included, that the task of a range may hold.
_RANGE_KEYS = 4_000_000
#: n-grams to a byte of text, about.
_NGRAMS = 0.3


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (left ^ (right * _PAIR)) * _PAIR
    x ^= x >> np.uint64(29)
    x = (x + right) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _coded(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that the planes of zeros nearly vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _decoded(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def key_bits(n_bytes: int) -> int:
    """Bits of a key: so many that some wrong one of a table's n-grams matches it with a probability of 2 ** -26 at most."""
    return min(63, 26 + max(1, int(n_bytes * _NGRAMS)).bit_length())


class Chunk:
    """Some texts as numbers into the list of their words, each text ended by the word _EDGE.

    words and, after number(), pairs and triples are the distinct n-grams in ascending order of their numbers.
    """

    def __init__(self, local: np.ndarray, starts: np.ndarray, hashes: np.ndarray, edge: int, training: np.ndarray) -> None:
        self.local, self.starts, self.hashes, self.edge, self.training = local, starts, hashes, edge, training

    @classmethod
    def of(cls, doc_ids: list, texts: list, folds: int) -> Chunk:
        tokens: list[bytes] = []
        ends = []
        for t in texts:
            tokens += t.lower().split() if t else []
            tokens.append(_EDGE)
            ends.append(len(tokens))
        number = dict.fromkeys(tokens)
        number.update(zip(number, range(len(number)), strict=True))
        local = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
        starts = np.array([0, *ends[:-1]], dtype=np.int64)
        return cls(local, starts, hashes, number[_EDGE], np.array([not held_out(d, folds) for d in doc_ids], dtype=bool))

    def dump(self) -> bytes:
        parts = [_coded(self.local.astype(np.uint32)), _coded(np.diff(self.starts).astype(np.uint32)), self.hashes.tobytes(), self.training.tobytes(), self.edge.to_bytes(4, "little")]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, blob: bytes) -> Chunk:
        parts, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 8], "little")
            parts.append(blob[at + 8 : at + 8 + n])
            at += 8 + n
        local, lengths = _decoded(parts[0], np.uint32).astype(np.int64), _decoded(parts[1], np.uint32).astype(np.int64)
        return cls(local, np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(parts[2], dtype=np.uint64), int.from_bytes(parts[4], "little"), np.frombuffer(parts[3], dtype=bool))

    def number(self) -> None:
        """Number the n-grams: word, pair and triple that end at each token. The first token's pair begins with _EDGE and
        it has no triple (-1); a pair is (word, word), a triple (number of its pair, word)."""
        n, w = len(self.local), len(self.hashes)
        before = np.roll(self.local, 1)
        before[self.starts] = self.edge
        self.pairs, self.pair_at = np.unique(before * w + self.local, return_inverse=True)
        self.later = np.ones(n, dtype=bool)
        self.later[self.starts] = False
        code = np.roll(self.pair_at, 1) * w + self.local
        self.triples, at = np.unique(code[self.later], return_inverse=True)
        self.triple_at = np.full(n, -1, dtype=np.int64)
        self.triple_at[self.later] = at

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, order): ascending keys of all n-grams, words marked by their lowest bit, and the place of each among
        words, pairs and triples laid end to end."""
        w = len(self.hashes)
        left, right = np.divmod(self.pairs, w)
        pair = _mixed(self.hashes[left], self.hashes[right])
        left, right = np.divmod(self.triples, w)
        triple = _mixed(pair[left] ^ _PAIR, self.hashes[right])
        cut = lambda x, last: (x >> np.uint64(64 - bits)) << _ONE | np.uint64(last)
        keys = np.concatenate([cut(self.hashes, 1), cut(pair, 0), cut(triple, 0)])
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def counts(self) -> np.ndarray:
        """Training counts of words, pairs and triples, laid end to end."""
        lengths = np.diff(np.append(self.starts, len(self.local)))
        learned = np.repeat(self.training, lengths)
        parts = (self.local[learned], len(self.hashes)), (self.pair_at[learned], len(self.pairs)), (self.triple_at[learned & self.later], len(self.triples))
        return np.concatenate([np.bincount(at, minlength=n) for at, n in parts]).astype(np.uint32)

    def scores(self, totals: np.ndarray, facts: tuple, mu: tuple[float, float]) -> dict[str, np.ndarray]:
        """Scores of the texts from the corpus totals of words, pairs and triples, laid end to end."""
        w, p = len(self.hashes), len(self.pairs)
        c1, c2, c3 = totals[:w], totals[w : w + p], totals[w + p :]
        n, v, once, twice = facts
        base = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  every text has at least its end
        out = {"n_tokens": np.diff(np.append(self.starts, len(self.local))), "n_known": add((c1 > 0)[self.local].astype(np.int64)), "base_score": add(base[self.local])}
        out["score"] = np.array(list(self._read(self._automaton(c1, c2, c3, n, v, once, twice, mu)))) if n else np.zeros(len(self.starts))
        return out  # with nothing to learn from, all tokens are unknown, the only event there is

    def _automaton(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, n: int, v: int, once: int, twice: int, mu: tuple[float, float]) -> dict[str, array]:
        """The automaton's arcs that this chunk's n-grams can take. States: 0 is the root, 1 + w a word, 1 + W + p a pair.
        Arcs are numbered as the n-grams are; 0.0 stands for no arc, as no probability here is one."""
        w = len(c1)
        d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        p1 = np.where(c1 > 0, c1 - d, d * v) / n
        left, right = np.divmod(self.pairs, w)
        p2 = (c2 + mu[0] * p1[right]) / (c1[left] + mu[0])
        left3, right3 = np.divmod(self.triples, w)
        suffix = np.searchsorted(self.pairs, right[left3] * w + right3)  # the pair that a triple ends in
        p3 = (c3 + mu[1] * p2[suffix]) / (c2[left3] + mu[1])
        state1 = np.where(c1 > 0, 1 + np.arange(w), 0)
        state2 = np.where(c2 > 0, 1 + w + np.arange(len(c2)), 0)  # read only behind arcs, which have counts
        weights = {
            "arc1": np.log10(p1), "arc2": np.where(c2 > 0, np.log10(p2), 0.0), "arc3": np.where(c3 > 0, np.log10(p3), 0.0),
            "fail1": np.log10(mu[0] / (c1 + mu[0])), "fail2": np.log10(mu[1] / (c2 + mu[1])),
        }
        states = {"to1": state1, "to2": state2, "to3": state2[suffix], "back": 1 + right, "start": state1[self.edge : self.edge + 1]}
        return {k: array("d", x.tobytes()) for k, x in weights.items()} | {k: array("i", x.astype(np.int32).tobytes()) for k, x in states.items()}

    def _read(self, a: dict[str, array]) -> Iterator[float]:
        """The log10 of each text's probability: one pass from left to right that carries the state."""
        arc1, to1, arc2, to2, arc3, to3, fail1, fail2, back = (a[k] for k in ("arc1", "to1", "arc2", "to2", "arc3", "to3", "fail1", "fail2", "back"))
        w = len(arc1)
        ends = [*self.starts[1:].tolist(), len(self.local)]
        for at, end in zip(self.starts.tolist(), ends, strict=True):
            state, score = a["start"][0], 0.0
            for word, pair, triple in zip(self.local[at:end].tolist(), self.pair_at[at:end].tolist(), self.triple_at[at:end].tolist(), strict=True):
                if state > w:  # a pair
                    if weight := arc3[triple]:
                        score += weight
                        state = to3[triple]
                        continue
                    score += fail2[state - w - 1]
                    state = back[state - w - 1]
                if state:  # a word
                    if weight := arc2[pair]:
                        score += weight
                        state = to2[pair]
                        continue
                    score += fail1[state - 1]
                score += arc1[word]
                state = to1[word]
            yield score


def _split(keys: np.ndarray, counts: np.ndarray, bits: int, parts: int, before: int = 1, within: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, keys, counts) for every one of `parts` ranges, of which there are `before` * parts in all; keys ascend and
    lie in range `within` of the `before`. Empty ranges are told, too."""
    bounds = [(i << (bits + 1)) // (before * parts) for i in range(within * parts, (within + 1) * parts)]
    cuts = [*np.searchsorted(keys, np.array(bounds, dtype=np.uint64)).tolist(), len(keys)]
    for i in range(parts):
        k = keys[cuts[i] : cuts[i + 1]]
        yield within * parts + i, _coded(np.diff(k, prepend=np.uint64(0))), _coded(counts[cuts[i] : cuts[i + 1]])


def _summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of all blocks, the sums of their counts, and the places of each block's keys among them."""
    keys = [np.cumsum(_decoded(b, np.uint64)) for b in t["keys"].to_pylist()]
    counts = np.concatenate([_decoded(b, np.uint64) for b in t["counts"].to_pylist()])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, weights=counts, minlength=len(every)).astype(np.uint64), np.split(at, np.cumsum([len(k) for k in keys])[:-1])


_ASKED = "node long, part long, keys binary, counts binary"
_TOLD = "node long, part long, totals binary, n long, v long, once long, twice long"


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


def _told(asked: DataFrame, nodes: int, bits: int, before: int, ranges: int, fan: int) -> DataFrame:
    """(node, part, totals, facts of words): the corpus totals for every block of asked, whose parts are `before` ranges,
    in the order of its keys. `ranges` are wanted."""

    def answer(t: pa.Table) -> pa.Table:
        every, sums, places = _summed(t)
        words = sums[(every & _ONE) == _ONE]
        facts = int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())
        return _table([(n, p, _coded(sums[at]), *facts) for n, p, at in zip(t["node"].to_pylist(), t["part"].to_pylist(), places, strict=True)], _TOLD)

    if before >= ranges:
        return asked.groupBy("part").applyInArrow(answer, _TOLD)
    groups, finer = max(1, math.ceil(nodes / fan)), min(fan, math.ceil(ranges / before))
    grouped = written(asked, "asked").withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("long"))

    def merge(t: pa.Table) -> pa.Table:
        every, sums, _ = _summed(t)
        group = t["group"][0].as_py()
        return _table([(group, *r) for r in _split(every, sums, bits, finer, before, t["part"][0].as_py())], _ASKED)

    def spread(t: pa.Table, told: pa.Table) -> pa.Table:
        _, _, places = _summed(t)
        told = told.sort_by("part")
        totals = np.concatenate([_decoded(b, np.uint64) for b in told["totals"].to_pylist()])
        facts = [sum(told[c].to_pylist()) for c in ("n", "v", "once", "twice")]
        return _table([(n, p, _coded(totals[at]), *facts) for n, p, at in zip(t["node"].to_pylist(), t["part"].to_pylist(), places, strict=True)], _TOLD)

    merged = grouped.groupBy("part", "group").applyInArrow(merge, _ASKED)
    told = _told(merged, groups, bits, before * finer, ranges, fan)
    told = told.select(F.col("node").alias("group"), *told.columns[1:], F.floor(F.col("part") / finer).cast("long").alias("above"))
    return grouped.groupBy("part", "group").cogroup(told.groupBy("above", "group")).applyInArrow(spread, _TOLD)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, mu: tuple[float, float] = (50.0, 10.0),
    chunk_bytes: int = 6_000_000, range_keys: int = _RANGE_KEYS, fan: int = 4096,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone; repeated rows count and score each, and are dealt by their number, so
    they don't meet in one chunk; with no training documents every token is unknown and scores 0; an empty table gives an
    empty one. A chunk holds about chunk_bytes of text; a longer text is split between tasks nowhere, so it needs
    memory in proportion to itself. mu are the pseudo-counts of contexts of one and of two words.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    size = total["b"] + 16 * total["n"]
    chunks, bits = max(1, math.ceil(size / chunk_bytes)), key_bits(size)
    ranges = max(8, math.ceil(size * _NGRAMS / range_keys))  # so a range has as many keys at any size of the table

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            c = Chunk.of(ids, texts, folds)
            return pa.RecordBatch.from_arrays([pa.array([pa.array(ids, pa.int64()).to_pylist()], pa.list_(pa.int64())), pa.array([c.dump()], pa.binary())], names=["ids", "texts"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i), texts.append(t)
                held += 16 + len(t or b"")
                if held >= chunk_bytes:
                    yield chunk()
                    ids, texts, held = [], [], 0
        if ids:
            yield chunk()

    named = slim.mapInArrow(coded, "ids array<long>, texts binary").withColumn("node", F.monotonically_increasing_id())

    def ask(t: pa.Table) -> pa.Table:
        c = Chunk.load(t["texts"][0].as_py())
        c.number()
        keys, order = c.keys(bits)
        keys, first = np.unique(keys, return_index=True)
        counts = np.add.reduceat(c.counts()[order], first).astype(np.uint64)
        return _table([(t["node"][0].as_py(), *r) for r in _split(keys, counts, bits, min(ranges, fan))], _ASKED)

    def score(t: pa.Table, told: pa.Table) -> pa.Table:
        ids, c = t["ids"][0].as_py(), Chunk.load(t["texts"][0].as_py())
        c.number()
        keys, order = c.keys(bits)
        told = told.sort_by("part")
        distinct, at = np.unique(keys, return_inverse=True)
        found = np.concatenate([_decoded(b, np.uint64) for b in told["totals"].to_pylist()]).astype(np.int64)
        if len(found) != len(distinct):
            raise RuntimeError("a chunk's answers aren't those to its questions")
        totals = np.empty(len(keys), dtype=np.int64)
        totals[order] = found[at]
        facts = tuple(sum(told[k].to_pylist()) for k in ("n", "v", "once", "twice"))
        out = c.scores(totals, facts, mu)
        cols = [pa.array(ids, pa.int64()), pa.array(~c.training), pa.array(out["n_tokens"]), pa.array(out["n_known"]), pa.array([facts[0]] * len(ids), pa.int64()), pa.array(out["base_score"]), pa.array(out["score"])]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = named.groupBy("node").applyInArrow(ask, _ASKED)
    told = _told(asked, chunks, bits, min(ranges, fan), ranges, fan)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return named.groupBy("node").cogroup(told.groupBy("node")).applyInArrow(score, kind)
