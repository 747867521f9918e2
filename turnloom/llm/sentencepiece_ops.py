"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

All segmentations of a text form a lattice whose paths weigh the product of their pieces' weights. Perturbing every
path's log-probability with a Gumbel and taking the k largest gives k distinct paths, drawn without replacement. A-star
search finds them without listing paths: a region of the lattice is known by its total mass, which fixes the law of
its largest perturbed value, and the region with the largest is opened next. Opening one draws its best path; what is
left of the region falls into parts, one for each place where a path may leave the drawn one, each with its own largest
value, bounded by that of the region it came from.

Pieces never cross the start of a word, so a text's lattice is a chain of word lattices, and regions are "as this path
up to word i, other there". One backward pass per distinct word gives the masses; draws for many texts run together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
#: A word with the white space marks before it; every piece lies inside one.
_WORD = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
#: Words of texts that are drawn together.
_BLOCK_WORDS = 1_100_000
#: The same where their ids are kept and read back.
_CHECKED_WORDS = 400_000
#: Edges of the words' lattices that a worker process keeps from block to block, 16 bytes each.
_KEPT_EDGES = 4_000_000
#: Slots of a table of pieces, as a power of two.
_SLOT_BITS = 19
#: log weight of one character that no piece has; it becomes its UTF-8 bytes' pieces.
_UNKNOWN = -20.0
_GOLDEN = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the model's own best segmentation of every whole text. Null text gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [None if t is None else _processor(model_path).encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from ids, of any segmentation. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else Lattice.of(model_path).text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


class Lattice:
    """A model's pieces with weights, and the lattices of words.

    The models' scores are ranks for byte-pair merging, not probabilities; a piece weighs (2 + rank) ** -alpha.
    """

    def __init__(self, path: str, alpha: float) -> None:
        sp = _processor(path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(self.pieces[i][3:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.special = [sp.is_control(i) or sp.is_unknown(i) for i in range(len(self.pieces))]
        use = [i for i in range(len(self.pieces)) if not (self.special[i] or sp.is_byte(i))]
        self.id_of = {self.pieces[i]: i for i in use}
        self.log_weight = np.full(len(self.pieces), _UNKNOWN)
        self.log_weight[use] = [-alpha * np.log(2 - sp.get_score(i)) for i in use]
        #: What stands for a character of one byte that no piece has.
        self.single = np.array([self.byte_ids.get(i, -1 - i) for i in range(128)], dtype=np.int64)
        heads = {p[:n] for p in self.id_of for n in range(1, len(p))}
        self.longest = max(map(len, self.id_of), default=1)
        self.tables = _tables({s: (self.id_of.get(s, -1), s in heads) for s in heads | self.id_of.keys()})
        self.bytes_of = [b"" if self.special[i] else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        self.bytes_array = pa.array(self.bytes_of, pa.large_binary())
        #: Numbers of the words that are kept; their lattices; how many ids the first of them have, and these.
        self.kept: dict[str, int] = {}
        self.kept_words = _connected(self, [])
        self.kept_ids = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str, alpha: float = 1.0) -> Lattice:
        """One for a worker process, over all its tasks."""
        return Lattice(path, alpha)

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the mark that the model puts before the text and for every space."""
        if not text:
            return []
        if "  " in text or _SPACE in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(_SPACE + text.replace(" ", _SPACE))]
        return text.split(" ")

    def split(self, texts: pa.Array) -> pa.ListArray:
        """words() of every text."""
        made = pc.split_pattern(texts, " ")
        others = np.flatnonzero(~_plain(texts))
        if len(others):
            own = pa.array([self.words(t) for t in texts.take(pa.array(others)).to_pylist()], made.type)
            order = np.arange(len(texts))
            order[others] = len(texts) + np.arange(len(others))
            made = pa.concat_arrays([made, own]).take(pa.array(order))
        return made

    def connected(self, words: list[str]) -> tuple[np.ndarray, Words, list[str]]:
        """(number of each of these different words, lattices by number, the words that are not kept). As many are kept
        for later as there is room for; a word's numbers are the same either way."""
        kind = np.fromiter((self.kept.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(kind < 0)
        kind[new] = len(self.kept) + np.arange(len(new))
        names = [words[i] for i in new.tolist()]
        made = self.kept_words.beside(_connected(self, [_SPACE + w for w in names]))
        if names and len(made.piece) <= _KEPT_EDGES:
            self.kept.update(zip(names, range(len(self.kept), len(self.kept) + len(names)), strict=True))
            self.kept_words = made
        return kind, made, names

    def same(self, ids: pa.Array, cuts: np.ndarray, texts: list[str], raw: list[bytes]) -> list[bool]:
        """Whether text() makes each of the texts, given in UTF-8 too, of its ids between two cuts."""
        said = self.bytes_array.take(ids)
        at, data = said.buffers()[1:]
        ends = np.frombuffer(at, dtype=np.int64)[cuts].tolist() if len(ids) else [0] * len(cuts)
        data = memoryview(data or b"")
        parts = (data[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True))
        return [p == b" " + r or p.decode("utf-8", "replace").removeprefix(" ") == t for p, r, t in zip(parts, raw, texts, strict=True)]

    def logs(self, pieces: np.ndarray) -> np.ndarray:
        return self.log_weight.take(pieces, mode="clip")  # what is no piece weighs as the unknown one, the first

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece or -1, whether longer pieces begin so) of strings by their hash."""
        keys, pieces, ons, factor = self.tables[0]
        slot = ((h * factor) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        there = keys[slot]
        hit = there == h
        piece, on = np.where(hit, pieces[slot], np.int32(-1)), hit & ons[slot]
        clash = np.flatnonzero(~hit & (there != 0))  # only behind a slot taken by another can there be more
        for keys, pieces, ons, factor in self.tables[1:]:
            slot = ((h[clash] * factor) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            there = keys[slot]
            hit = there == h[clash]
            piece[clash[hit]], on[clash[hit]] = pieces[slot[hit]], ons[slot[hit]]
            clash = clash[~hit & (there != 0)]
        return piece, on


def _plain(texts: pa.Array) -> np.ndarray:
    """Whether a text's words are what stands between single spaces."""
    other = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, _SPACE)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    return pc.and_not(pc.greater(pc.binary_length(texts), 0), other).to_numpy(zero_copy_only=False)


def _hash_on(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of strings one character longer."""
    with np.errstate(over="ignore"):
        x = (h + codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)
        return x ^ (x >> np.uint64(32))


def _tables(known: dict[str, tuple[int, bool]]) -> list[tuple]:
    """Direct-address tables by hash; what finds its slot taken goes to the next table."""
    hashes, values = [], list(known.values())
    for s in known:
        h = np.zeros(1, dtype=np.uint64)
        for c in s:
            h = _hash_on(h, np.array([ord(c)]))
        hashes.append(h[0])
    h, piece, on = np.array(hashes, dtype=np.uint64), np.array([v[0] for v in values], dtype=np.int32), np.array([v[1] for v in values], dtype=bool)
    out, left, factor = [], np.arange(len(h)), 0xD6E8FEB86659FD93
    while len(left):
        keys, pieces, ons = np.zeros(1 << _SLOT_BITS, dtype=np.uint64), np.full(1 << _SLOT_BITS, -1, dtype=np.int32), np.zeros(1 << _SLOT_BITS, dtype=bool)
        with np.errstate(over="ignore"):
            slot = ((h[left] * np.uint64(factor)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        slots, first = np.unique(slot, return_index=True)
        own = left[first]
        keys[slots], pieces[slots], ons[slots] = h[own], piece[own], on[own]
        out.append((keys, pieces, ons, np.uint64(factor)))
        left = np.setdiff1d(left, own)
        factor = (factor * _GOLDEN | 1) % (1 << 64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(seeds: np.ndarray, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(seeds + np.uint64(stream * _GOLDEN % (1 << 64)))


def _spread(seeded: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = _mixed(seeded + np.asarray(place).astype(np.uint64) * np.uint64(_GOLDEN))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform(seeds: np.ndarray, stream: int, place: np.ndarray | int) -> np.ndarray:
    """Uniform in (0, 1) from the row's seed, a stream and a place in it; the same however rows are batched."""
    return _spread(_seeded(seeds, stream), place)


class Words(NamedTuple):
    """The lattices of different words side by side: a node for each character and one behind each word; edges by node,
    longest piece first, with their share of the node's mass, summed up; and every node's log mass."""

    length: np.ndarray
    node: np.ndarray
    edge_start: np.ndarray
    piece: np.ndarray
    target: np.ndarray
    cum: np.ndarray
    mass: np.ndarray
    log_mass: np.ndarray
    only: np.ndarray

    def beside(self, more: Words) -> Words:
        """These, then those."""
        if not len(self.length) or not len(more.length):
            return self if len(self.length) else more
        nodes, edges = np.int32(len(self.mass)), np.int32(len(self.piece))
        shifted = more._replace(node=more.node + nodes, target=more.target + nodes, edge_start=more.edge_start + edges)
        return Words(*map(np.concatenate, zip(self._replace(edge_start=self.edge_start[:-1]), shifted, strict=True)))


def _connected(lattice: Lattice, kinds: list[str]) -> Words:
    """The lattices of words, each with the mark before it."""
    look = lattice.lookup
    length = np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds))
    codes = np.frombuffer("".join(kinds).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = np.repeat(np.arange(len(kinds), dtype=np.int32), length)
    node = np.cumsum(length + 1) - (length + 1)
    char = np.arange(len(codes), dtype=np.int32)
    ends = np.cumsum(length).astype(np.int32)[word]
    h = np.zeros(len(codes), dtype=np.uint64)
    found: list[tuple] = []
    for n in range(1, lattice.longest + 1):
        if n > 1:
            on = on & (char + n <= ends[char])
            char, h = char[on], h[on]
        if not len(char):
            break
        h = _hash_on(h, codes[char + n - 1])
        piece, on = look(h)
        if n == 1:  # any one character can stand alone
            alone = np.where(codes < 128, lattice.single[np.minimum(codes, 127)], -1 - codes.astype(np.int64))
            piece = np.where(piece >= 0, piece, alone).astype(np.int32)
            found.append((char, piece, n))
        else:
            hit = piece >= 0
            found.append((char[hit], piece[hit], n))
    per = np.zeros(len(codes), dtype=np.int32)
    for chars, _, _ in found:
        per[chars] += 1  # a character has one piece of a length at most
    spot = np.cumsum(per, dtype=np.int32) - per
    size = int(per.sum())
    char, pieces, target = (np.empty(size, dtype=np.int32) for _ in range(3))
    for chars, piece, n in reversed(found):
        here = spot[chars]
        spot[chars] += 1
        char[here], pieces[here], target[here] = chars, piece, chars + word[chars] + n
    source = char + word[char]
    nodes = len(codes) + len(kinds)
    edge_start = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=nodes))]).astype(np.int32)
    left = ends[char] - char
    longest = int(length.max(initial=0))
    by_left = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")  # short keys sort by radix
    cuts = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=longest + 1)[1:])])
    log = lattice.logs(pieces)
    mass = np.zeros(nodes)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):  # from the words' ends to their starts
        e = by_left[a:z]
        own = source[e]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        mass[own[heads]] = np.logaddexp.reduceat(log[e] + mass[target[e]], heads)
    # summed up node by node, so that a word's numbers don't depend on what else is in the block
    cum = np.exp(log + mass[target] - mass[source])
    degree, rank = np.diff(edge_start), 1
    more = np.flatnonzero(degree > 1)
    while len(more):
        e = edge_start[more] + rank
        cum[e] += cum[e - 1]
        rank += 1
        more = more[degree[more] > rank]
    several = np.diff(edge_start) > 1
    reach = np.concatenate([[0], np.cumsum(several)])
    return Words(length, node, edge_start, pieces, target, cum, mass, mass[node], reach[node + length] == reach[node])


class Block:
    """Texts whose words are drawn together."""

    def __init__(self, lattice: Lattice, seeds: list[int], texts: list[list[str]] | pa.ListArray) -> None:
        self.lattice = lattice
        lists = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.string()))
        self.counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.seeds = np.array(seeds, dtype=np.uint64)
        every = lists.flatten().dictionary_encode()
        number, words, self.names = lattice.connected(every.dictionary.to_pylist())
        self.kind = number[every.indices.to_numpy()]
        self.length, self.node, self.edge_start, self.piece, self.target, self.cum, self.mass, self.log_mass, self.only = words
        self.place = np.arange(len(every)) - self.starts[self.owner] if len(every) else np.zeros(0, dtype=np.int64)

    def draw(self, which: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probability by word of `which`, then its pieces: word and piece, in order) of a fresh path each."""
        kind = self.kind[which]
        node, last = self.node[kind], self.node[kind] + self.length[kind]
        logs = -self.log_mass[kind]
        active = np.arange(len(which))
        words, pieces = [], []
        seeds = _seeded(self.seeds[self.owner[which]] + (self.place[which].astype(np.uint64) << np.uint64(20)), stream)
        step = 0
        while len(active):
            edge = self.edge_start[node]
            u = _spread(seeds[active], step)
            more = np.flatnonzero((u > self.cum[edge]) & (edge + 1 < self.edge_start[node + 1]))
            while len(more):
                edge[more] += 1
                e = edge[more]
                more = more[(u[more] > self.cum[e]) & (e + 1 < self.edge_start[node[more] + 1])]
            piece = self.piece[edge]
            logs[active] += self.lattice.logs(piece)
            words.append(active), pieces.append(piece)
            node = self.target[edge]
            on = node < last[active]
            active, node = active[on], node[on]
            step += 1
        per = np.zeros(len(which), dtype=np.int64)
        for w in words:
            per[w] += 1
        spot, out = np.cumsum(per) - per, np.empty(int(per.sum()), dtype=np.int32)
        for w, p in zip(words, pieces, strict=True):
            out[spot[w]] = p
            spot[w] += 1
        return logs, np.repeat(which, per), out

    def other(self, word: int, taken: list[list[int]], u: np.ndarray) -> list[int]:
        """The pieces of a path through one word that isn't among `taken`, drawn in proportion."""
        exits = self._exits(word, taken)
        at = np.searchsorted(np.cumsum([m for _, _, m in exits]), u[0] * sum(m for _, _, m in exits))
        path, edge, _ = exits[min(int(at), len(exits) - 1)]
        last = self.node[self.kind[word]] + self.length[self.kind[word]]
        path = [*path, int(self.piece[edge])]
        while self.target[edge] < last:
            a, z = self.edge_start[self.target[edge]], self.edge_start[self.target[edge] + 1]
            edge = min(a + int(np.searchsorted(self.cum[a:z], u[len(path) % len(u)])), z - 1)
            path.append(int(self.piece[edge]))
        return path

    def left(self, word: int, taken: list[list[int]]) -> float:
        """The share of a word's mass that is on no taken path, added up without cancellation."""
        return float(sum(m for _, _, m in self._exits(word, taken)))

    def _exits(self, word: int, taken: list[list[int]]) -> list[tuple[list[int], int, float]]:
        """(pieces before, edge, share) wherever a path can leave those taken. Shares below 1e-300 count as none."""
        out, todo = [], [([], self.node[self.kind[word]], 1.0, taken)]
        while todo:
            path, node, share, through = todo.pop()
            for e in range(int(self.edge_start[node]), int(self.edge_start[node + 1])):
                on = [t for t in through if t[len(path)] == self.piece[e]]
                here = share * float(np.exp(self._log_of(int(self.piece[e])) + self.mass[self.target[e]] - self.mass[node]))
                if not on:
                    if here > 1e-300:
                        out.append((path, e, here))
                elif len(on[0]) > len(path) + 1:
                    todo.append(([*path, int(self.piece[e])], self.target[e], here, on))
        return out

    def _log_of(self, piece: int) -> float:
        return float(self.lattice.log_weight[piece]) if piece >= 0 else _UNKNOWN

    def sample(self, k: int) -> list[list[tuple[float, float, int]]]:
        """For every text its up to k (log-probability, perturbed value, layer for ids()), best first, and at last the
        first path not taken, if there is one, with layer -1."""
        n, total = len(self.counts), len(self.kind)
        out: list[list] = [[] for _ in range(n)]
        if not total:
            return out
        some = self.counts > 0
        starts = self.starts[some]
        value = np.where(some, -np.log(-np.log(_uniform(self.seeds, 1, 0))), 0.0)
        logs, owner, pieces = self.draw(np.arange(total), 2)
        layers: list[dict] = []
        current = {"logs": logs, "from": np.zeros(n, dtype=np.int64), "live": some.copy(), "owner": owner, "pieces": pieces, "fork": {}, "base": None}
        for rank in range(k):
            for d in np.flatnonzero(current["live"]):
                out[d].append((float(current["logs"][self.starts[d] : self.starts[d] + self.counts[d]].sum()), float(value[d]), rank))
            layers.append(self._opened(current, value, rank))
            best = np.full((len(layers), n), -np.inf)
            for i, layer in enumerate(layers):
                best[i, some] = np.maximum.reduceat(layer["value"], starts)
            winner = best.argmax(axis=0)
            top = best[winner, np.arange(n)]
            live = some & np.isfinite(top)
            value = np.where(live, top, -np.inf)
            if rank + 1 == k:
                for d in np.flatnonzero(live):
                    out[d].append((np.nan, float(value[d]), -1))
                break
            current = self._forked(layers, winner, live, value, rank)
        self.layers = layers
        # a character without a piece is alone on every path
        self.odd = set(self.owner[layers[0]["owner"][layers[0]["pieces"] < 0]].tolist())
        return out

    def _opened(self, path: dict, value: np.ndarray, rank: int) -> dict:
        """The regions that leave a drawn path, one for each word from its fork on, with their largest values."""
        logs = path["logs"]
        before = np.empty_like(logs)
        for a, n in zip(self.starts.tolist(), self.counts.tolist(), strict=True):  # text by text, for the same reason
            before[a : a + n] = np.cumsum(logs[a : a + n]) - logs[a : a + n]
        with np.errstate(divide="ignore"):
            mass = before + np.log(-np.expm1(np.minimum(logs, 0)))
        mass[self.only[self.kind]] = -np.inf
        region = _truncated(mass, value[self.owner], _uniform(self.seeds[self.owner], 16 + 4 * rank, self.place))
        from_ = path["from"][self.owner]
        after = self.place >= from_ if path["base"] is None else self.place > from_  # the fork is the older layer's region
        region[~after | ~path["live"][self.owner] | ~np.isfinite(mass)] = -np.inf
        return {**path, "value": region, "before": before, "taken": {}}

    def _forked(self, layers: list[dict], winner: np.ndarray, live: np.ndarray, value: np.ndarray, rank: int) -> dict:
        """The best path of each text's best region, which shrinks by it."""
        n = len(self.counts)
        fork_at, base = np.zeros(n, dtype=np.int64), winner.copy()
        logs = np.zeros(len(self.kind))
        fork: dict[int, list[int]] = {}
        for d in np.flatnonzero(live):
            s = slice(self.starts[d], self.starts[d] + self.counts[d])
            layer = layers[winner[d]]
            i = int(layer["value"][s].argmax())
            w = int(self.starts[d]) + i
            taken = layer["taken"].setdefault(w, [self._word_pieces(layers, winner[d], w)])
            u = _uniform(np.repeat(self.seeds[d], 64), 17 + 4 * rank, np.arange(64))
            path = self.other(w, taken, u)
            taken.append(path)
            fork[w], fork_at[d] = path, i
            logs[s] = layer["logs"][s]
            logs[w] = sum(map(self._log_of, path)) - self.log_mass[self.kind[w]]
            left = self.left(w, taken)
            left_log = layer["before"][w] + np.log(left) if left > 0 else -np.inf
            u = _uniform(self.seeds[d : d + 1], 18 + 4 * rank, i)[0]
            layer["value"][w] = _truncated(np.array([left_log]), np.array([value[d]]), np.array([u]))[0]
        later = np.flatnonzero(live[self.owner] & (self.place > fork_at[self.owner]))
        fresh, owner, pieces = self.draw(later, 19 + 4 * rank)
        logs[later] = fresh
        return {"logs": logs, "from": fork_at, "live": live, "owner": owner, "pieces": pieces, "fork": fork, "base": base}

    def _word_pieces(self, layers: list[dict], layer: int, w: int) -> list[int]:
        """The pieces that the layer's path has in word w, which it may share with the layer it forked from."""
        at = layers[layer]
        if w in at["fork"]:
            return at["fork"][w]
        a, z = np.searchsorted(at["owner"], [w, w + 1])
        if a < z:
            return at["pieces"][a:z].tolist()
        return self._word_pieces(layers, int(at["base"][self.owner[w]]), w)

    def _parts(self, d: int, layer: int) -> list[np.ndarray]:
        """A text's path as pieces, in parts, of which some are shared with the paths it forked from."""
        first, last = int(self.starts[d]), int(self.starts[d] + self.counts[d])
        parts: list[np.ndarray] = []
        while True:
            at = self.layers[layer]
            own = at["owner"]
            if at["base"] is None:
                a, z = own.searchsorted((first, last))
                parts.append(at["pieces"][a:z])
                return parts[::-1]
            w = first + int(at["from"][d])
            a, z = own.searchsorted((w + 1, last))
            parts += [at["pieces"][a:z], np.array(at["fork"][w], dtype=np.int32)]
            last, layer = w, int(at["base"][d])

    def ids(self, d: int, layer: int) -> list[np.ndarray]:
        """The same as ids, where characters without a piece are their bytes' pieces."""
        parts = self._parts(d, layer)
        if d not in self.odd:
            return parts
        out: list[int] = []
        for p in np.concatenate(parts).tolist():
            out += [p] if p >= 0 else [self.lattice.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "replace")]
        return [np.array(out, dtype=np.int32)]


def _truncated(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with the given location, given that they are at most bound."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return place - np.logaddexp(place - bound, np.log(-np.log(u)))


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 1.0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct segmentations per document, drawn without replacement: id_col, sample (from 1, by perturbed
    value), n_pieces, log_prob, perturbed, inclusion, ids_crc32 (of little-endian unsigned 32-bit ids), and ids if asked.

    inclusion is the probability that the path passes the threshold set by the first one not taken; 1 if all paths are
    taken. Draws depend on the document's id and text only. Null and empty texts have one segmentation, of no pieces;
    texts with fewer than k give as many rows as they have; repeated rows repeat; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model_path, alpha)
        for doc_ids, texts in _blocks(batches, _BLOCK_WORDS):
            raw = [t.encode("utf-8", "replace") for t in texts.to_pylist()]
            yield _rows(_block(lattice, doc_ids, texts, raw), doc_ids, k, with_ids)

    kind = f"{id_col} long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, kind)


def tokenised(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding, sampling and decoding in one pass: the rows of sample_segmentations() with ids and, as sample 0 without
    probabilities, those of encode(); decoded tells whether decode() makes the whole text of the ids again.

    Null counts as empty, with a sample 0 and a sample 1 of no pieces; otherwise as sample_segmentations().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model_path, alpha)
        for doc_ids, texts in _blocks(batches, _CHECKED_WORDS):
            yield _checked(lattice, model_path, doc_ids, texts, k)

    kind = f"{id_col} long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, ids array<int>, decoded boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, kind)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts, null as empty, in blocks: as many texts of a batch as it takes to reach so many words."""
    for b in batches:
        texts = b.column(1).fill_null("")
        size = np.cumsum(pc.add(pc.add(pc.count_substring(texts, " "), pc.count_substring(texts, _SPACE)), 1).to_numpy().astype(np.int64))
        a = 0
        while a < len(texts):
            z = min(int(size.searchsorted((size[a - 1] if a else 0) + most)) + 1, len(texts))
            yield b.column(0)[a:z].to_pylist(), texts[a:z]
            a = z


def _block(lattice: Lattice, doc_ids: list[int | None], texts: pa.Array, raw: list[bytes]) -> Block:
    return Block(lattice, [((0 if i is None else i) * _GOLDEN + zlib.crc32(r)) % (1 << 64) for i, r in zip(doc_ids, raw, strict=True)], lattice.split(texts))


def _encoded(model, block: Block, texts: pa.Array) -> list[np.ndarray]:
    """The ids of every whole text. As no piece crosses the start of a word, each distinct word is encoded once; texts with
    other white space marks than single spaces between words are encoded as they are."""
    lattice, known = block.lattice, len(block.length) - len(block.names)
    n, flat = lattice.kept_ids[0][:known], lattice.kept_ids[1]
    flat = flat[: int(n.sum())]
    new = [*islice(lattice.kept, len(n), known), *block.names]
    ids = model.encode(new) if new else []
    n = np.concatenate([n, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])
    flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(n[len(n) - len(ids) :].sum()))])
    kept = len(n) if lattice.kept_words.length is block.length else known
    lattice.kept_ids = n[:kept], flat[: int(n[:kept].sum())]
    m = n[block.kind]
    every = flat[np.repeat((np.cumsum(n) - n)[block.kind] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    ends = np.concatenate([[0], np.cumsum(m)])[np.concatenate([[0], np.cumsum(block.counts)])].tolist()
    out = [every[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
    for d in np.flatnonzero(~_plain(texts)).tolist():
        out[d] = np.array(model.encode(texts[d].as_py()), dtype=np.int32)
    return out


def _checked(lattice: Lattice, model_path: str, doc_ids: list[int | None], column: pa.Array, k: int) -> pa.RecordBatch:
    """The rows of _rows() and those of encode(), with what decoding says."""
    texts = column.to_pylist()
    raw = [t.encode("utf-8", "replace") for t in texts]
    block = _block(lattice, doc_ids, column, raw)
    own = _encoded(_processor(model_path), block, column)
    drawn = _rows(block, doc_ids, k, True)
    n = len(own)
    every = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
    ids = pa.ListArray.from_arrays(every, pa.array(np.concatenate(own) if own else np.zeros(0, dtype=np.int32)))
    nothing = pa.nulls(n, pa.float64())
    crcs = [zlib.crc32(x.astype("<u4")) for x in own]
    first = [pa.array(doc_ids, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([len(x) for x in own], pa.int64()), nothing, nothing, nothing, pa.array(crcs, pa.int64()), ids]
    at = np.cumsum(drawn.column(1).to_numpy() == 1) - 1  # each text's rows begin with sample 1
    owner = np.concatenate([np.arange(n), at]).astype(np.int64).tolist()
    cols = [pa.concat_arrays([a, b]) for a, b in zip(first, drawn.columns, strict=True)]
    same = lattice.same(cols[7].values, cols[7].offsets.to_numpy(), [texts[d] for d in owner], [raw[d] for d in owner])
    return pa.RecordBatch.from_arrays([*cols, pa.array(same, pa.bool_())], names=[*_NAMES, "decoded"])


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
_NAMES = ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32", "ids"]


def _rows(block: Block, doc_ids: list[int | None], k: int, with_ids: bool) -> pa.RecordBatch:
    rows = []
    for d, (doc_id, found) in enumerate(zip(doc_ids, block.sample(k), strict=True)):
        if not block.counts[d]:
            rows.append((doc_id, 1, 0, 0.0, 0.0, 1.0, 0, [] if with_ids else None))
        threshold = found[-1][1] if found and found[-1][2] < 0 else -np.inf
        for i, (log, value, layer) in enumerate(x for x in found if x[2] >= 0):
            parts = block.ids(d, layer)
            crc = 0
            for p in parts:
                crc = zlib.crc32(np.ascontiguousarray(p, dtype="<u4"), crc)
            inclusion = float(-np.expm1(-np.exp(min(log - threshold, 700.0)))) if np.isfinite(threshold) else 1.0
            rows.append((doc_id, i + 1, sum(map(len, parts)), log, value, inclusion, crc, np.concatenate(parts) if with_ids else None))
    cols = list(zip(*rows, strict=True)) or [()] * 8
    made = [pa.array(c, t) for c, t in zip(cols[:7], _TYPES, strict=True)]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[7]])]).astype(np.int32)
        made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *cols[7]]).astype(np.int32))))
    return pa.RecordBatch.from_arrays(made, names=_NAMES[: len(made)])
