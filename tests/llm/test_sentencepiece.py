import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import sentencepiece_ops as sp
from turnloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", None, "the cat ☃a", "  two  spaces ", "a" * 3000, "line\nline\ttab", "ünï çödé 日本", "x", "same", "same"]


@pytest.fixture(scope="module")
def lattice():
    return sp.Lattice.of(PATH)


def paths(lattice, words):
    def of(w):
        if not w:
            return [((), 0.0)]
        out = []
        for j in range(1, len(w) + 1):
            p = lattice.id_of.get(w[:j], -1 - ord(w[0]) if j == 1 else None)
            if p is not None:
                log = lattice.log_weight[p] if p >= 0 else -20.0
                ids = (p,) if p >= 0 else tuple(lattice.byte_ids[b] for b in chr(-1 - p).encode())
                out += [(ids + r, log + x) for r, x in of(w[j:])]
        return out

    every = {sum((a for a, _ in c), ()): sum(b for _, b in c) for c in itertools.product(*(of("▁" + w) for w in words))}
    z = np.logaddexp.reduce(list(every.values()))
    return {a: float(np.exp(b - z)) for a, b in every.items()}


def test_round_trip(docs):
    df = docs(TEXTS)
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(df, PATH), PATH).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    sampled = sp.sample_segmentations(df, PATH, k=3, with_ids=True)
    for r in sp.decode(sampled.select("doc_id", "ids"), PATH).collect():
        assert r.text == (TEXTS[r.doc_id] or "")


def test_draws_follow_the_law(lattice):
    words, n = lattice.words("the cat ☃a"), 4000
    law = paths(lattice, words)
    block = sp.Block(lattice, [i * 977 + 13 for i in range(n)], [words] * n)
    first, pairs = Counter(), Counter()
    for d, found in enumerate(block.sample(2)):
        got = [tuple(np.concatenate(block.ids(d, layer)).tolist()) for _, _, layer in found if layer >= 0]
        assert len(set(got)) == len(got) and found[0][1] > found[1][1] > found[2][1]
        for (log, _, _), p in zip(found, got, strict=False):
            assert abs(np.exp(log) - law[p]) < 1e-9
        first[got[0]] += 1
        pairs[tuple(got)] += 1
    for a, c in first.most_common(3):
        assert abs(c / n - law[a]) < 4 * (law[a] / n) ** 0.5
    for (a, b), c in pairs.most_common(3):
        p = law[a] * law[b] / (1 - law[a])
        assert abs(c / n - p) < 4 * (p / n) ** 0.5


def test_all_segmentations_of_a_short_text(docs, lattice):
    rows = sp.sample_segmentations(docs(["ab", "", None]), PATH, k=9, with_ids=True).collect()
    of = [r for r in rows if r.doc_id == 0]
    assert {tuple(r.ids) for r in of} == set(paths(lattice, lattice.words("ab")))
    assert all(r.inclusion == 1.0 for r in of) and sorted(r["sample"] for r in of) == list(range(1, len(of) + 1))
    assert [(r.n_pieces, r["sample"]) for r in rows if r.doc_id > 0] == [(0, 1)] * 2
    assert sp.sample_segmentations(docs([]), PATH).count() == 0


def test_draws_depend_on_the_row_only(docs):
    one = {(r.doc_id, r["sample"]): r for r in sp.sample_segmentations(docs(TEXTS), PATH).collect()}
    other = {(r.doc_id, r["sample"]): r for r in sp.sample_segmentations(docs(TEXTS[::-1], ids=list(range(len(TEXTS)))[::-1]).repartition(3), PATH).collect()}
    assert one == other
    assert one[8, 1].ids_crc32 == one[8, 1].ids_crc32 and one[8, 1].perturbed != one[9, 1].perturbed


def test_the_query_encodes_samples_and_decodes(spark, sf):
    from turnloom.llm.queries import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op4_sentencepiece"](spark, sf).collect()
    own = {r.doc_id: r.ids for r in rows if r["sample"] == 0}
    model = sp._processor(PATH)
    assert own == {i: model.encode(t) for i, t in texts.items()}
    assert all(r.decoded and r.n_pieces == len(r.ids) for r in rows) and {r["sample"] for r in rows} == {0, 1, 2}


def test_tokenised_gives_the_rows_of_its_parts(docs):
    df = docs(TEXTS)
    rows = sp.tokenised(df, PATH, k=3).collect()
    drawn = {(r.doc_id, r["sample"]): r for r in sp.sample_segmentations(df, PATH, k=3, with_ids=True).collect()}
    assert {(r.doc_id, r["sample"]): r[:8] for r in rows if r["sample"]} == {x: r[:8] for x, r in drawn.items()}
    assert {r.doc_id: r.ids for r in rows if not r["sample"]} == {r.doc_id: r.ids or [] for r in sp.encode(df, PATH).collect()}
    assert all(r.decoded for r in rows) and sp.tokenised(docs([]), PATH).count() == 0


def test_known_words_are_connected_and_encoded_once(monkeypatch):
    connected, encoded = [], []
    connect, model = sp._connected, sp._processor(PATH)

    class Model:
        def encode(self, what):
            encoded.extend(what if isinstance(what, list) else [])
            return model.encode(what)

    monkeypatch.setattr(sp, "_connected", lambda lattice, kinds: connected.extend(kinds) or connect(lattice, kinds))
    column = pa.array([t or "" for t in TEXTS])
    rows = {}
    for edges in (sp._KEPT_EDGES, 0, 150):  # all kept, none, some
        monkeypatch.setattr(sp, "_KEPT_EDGES", edges)
        lattice = sp.Lattice(PATH, 1.0)
        monkeypatch.setattr(sp, "_processor", lambda path: Model())
        for texts in (column[2:4], column, column):
            connected.clear(), encoded.clear()
            got = sp._checked(lattice, PATH, list(range(len(texts))), texts, 3).to_pylist()
            assert rows.setdefault(len(texts), got) == got
        assert edges <= 150 or not connected and not encoded
        assert edges > 150 or connected and encoded
        assert edges != 150 or 0 < len(lattice.kept)
        monkeypatch.setattr(sp, "_processor", lambda path: model)


def test_words_and_decoding_of_many_texts(lattice):
    texts = [t or "" for t in TEXTS] + [" ", "a ", " a", "▁a▁▁", "a  b", "▁", "a b"]
    assert lattice.split(pa.array(texts)).to_pylist() == [lattice.words(t) for t in texts]
    assert lattice.split(pa.array(texts)[3:9]).to_pylist() == [lattice.words(t) for t in texts[3:9]]
    ids = [sp._processor(PATH).encode(t) for t in texts]
    cuts = np.cumsum([0, *map(len, ids)])
    say = lambda of: lattice.same(pa.array([i for x in ids for i in x], pa.int32()), cuts, of, [t.encode() for t in of])
    assert say(texts) == [lattice.text(x) == t for x, t in zip(ids, texts, strict=True)]
    assert not any(say([t + "x" for t in texts]))
    assert lattice.same(pa.array([], pa.int32()), np.zeros(2, dtype=np.int64), [""], [b""]) == [True]
