import math
import random
import zlib
from collections import Counter

import numpy as np

from turnloom.llm import lm

MU = (50.0, 10.0)


def brute(texts, ids):
    toks = {i: [*(t or "").encode().lower().split(), "end"] for i, t in zip(ids, texts, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in ids}
    grams = [Counter(), Counter(), Counter()]
    for i, t in toks.items():
        if not held[i]:
            grams[0].update((w,) for w in t)
            grams[1].update(zip(["end", *t], t, strict=False))
            grams[2].update(zip(["end", *t], t, t[1:], strict=False))
    uni = grams[0]
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def p(h, w):
        """P(w) after the words h, of which at most the last two count; contexts never seen say nothing."""
        h = tuple(h[-2:])
        if not h:
            return (uni[(w,)] - d if uni[(w,)] else d * v) / n
        return (grams[len(h)][(*h, w)] + MU[len(h) - 1] * p(h[1:], w)) / (grams[len(h) - 1][h] + MU[len(h) - 1])

    out = {}
    for i, t in toks.items():
        base = sum(math.log10((uni[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out[i] = (held[i], len(t), sum(uni[(w,)] > 0 for w in t), n, base, sum(math.log10(p(["end", *t[:k]], w)) for k, w in enumerate(t)))
    return out, p, [w for (w,) in uni]


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return [None, "", "  "] + [" ".join(rng.choices(["the", "The", "of", "a", "b", "cc", "ünï"] + [f"r{rng.randrange(99)}"], k=rng.randrange(1, 40))) for _ in range(n)]


def test_matches_brute_force_however_it_is_cut(docs):
    texts = texts_of(120)
    want, p, uni = brute(texts, range(len(texts)))
    for more in ({}, {"chunk_bytes": 500}, {"chunk_bytes": 300, "range_keys": 20, "fan": 4}):  # the last needs levels
        got = {r.doc_id: r for r in lm.score_documents(docs(texts), **more).collect()}
        assert len(got) == len(texts)
        for i, w in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert math.isclose(r.base_score, w[4], abs_tol=1e-9) and math.isclose(r.score, w[5], abs_tol=1e-9)
    for h in (["end"], [b"the"], [b"never"], ["end", b"the"], [b"the", b"of"], [b"never", b"a"]):
        assert math.isclose(sum(p(h, w) for w in [*uni, "unknown"]), 1.0, abs_tol=1e-9)


def test_states_arcs_and_failures():
    texts = [b"a b c", b"a b d", b"x a b", b"c b a"]
    c = lm.Chunk.load(lm.Chunk.of([1, 2, 3, 5], texts, folds=10**9).dump())  # all of them for training
    c.number()
    totals = c.counts().astype(np.int64)
    w = len(c.hashes)
    words = totals[:w]
    facts = (int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum()))
    a = c._automaton(words, totals[w : w + len(c.pairs)], totals[w + len(c.pairs) :], *facts, MU)
    root = sum(10**x for x in a["arc1"]) + min(0.9, max(0.1, facts[2] / (facts[2] + 2 * facts[3]))) * facts[1] / facts[0]
    assert math.isclose(root, 1.0)  # known words and the unknown
    rest = lambda left: sum(10**x for x in left)
    for h in range(w):  # arcs, and through the failure arc what the root gives to words without one
        arcs = {int(p % w): a["arc2"][i] for i, p in enumerate(c.pairs) if p // w == h}
        none = 10 ** a["fail1"][h] * (1 - rest(a["arc1"][x] for x in arcs))
        assert math.isclose(rest(arcs.values()) + none, 1.0)
    for h, pair in enumerate(c.pairs):
        if pair % w == c.edge:
            continue
        assert a["back"][h] == 1 + pair % w
        arcs = {int(t % w): a["arc3"][i] for i, t in enumerate(c.triples) if t // w == h}
        lower = {int(p % w): a["arc2"][i] for i, p in enumerate(c.pairs) if p // w == pair % w}
        assert set(arcs) <= set(lower)
        assert math.isclose(rest(arcs.values()) + 10 ** a["fail2"][h] * (1 - rest(lower[x] for x in arcs)), 1.0)


def test_repeated_rows_fill_chunks_of_bounded_size(docs):
    df = docs(["the same words again and again"] * 3000, ids=[1] * 3000).repartition(3)
    rows = lm.score_documents(df, chunk_bytes=10_000).collect()
    assert len(rows) == 3000 and len({(r.score, r.train_tokens) for r in rows}) == 1 and rows[0].train_tokens == 21_000


def markov_texts(n):
    """Texts in which a word tells much of the next, with some words that occur once."""
    rng, out = random.Random(2), []
    for i in range(n):
        w = [rng.randrange(40)]
        for _ in range(rng.randrange(5, 40)):
            w.append((w[-1] * 7 + rng.randrange(3)) % 40)
        out.append(" ".join([f"w{x}" for x in w] + [f"once{i}"]))
    return out


def test_held_out_texts_score_better_than_base(docs):
    rows = [r for r in lm.score_documents(docs(markov_texts(400))).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(docs):
    assert lm.score_documents(docs([])).count() == 0
    none = next(i for i in range(100) if lm.held_out(i))
    r = lm.score_documents(docs(["a b"], ids=[none])).first()  # nothing to train on
    assert (r.train_tokens, r.n_known, r.score) == (0, 0, 0.0)
    same = lm.score_documents(docs(["a b", "a b"], ids=[1, 1])).collect()
    assert len(same) == 2 and same[0] == same[1] and same[0].train_tokens == 6
    assert lm.score_documents(docs(["w " * 60_000], ids=[1]), chunk_bytes=1000).first().n_tokens == 60_001
