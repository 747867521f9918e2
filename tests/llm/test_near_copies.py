import random

import corpus_pipeline as cp

from turnloom.llm import near_copies


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = brute(a), brute(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def groups(texts):
    """Components of the links at 0.8 or more, named by their smallest place."""
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(60):
        n = rng.choice([12, 60, 300])
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        out += [base] + [edited(rng, base, e) for e in (1, n // 50, n // 40, n // 25)]
    return out


def test_links_match_brute_force(spark, docs):
    ts = texts()
    got = {r.id: r.component_id for r in near_copies.near_copies(docs(ts)).collect()}
    assert [got[i] for i in range(len(ts))] == groups(ts)


def test_large_buckets_leave_no_two_alike(spark, docs):
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(100))
    ts = [edited(rng, base, 1) for _ in range(60)] + [f"other {i} text of its own with {i * i} words" for i in range(5)]
    got = {r.id: r.component_id for r in near_copies.near_copies(docs(ts), bucket=8).collect()}
    assert [got[i] for i in range(len(ts))] == groups(ts)


def test_the_stage_removes_edited_copies(spark, docs):
    rng = random.Random(7)
    bases = [" ".join(f"w{rng.randrange(9000)}" for _ in range(400)) for _ in range(20)]
    df = docs(bases + [edited(rng, b, 6) for b in bases])
    assert sorted(r.doc_id for r in cp.keep_first_copies(spark, df, "").collect()) == list(range(20))


def test_repeated_ids_leave_one_row_of_each_group(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    df = docs([a, a, b, b, c], ids=[1, 1, 1, 2, None])
    assert sorted((r.doc_id or 0, r.text) for r in cp.keep_first_copies(spark, df, "").collect()) == [(0, c), (1, a), (1, b)]


def test_large_buckets_lose_no_link(spark, docs, monkeypatch):
    """A chain whose ends have nothing in common, between crowds at its ends, by words alone and in blocks of a few texts."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    ts = []
    for drift in range(45):
        base[drift] = f"other{drift}"
        ts.append(" ".join(base))
    ts += [edited(rng, ts[0], 3) for _ in range(30)] + [edited(rng, ts[30], 2) for _ in range(30)]
    monkeypatch.setattr(near_copies, "_CROWD_TEXTS", 7, raising=False)
    monkeypatch.setattr(near_copies, "_simhash_links", lambda nodes, hot_rows: nodes.selectExpr("node as a", "node as b").limit(0), raising=False)
    got = {r.id: r.component_id for r in near_copies.near_copies(docs(ts), bucket=4, hot_rows=10).collect()}
    assert [got[i] for i in range(len(ts))] == groups(ts)


def test_fingerprints_within_two_bits_link(spark, docs, monkeypatch):
    """By pigeonring alone: with no key that two texts share, what links is what brute force over fingerprints links."""
    rng = random.Random(10)
    base = " ".join(f"w{i}" for i in range(3000))
    ts = [base] + [edited(rng, base, e) for e in (1, 2, 3, 5, 8, 300)] + ["some other text of a few words"]
    fps = [near_copies._sketch(near_copies.shingles(near_copies._words(t.encode())))[0] for t in ts]
    want = [min(j for j in range(len(ts)) if (fps[0] ^ fps[j]).bit_count() <= 2) if (fps[0] ^ fps[i]).bit_count() <= 2 else i for i in range(len(ts))]
    monkeypatch.setattr(near_copies, "BITS_APART", -1)  # no candidate is confirmed by words
    got = {r.id: r.component_id for r in near_copies.near_copies(docs(ts)).collect()}
    assert len(set(want)) < len(ts) and [got[i] for i in range(len(ts))] == want
