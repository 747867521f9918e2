import random

import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import simhash as s
from turnloom.llm.graph import connected_components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_brute_force(docs):
    texts = [None, "", "  ", "one", "one two", "One TWO three", "a b c d " * 5000, "É é ÀB İ ẞ", " x\x1cy z"]
    texts += [" ".join(random.Random(i).choices("abcdefg", k=i)) for i in range(40)]
    got = {r.id: r.fp for r in s.fingerprints(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [signed(brute_fingerprint(t)) for t in texts]


@pytest.mark.parametrize(("bucket", "bits", "segments"), [(256, 2, 5), (3, 2, 5), (2, 2, 6), (2, 1, 4)])
def test_links_form_the_same_groups_as_all_pairs(spark, bucket, bits, segments):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(250):  # chains and dense balls
        x = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = s.link_edges(df, bits=bits, segments=segments, bucket=bucket)
    at = {signed(x): i for i, x in enumerate(fps)}
    for r in edges.collect():
        assert bin(fps[at[r.a]] ^ fps[at[r.b]]).count("1") <= bits
    found = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(fps, bits)
    groups = {}
    for x, g in zip(fps, want, strict=True):
        groups.setdefault(g, set()).add(found.get(signed(x), signed(x)))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_near_duplicates(docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = base + " w401"
    texts = [base, "other words here to see", base, near, None, "", base.upper()]
    rows = {r.id: r for r in s.near_duplicates(docs(texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(fps, 2)
    assert s.near_duplicates(docs([])).count() == 0
    twice = s.near_duplicates(docs(["a b c", "a b c"], ids=[5, 5])).collect()
    assert [(r.id, r.component_id) for r in twice] == [(5, 5)] * 2


def test_hex(spark):
    df = spark.createDataFrame([(-1,), (1,), (0,)], "fp long").select(s.hex_of(F.col("fp")).alias("h"))
    assert [r.h for r in df.collect()] == ["f" * 16, "0" * 15 + "1", "0" * 16]


def test_components_of_paths_stars_and_loops(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (1001, 1002), (1001, 1002)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    hot = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hot_rows=10).collect()}
    assert hot == got


def test_hot_fingerprints_and_groups(docs):
    texts = ["the same boilerplate of a site"] * 300 + [None] * 50 + [f"w{i} x{i} y{i} z{i}" for i in range(20)]
    plain, hot = (sorted((r.id, r.fp, r.component_id) for r in s.near_duplicates(docs(texts), hot_rows=n).collect()) for n in (10**9, 20))
    assert plain == hot and len(plain) == len(texts)


def test_segments_grow_with_the_table():
    assert s.segments_for(1000) == 5 and s.segments_for(10**9) == 5 and 5 < s.segments_for(10**10) <= s.segments_for(10**12) <= 15
