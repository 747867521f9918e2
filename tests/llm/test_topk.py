import math
import random

import numpy as np
import pytest

from turnloom.llm import topk

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"shard_rows": 37, "batch_rows": 3}])
def test_matches_brute_force(spark, more):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) * (1 + (i % 3 == 0)) for _ in range(16)]) for i in range(160)]
    rows += [(i, rows[3][1]) for i in range(160, 190)]  # ties
    rows += [(200, None), (220, [None] * 16), (240, [float("nan")] * 16), (241, [float("inf")] * 16), (260, []), (280, [0.5, 0.25]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], KIND + ", score int, at int").coalesce(2)
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.filter("vec_id % 20 = 0"), **more).collect())
    assert got == brute(rows, 20)


def test_empty_few_and_repeated(spark):
    assert topk.exact_top_k(spark.createDataFrame([], KIND), spark.createDataFrame([], KIND)).count() == 0
    df = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 0)], KIND)
    assert [tuple(r) for r in topk.exact_top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 4096)]
    twice = df.union(df)
    assert [tuple(r) for r in topk.exact_top_k(twice, twice.filter("vec_id = 0")).collect()] == [(0, 1, 1, 4096), (0, 2, 1, 4096)]


def wanted(v, ids, a, k):
    full = a.astype(object) @ v.T.astype(object)
    return [sorted((-full[q, i], i) for i in range(len(v)) if i != ids[q])[:k] for q in range(len(a))]


def found(index, a, ids, k, floors=None):
    rows, cols, scores = index.search(a, ids, k, floors)
    return [[(-int(s), int(c)) for c, s in zip(cols[rows == q], scores[rows == q], strict=True)] for q in range(len(a))]


def test_segments_are_postings_by_descending_impact():
    v = np.random.default_rng(8).integers(-40, 41, size=(300, 12))
    index = topk.ImpactIndex.load(topk.ImpactIndex(np.arange(300), v).dump())
    assert (np.diff(index.segments[:, 0]) <= 0).all() and len(index.rows) == np.count_nonzero(v)
    ends = [*index.segments[1:, 2].tolist(), len(index.rows)]
    for (level, dim, first), end in zip(index.segments.tolist(), ends, strict=True):
        rows, impacts = index.rows[first:end], index.impacts[first:end].astype(int)
        assert (v[rows, dim] == impacts).all() and len(set(rows.tolist())) == len(rows)
        assert (np.floor(2 * np.log2(np.abs(impacts))) == level).all()


def test_reading_stops_on_proof_and_scores_stay_exact():
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, size=(2000, 24))
    v[:60] *= 40
    index = topk.ImpactIndex(np.arange(2000), v)
    assert found(index, v[:10], np.arange(10), 5) == wanted(v, np.arange(10), v[:10], 5)
    assert index.read < 0.75 * len(index.rows) * 10
    a, ids = v[:2] * 10**9, np.array([-1, -2])
    assert found(index, a, ids, 5) == wanted(v, ids, a, 5)
    thresholds = np.array([-w[-1][0] for w in wanted(v, np.arange(10), v[:10], 5)], dtype=float)
    read = index.read
    assert found(index, v[:10], np.arange(10), 5, thresholds) == wanted(v, np.arange(10), v[:10], 5)
    assert index.read - read < 0.75 * len(index.rows) * 10


def test_unparted_bounds_read_everything():
    v = np.tile(np.array([[3, -2, 1, 1]]), (50, 1))
    index = topk.ImpactIndex(np.arange(50), v)
    assert found(index, v[:3], np.arange(3), 4) == wanted(v, np.arange(3), v[:3], 4)
