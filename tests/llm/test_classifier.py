import random

import numpy as np

from turnloom.llm import classifier as c

BAD = ["vile", "awful"]


def data(n, seed):
    rng = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        w = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(8, 60))]
        g = rng.choice([0, 1, 2, 2, 2, 2])
        if g == 0:
            w = [x + "%%%" for x in w]
        if g == 1:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        texts.append(" ".join(w)), grades.append(g)
    return texts, grades


def labels(spark, grades):
    rows = [(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades)]
    return spark.createDataFrame([*rows, (None, 1, 0), (10**6, None, 0), (0, 0, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    texts, grades = data(1500, 1)
    model = c.train(docs(texts), c.graded(labels(spark, grades)))
    assert (np.diff(model.thresholds) >= 0).all()
    texts, grades = data(400, 2)
    rows = sorted(c.scored(docs(texts), model).collect(), key=lambda r: r.doc_id)
    assert sum(r.kept == (g == 2) for r, g in zip(rows, grades, strict=True)) >= 396
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    order = [np.mean([r.expected_grade for r, g in zip(rows, grades, strict=True) if g == k]) for k in (1, 0, 2)]  # toxic, poor, good
    assert order[0] < order[1] < order[2]


def test_selected_rows_are_those_kept(spark, docs):
    texts, grades = data(300, 4)
    df = docs([*texts, None, ""])
    model = c.train(df, c.graded(labels(spark, grades)))
    kept = {r.doc_id for r in c.scored(df, model).filter("kept").collect()}
    rows = c.selected(df, model)
    assert rows.columns == df.columns and {r.doc_id for r in rows.collect()} == kept


def test_lowest_of_several_labels_counts(spark):
    got = {r.id: r.grade for r in c.graded(labels(spark, [2, 1])).collect()}
    assert got == {0: 1, 1: 0}  # poor by one label of two; toxic


def test_edges(spark, docs):
    none = labels(spark, []).limit(0)
    model = c.train(docs(["a b"]), c.graded(none))
    rows = c.scored(docs([None, "", "a b", "x" * 100_000, "same", "same"]), model).collect()
    assert len(rows) == 6 and all(r.kept for r in rows)  # nothing learned, nothing rejected
    assert c.scored(docs([]), model).count() == 0
    one = c.train(docs(["a b", "c d"]), c.graded(spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")))
    assert len(one.thresholds) == 0


def test_cut_comes_from_held_out_ratings():
    t, f = True, False
    assert 0.2 < c.best_cut(np.array([0.1, 0.2, 0.7, 0.9]), np.array([f, f, t, t])) < 0.7
    assert c.best_cut(np.array([0.1, 0.2, 0.7, 0.9]), np.array([f, f, t, t])) == c.best_cut(np.array([0.2, 0.7]), np.array([f, t]))
    many = np.array([0.01, 0.02, 0.04, 0.05] + [0.9] * 600), np.array([f, t, f, f] + [t] * 600)
    assert 0.05 < c.best_cut(*many) < 0.9 and 0.01 < c.best_cut(*many, lost=0.0) < 0.02
    assert c.best_cut(np.array([0.5, 0.5]), np.array([t, f])) == 0 == c.best_cut(np.array([0.9]), np.array([t])) == c.best_cut(np.array([0.1, 0.9]), np.array([t, f]))


def test_only_features_beyond_chance_get_weights():
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, size=600)
    features = [np.unique(np.append(rng.integers(3, 60, size=9), [g])).astype(np.int32) for g in grades]
    assert c.telling(features, grades, 64, 3, 6.0).tolist() == [0, 1, 2]


def test_bounds_are_ordered_and_ids_count_once(spark, docs):
    texts, grades = data(200, 5)
    df, rated = docs([*texts, *texts, None], ids=[*range(200), *range(200), 3]), c.graded(labels(spark, grades))
    whole, again = c.train(df, rated), c.train(df.repartition(7), rated)
    assert (whole.weights == again.weights).all() and whole.cut == again.cut
    few, by_bytes = c.train(df, rated, most_rows=50), c.train(df, rated, most_bytes=5000)
    assert len(few.thresholds) and len(by_bytes.thresholds) and (few.weights != whole.weights).any() and (by_bytes.weights != whole.weights).any()


def test_gradient_is_right():
    rng = np.random.default_rng(3)
    features = [np.unique(rng.integers(0, 30, size=6)).astype(np.int32) for _ in range(80)]
    grades = rng.integers(0, 3, size=80)
    seen = {}

    def spy(loss, x, rounds, memory=8):
        x = x + rng.normal(size=len(x)) * 0.3
        value, g = loss(x)
        for i in [0, 5, len(x) - 2, len(x) - 1]:
            e = np.zeros(len(x))
            e[i] = 1e-5
            seen[i] = ((loss(x + e)[0] - loss(x - e)[0]) / 2e-5, g[i])
        return x

    kept, c._lbfgs = c._lbfgs, spy
    try:
        c.fit(features, grades, 30, least_df=1, least_z=0)
    finally:
        c._lbfgs = kept
    for numeric, given in seen.values():
        assert abs(numeric - given) < 1e-4 * max(1, abs(numeric))
