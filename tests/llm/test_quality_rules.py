import math
import random
import re
from collections import Counter

import numpy as np

from turnloom.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_match_brute_force(docs):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x x x x x x", "l\nl\n\nl\n  \n  \n", "ünï #*$ %&|<> é\x0b\x0cz\rq w", "a b c d e f " * 3000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    got = {r.doc_id: r for r in q.judged(docs(texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), t
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_others_stay(docs):
    rng = random.Random(2)
    plain = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))) for _ in range(300)]
    junk = [" ".join(f"{w}%%%" for w in t.split()) for t in plain[:20]] + [" | ".join(t.split()) for t in plain[20:40]]
    got = {r.doc_id: r.kept for r in q.judged(docs(plain + junk)).collect()}
    assert all(got[i] for i in range(300))
    assert not any(got[i] for i in range(300, 340))


def test_small_groups_and_nulls(spark, docs):
    few = docs(["one two three four five six seven eight nine ten eleven"] * 3)
    assert [r.kept for r in q.judged(few).collect()] == [True] * 3  # too few to estimate anything
    rows = [(i, "w " + " ".join(f"v{i}{j}" for j in range(30)), None, None, 1) for i in range(70)]
    nulls = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.kept for r in q.judged(nulls).collect())
    assert q.judged(docs([])).count() == 0


def reference(x, core):
    """The minimum-covariance-determinant estimate of the rows of x by many random starts: centre, scatter, determinant."""
    n, dim = x.shape
    h, rng, best = round(core * n), np.random.default_rng(0), None
    scale = core / q._chi2_cdf(q.chi2_quantile(core, dim), dim + 2)
    for _ in range(200):
        keep = rng.choice(n, dim + 2, replace=False)
        for _ in range(30):
            scatter = np.cov(x[keep].T, bias=True) * scale + np.eye(dim) * 1e-6
            y = x - x[keep].mean(0)
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(scatter), y)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if len(new) == len(keep) and (new == keep).all():
                break
            keep = new
        det = np.linalg.slogdet(np.cov(x[keep].T, bias=True) * scale)[1]
        if best is None or det < best[0]:
            best = det, d
    return best


def fitted(spark, x):
    rows = [("g", len(x), i, *map(int, v)) for i, v in enumerate(x)]
    fit = spark.createDataFrame(rows, "g string, rows long, u long, " + ", ".join(f"x{i} long" for i in range(x.shape[1])))
    at = np.quantile(x, [0.25, 0.75], axis=0)
    names = [f"{n}{i}" for i in range(x.shape[1]) for n in ("lower", "upper")]
    quartiles = spark.createDataFrame([("g", *at.T.reshape(-1).tolist())], "g string, " + ", ".join(f"{n} double" for n in names))
    model = q.estimates(fit, quartiles, 1)
    got = fit.crossJoin(model.drop("g")).select("u", q._distance().alias("d"), "logdet").orderBy("u").collect()
    return got[0].logdet, np.array([r.d for r in got])


def test_estimates_match_a_search_from_many_starts(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(4, 4)) * 300
    x = rng.normal(size=(240, 4)) @ mix
    x[:60] = rng.normal(size=(60, 4)) * 50 + [4000, -3000, 2000, 5000]  # a quarter lies elsewhere, close together
    x = np.round(x)
    det, d = reference(x, 0.7)
    own_det, own = fitted(spark, x)
    assert abs(own_det - det) < 0.1
    assert np.abs(np.log(own / d))[d > 0.5].max() < 0.25
    cut = q.chi2_quantile(1 - 1e-8, 4)
    assert ((own > cut) == (d > cut)).all() and (own[:60] > cut).all() and (own[60:] <= cut).all()
    assert abs(np.median(own[60:]) - q.chi2_quantile(0.5, 4)) < 1


def test_singular_scatter_is_guarded(spark):
    x = np.zeros((100, 4))
    x[:, 0] = np.arange(100)
    x[:, 1] = x[:, 0]  # wholly correlated, and two components that never change
    _, d = fitted(spark, x)
    assert np.isfinite(d).all() and np.median(d) < 20


def test_verdicts_are_those_of_the_search_on_texts(spark, docs):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(["", "", ","]) for _ in range(rng.randint(20, 200))) for _ in range(150)]
    texts += [" ".join(w + "%%" for w in t.split()) for t in texts[:10]]
    rows = sorted(q.judged(docs(texts)).collect(), key=lambda r: r.doc_id)
    raw = np.array([[math.log(r.word_chars / r.n_words), *(math.asin(math.sqrt(s)) for s in (r.n_signs / r.word_chars, r.n_capitals / r.word_chars, r.n_short / r.n_words))] for r in rows])
    n = np.array([r.n_words for r in rows])[:, None]
    x = np.round((np.round(raw * 4096) - np.median(np.round(raw * 4096), axis=0)) * n / (n + q.PRIOR_WORDS))
    floors = np.array(list(q.COMPONENTS.values())) * 4096  # two of these, for letters drawn evenly, scatter less
    assert (np.std(x[:150], axis=0) > floors).sum() >= 2
    _, d = reference(x, 0.7)
    cut = q.chi2_quantile(1 - 1e-8, 4)
    assert [r.kept for r in rows] == (d <= cut).tolist()
    assert [r.kept for r in rows] == [True] * 150 + [False] * 10
    assert abs(np.median(d) - q.chi2_quantile(0.5, 4)) < 1 and np.median([r.distance for r in rows]) <= np.median(d) + 0.1


def test_chi_square_quantile():
    assert abs(q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_rows_alike_and_clashing_columns(spark, docs):
    text = "one two three four five six seven eight nine ten"
    df = docs([text, text, "few words", None], ids=[1, 1, 1, 2])
    rows = q.judged(df, carry=True).collect()
    assert sorted((r.doc_id, r.kept, r.row.text or "", r.row.n) for r in rows) == [(1, False, "few words", 1), (1, True, text, 1), (1, True, text, 1), (2, False, "", 1)]
