"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - score), thresholds in ascending order; the score is a sum of shared weights over
a text's distinct features. A word gives up to three features, all hashed: the word without punctuation at its ends, its
first letters, and its shape (what punctuation it carries and how it is capitalised). Only features that part grades
beyond chance get a weight. Scores give the expected grade and the probability of the top grade; the latter selects
documents, from a cut that rated documents held out of a first fit decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import written

#: Stripped from a word's ends; what was stripped is part of its shape.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Words whose features or weights a task remembers before it forgets all, and bytes of the longest that it remembers.
_REMEMBERED, _LONGEST = 300_000, 64


@dataclass
class Model:
    """weights by hashed feature and ascending thresholds; with no thresholds nothing was learned and all is kept. cut is the
    least probability of the top grade that is kept."""

    weights: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cut: float = 0.5

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, by columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def word_features(word: bytes, buckets: int) -> tuple[int, ...]:
    core = word.strip(_MARKS)
    head, tail = (word.split(core, 1) if core else (word, b""))
    case = b"U" if core.isupper() and len(core) > 1 else b"l"
    shape = b"%s %s %s" % (head[:3], case, tail[:3])
    low = core.lower()
    begins = low.decode("utf-8", "replace")[:4].encode()
    told = xxhash.xxh64_intdigest(low, 1) % buckets, xxhash.xxh64_intdigest(shape, 2) % buckets
    return (*told, xxhash.xxh64_intdigest(begins, 3) % buckets) if len(begins) < len(low) else told


def text_features(text: bytes | None, buckets: int, known: dict) -> np.ndarray:
    """The distinct features of a whole text, sorted."""
    found: set[int] = set()
    if len(known) > _REMEMBERED:
        known.clear()
    for w in set(text.split()) if text else ():
        f = known.get(w)
        if f is None:
            f = word_features(w, buckets)
            if len(w) <= _LONGEST:
                known[w] = f
        found.update(f)
    return np.array(sorted(found), dtype=np.int32)


def telling(features: list[np.ndarray], grades: np.ndarray, buckets: int, least_df: int, least_z: float) -> np.ndarray:
    """The features in least_df texts or more whose texts lie above a grade more or less often than all texts do, by least_z
    standard errors for some grade."""
    top, df = int(grades.max()), np.zeros(buckets, dtype=np.int64)
    above = np.zeros((top, buckets), dtype=np.int64)
    for f, g in zip(features, grades.tolist(), strict=True):
        df[f] += 1
        above[:g, f] += 1
    share = np.array([(grades > k).mean() for k in range(top)])[:, None]
    error = np.sqrt(df * share * (1 - share))
    return np.flatnonzero((df >= least_df) & (np.abs(above - df * share) >= least_z * np.maximum(error, 1e-12)).any(axis=0))


def fit(features: list[np.ndarray], grades: np.ndarray, buckets: int, least_df: int = 3, least_z: float = 6.0, prior: float = 0.5, rounds: int = 80) -> Model:
    """Maximum of the cumulative-link likelihood with a Gaussian prior on the weights, by L-BFGS.

    Grades are 0, 1, ...; features are present or not, and those that telling() doesn't name get no weight. Fewer than two
    grades give the model that keeps all.
    """
    top = int(grades.max(initial=0))
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(buckets, dtype=np.float32))
    used = telling(features, grades, buckets, least_df, least_z)
    place = np.full(buckets, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    rows = [place[f] for f in features]
    rows = [r[r >= 0] for r in rows]
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    n, m, at = len(rows), len(used), np.arange(len(rows))

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = x[:m], thresholds(x)
        score = np.bincount(owner, weights=w[flat], minlength=n)
        p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60))), np.zeros((n, 1))])
        slope = p * (1 - p)
        own = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)  # P(grade)
        up = (slope[at, grades] - slope[at, grades + 1]) / own
        g_theta = np.array([(np.where(grades == k, slope[:, k + 1], 0) - np.where(grades == k + 1, slope[:, k + 1], 0)).dot(1 / own) for k in range(top)])
        g = np.empty_like(x)
        g[:m] = np.bincount(flat, weights=up[owner], minlength=m) - prior * w
        g[m] = g_theta.sum()
        for k in range(1, top):
            g[m + k] = g_theta[k:].sum() * np.exp(x[m + k])
        return -np.log(own).sum() + prior / 2 * w.dot(w), -g

    share = np.clip(np.array([(grades > k).mean() for k in range(top)]), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    x = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    x = _lbfgs(loss, x, rounds)
    weights = np.zeros(buckets, dtype=np.float32)
    weights[used] = x[:m]
    return Model(weights, thresholds(x))


def _lbfgs(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimise by the two-loop recursion with step halving."""
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, y, r in reversed(past):
            a = r * s.dot(d)
            d -= a * y
            kept.append(a)
        if past:
            s, y, r = past[-1]
            d *= s.dot(y) / y.dot(y)
        else:
            d /= max(1.0, float(np.abs(g).sum()))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d += s * (a - r * y.dot(d))
        step, slope = 1.0, g.dot(d)
        if slope <= 0:
            break
        while True:
            new = x - step * d
            v, h = loss(new)
            if v <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - x, h - g
        if s.dot(y) > 1e-12:
            past = [*past[-(memory - 1) :], (s, y, 1 / s.dot(y))]
        done = value - v < 1e-6 * max(1.0, abs(value))
        x, value, g = new, v, h
        if done:
            break
    return x


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): 0 for toxic, 1 for low quality, 2 for good and clean. Null labels that leave it open give no row; of several
    for one document the lowest grade counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when((F.col("quality") > 0) & (F.col("toxic") <= 0), 2)
    rows = labels.select(F.col(id_col).cast("long").alias("id"), grade.alias("grade"))
    return rows.filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))


def best_cut(probabilities: np.ndarray, top: np.ndarray, lost: float = 0.002) -> float:
    """The cut between probabilities of the top grade that rejects most documents of other grades, of those cuts that reject
    at most the share `lost` of the top ones. Among equal ones, the middle of the widest gap on the scale of log odds; 0,
    which keeps all, where nothing is rejected so."""
    if top.all() or not top.any():
        return 0.0
    odds = np.log(np.clip(probabilities, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(probabilities, 1e-12, 1 - 1e-12))
    order = np.argsort(odds, kind="stable")
    odds, top = odds[order], top[order]
    gap = np.diff(odds)
    rejected = np.where((gap > 0) & (np.cumsum(top)[:-1] <= lost * top.sum()), np.cumsum(~top)[:-1], 0)
    if not rejected.any():
        return 0.0
    i = max(np.flatnonzero(rejected == rejected.max()), key=lambda j: (gap[j], -j))
    return float(1 / (1 + np.exp(-(odds[i] + odds[i + 1]) / 2)))


def train(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 18, most_rows: int = 12_000, most_bytes: int = 64 << 20
) -> Model:
    """Fit on at most most_rows rated documents, those whose ids hash smallest, of which as many as have most_bytes of features
    in that order; only these features reach the driver.

    Of several documents with one id the one whose features come first as bytes counts; null texts have none. A model
    fitted on four fifths rates the last fifth, from which best_cut() takes the cut; the model itself is fitted on all.
    """
    chosen = ratings.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(most_rows).select("h", "id", "grade")
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            f = [text_features(t, buckets, known).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.binary()), b.column(2), b.column(3).cast(pa.int32())], names=["id", "f", "h", "grade"])

    made = joined.select("id", "t", "h", "grade").mapInArrow(run, "id long, f binary, h long, grade int")
    made = written(made.groupBy("h", "id").agg(F.min("f").alias("f"), F.min("grade").alias("grade")), "features")
    upto = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)  # over at most most_rows short rows
    sizes = made.select("h", "id", F.octet_length("f").alias("b")).withColumn("b", F.sum("b").over(upto)).filter(F.col("b") <= most_bytes)
    rows = made.join(F.broadcast(sizes.select("id")), "id", "left_semi").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    if not rows.num_rows:
        return Model(np.zeros(buckets, dtype=np.float32))
    features, grades = [np.frombuffer(x, dtype=np.int32) for x in rows["f"].to_pylist()], rows["grade"].to_numpy().astype(np.int64)
    model = fit(features, grades, buckets)
    held = np.arange(len(features)) % 5 == 4
    first = fit([f for f, h in zip(features, held, strict=True) if not h], grades[~held], buckets) if held.any() else model
    if len(first.thresholds):
        scores = np.array([first.weights[f].sum(dtype=np.float64) for f, h in zip(features, held, strict=True) if h])
        model.cut = best_cut(first.probabilities(scores)[:, -1], grades[held] == grades.max())
    return model


def _scores(texts: list, model: Model, known: dict, weight: list[float]) -> np.ndarray:
    """P(grade > k) of every text by columns; one column of ones for a model that learned nothing."""
    buckets, scores = len(weight), np.zeros(len(texts))
    for i, t in enumerate(texts):
        if len(known) > _REMEMBERED:
            known.clear()
        found: set = set()
        for w in set(t.split()) if t else ():
            f = known.get(w)
            if f is None:
                f = tuple(x for x in word_features(w, buckets) if weight[x])
                if len(w) <= _LONGEST:
                    known[w] = f
            found.update(f)
        scores[i] = sum(map(weight.__getitem__, sorted(found)))
    return model.probabilities(scores) if len(model.thresholds) else np.ones((len(texts), 1))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, expected_grade, tail_probability (of the top grade) and kept (tail_probability >= model.cut) of every document.

    Null and empty texts score as texts without features; repeated rows stay; an empty table gives an empty one. Of a
    very long text its distinct words are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, known = model.weights.tolist(), {}
        for b in batches:
            p = _scores(b.column(1).to_pylist(), model, known, weight)
            cols = [b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= model.cut)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "tail_probability", "kept"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def selected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that scored() keeps, with all their columns, in one pass and without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, known = model.weights.tolist(), {}
        for b in batches:
            p = _scores(b.column(at).cast(pa.binary()).to_pylist(), model, known, weight)
            yield b.filter(pa.array(p[:, -1] >= model.cut))

    return docs.mapInArrow(run, docs.schema)
