"""Quality rules: text counts, and robust multivariate outliers per language and source. Column expressions only.

Every document becomes a vector of transformed statistics: the logarithm of its mean word length, and the arcsines of the
roots of its shares of signs, of capitals and of short words. Each is measured from its group's median and shrunk by
n / (n + PRIOR_WORDS), so that short texts, whose shares scatter most, scatter about as much as long ones.

For each group (language, source) the minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps: take the `core` share of rows with the least Mahalanobis distance, re-estimate from those, repeat.
There are several starts, one from medians and quartile scales and others from small subsets by hash; after two steps the
start with the least determinant goes on until its determinant no longer changes. Documents whose squared distance passes
a chi-square quantile are rejected.

Vectors are whole numbers of 1/4096, so sums are exact and don't depend on the order of rows. A step is one
aggregation to (group, start, distance bin) with counts and moments, partial on the map side; running sums over a group's
few bins then find the core, of whose last bin the share is taken that makes the core whole. Nothing is collected and no
group's rows meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import let, looked_up, replaced_by, words, written

#: Names of the components and the least standard deviation of each, against groups in which it hardly changes and
#: scatter would be singular; natural text of one language scatters more.
COMPONENTS = {"word_length": 0.02, "signs": 0.005, "capitals": 0.005, "short_words": 0.02}
#: Words' worth of the group's median that every document's statistics are mixed with.
PRIOR_WORDS = 100
_UNIT = 4096
_FLOORS = [f * _UNIT for f in COMPONENTS.values()]
#: Distances are binned by this many bins to a factor of two.
_BINS = 64
#: Expected rows of a subset that a start is estimated from, and the number of such starts.
_SUBSET, _SUBSETS = 40, 3
_DIM = len(COMPONENTS)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
#: Kept with each document beside what the contract of the rules asks for.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_signs", "n_short"]


def text_counts(text: Column, ngram: int = 5) -> Column:
    """struct of COUNTS of a whole text; null is empty. Work and memory are in proportion to the text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    without = lambda x, signs: F.length(x) - F.length(F.regexp_replace(x, signs, ""))

    def counted(w: Column) -> Column:
        short = F.size(F.filter(w, lambda x: F.length(x) <= 3))
        values = lambda joined: [
            F.size(w), F.length(joined), without(joined, "[#*$%&|<>]+"), dup, _repeat_words(w, ngram), without(joined, "[A-Z]+"),
            F.length(F.regexp_replace(joined, r"[\p{L}\p{M}\p{N}]+", "")), short,
        ]
        return let(F.array_join(w, ""), lambda joined: F.struct(*(v.cast("long").alias(name) for v, name in zip(values(joined), COUNTS, strict=True))))

    return let(words(text), counted)


def _repeat_words(w: Column, ngram: int) -> Column:
    """Words covered by windows of ngram words found twice or more. Windows are compared by 64-bit hash; only texts in
    which some hash repeats go through the sort that finds which."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (ngram - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(ngram))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.sort_array(F.transform(F.filter(
                s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])), lambda e: e["i"])),
        )
        return let(twice, lambda t: F.aggregate(
            F.transform(t, lambda at, i: F.least(F.lit(ngram), F.coalesce(F.get(t, i + 1) - at, F.lit(ngram)))), F.lit(0), lambda a, x: a + x))

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > ngram, found).otherwise(0)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def measures(c: Column) -> list[Column]:
    """The transformed statistics of COMPONENTS, in whole units, as r0, r1, ...; of any value without words."""
    of = lambda part, whole: c[part] / F.greatest(c[whole], F.lit(1))
    share = lambda part, whole: F.asin(F.sqrt(of(part, whole)))
    values = [F.log(F.greatest(of("word_chars", "n_words"), F.lit(1))), share("n_signs", "word_chars"), share("n_capitals", "word_chars"), share("n_short", "n_words")]
    return [F.round(v * _UNIT).cast("long").alias(f"r{i}") for i, v in enumerate(values)]


def _vector(measured: DataFrame) -> DataFrame:
    """Columns x* from r*, the group's medians q* and n_words."""
    shrunk = lambda i: F.round((F.col(f"r{i}") - F.col(f"q{i}")) * F.col("n_words") / (F.col("n_words") + PRIOR_WORDS)).cast("long")
    return measured.select("*", *(shrunk(i).alias(f"x{i}") for i in range(_DIM)))


def _chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return high


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x*, m* and w*_* (the inverse of the scatter's Cholesky factor)."""
    out = F.lit(0.0)
    for i in range(_DIM):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        out = out + z * z
    return out


def _with_whitening(moments: DataFrame) -> DataFrame:
    """From columns m*, c*_* (scatter) to m*, w*_* and logdet. Variances below the floor, and what correlated components
    leave of them, are raised to it; others are as estimated."""
    df = moments
    for i in range(_DIM):
        df = df.withColumn(f"c{i}_{i}", F.greatest(f"c{i}_{i}", F.lit(_FLOORS[i] ** 2)))
    for i, j in _PAIRS:
        s = F.col(f"c{i}_{j}")
        for k in range(j):
            s = s - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(s, F.lit(_FLOORS[i] ** 2 / 16))) if i == j else s / F.col(f"l{j}_{j}"))
    for i, j in _PAIRS:
        value = F.lit(1.0 if i == j else 0.0)
        for k in range(j, i):
            value = value - F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}")
        df = df.withColumn(f"w{i}_{j}", value / F.col(f"l{i}_{i}"))
    logdet = sum((2 * F.log(F.col(f"l{i}_{i}")) for i in range(_DIM)), F.lit(0.0))
    return df.select("g", "s", *(f"m{i}" for i in range(_DIM)), *(f"w{i}_{j}" for i, j in _PAIRS), logdet.alias("logdet"))


_SUMS = [*(f"s{i}" for i in range(_DIM)), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _sums() -> list[Column]:
    return [F.sum(f"x{i}").alias(f"s{i}") for i in range(_DIM)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]


def _moments(sums: DataFrame, scale: float = 1.0) -> DataFrame:
    """Columns m*, c*_* from n and the sums."""
    df = sums
    for i in range(_DIM):
        df = df.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i, j in _PAIRS:
        df = df.withColumn(f"c{i}_{j}", (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale)
    return df


def _starts(fit: DataFrame, quartiles: DataFrame) -> DataFrame:
    """One estimate from quartile scales and some from small subsets, by group g and start s."""
    first = quartiles.select("g", F.lit(0).alias("s"), *(F.lit(0.0).alias(f"m{i}") for i in range(_DIM)), *(
        F.pow((F.col(f"upper{i}") - F.col(f"lower{i}")) / 1.349, F.lit(2.0)).alias(f"c{i}_{i}") if i == j else F.lit(0.0).alias(f"c{i}_{j}") for i, j in _PAIRS))
    drawn = F.filter(F.sequence(F.lit(1), F.lit(_SUBSETS)), lambda s: F.pmod(F.xxhash64("u", s), F.col("rows")) < _SUBSET)
    subsets = fit.select("g", F.explode(drawn).alias("s"), *(f"x{i}" for i in range(_DIM))).groupBy("g", "s").agg(F.count("*").alias("n"), *_sums())
    return _with_whitening(first).unionByName(_with_whitening(_moments(subsets)))


def _step(fit: DataFrame, now: DataFrame, rows: int, core: float, scale: float) -> DataFrame:
    """One concentration step of every (g, s) in now, a table of so many rows."""
    d = F.greatest(_distance(), F.lit(1e-9))
    binned = looked_up(fit, now, "g", rows, "inner").withColumn("bin", F.floor(_BINS * F.log2(d)).cast("int"))
    bins = binned.groupBy("g", "s", "bin").agg(F.count("*").alias("n"), *_sums())
    names = ["n", *_SUMS]
    upto = Window.partitionBy("g", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = bins.select("g", "s", F.sum("n").over(Window.partitionBy("g", "s")).alias("all"), *(F.col(c).alias(f"own_{c}") for c in names), *(F.sum(c).over(upto).alias(c) for c in names))
    wanted = core * F.col("all")
    edge = cum.filter((F.col("n") >= wanted) & (F.col("n") - F.col("own_n") < wanted)).withColumn("part", 1 - (F.col("n") - wanted) / F.col("own_n"))
    whole = edge.select("g", "s", *((F.col(c) - F.col(f"own_{c}") * (1 - F.col("part"))).alias(c) for c in names))
    return _with_whitening(_moments(whole, scale))


def _groups(good: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(k, g) for every language and source, as k, and the number of rows: g is its own where it has `least` rows, else the
    language's remaining rows together, else all remaining rows together, else null."""
    counts = good.groupBy("k", "lang", "source").agg(F.count("*").alias("n"))
    rest = F.when(F.col("n") < least, F.col("n")).otherwise(0)
    counts = written(counts.withColumn("in_lang", F.sum(rest).over(Window.partitionBy("lang"))), "groups")
    left = counts.filter((F.col("n") < least) & (F.col("in_lang") < least)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left"), F.count("*").alias("k"))
    enough = left.first()["left"] >= least
    g = (
        F.when(F.col("n") >= least, F.concat(F.lit("2"), "k"))
        .when(F.col("in_lang") >= least, F.concat(F.lit("1"), F.to_json(F.struct("lang"))))
        .otherwise(F.lit("0") if enough else F.lit(None).cast("string"))
    )
    return counts.select("k", g.alias("g")), counts.count()


def estimates(fit: DataFrame, quartiles: DataFrame, groups: int, core: float = 0.7, steps: int = 30) -> DataFrame:
    """(g, m*, w*_*, logdet): every group's estimate. fit holds g, rows, u (any hash) and x*, quartiles lower* and upper*.
    Steps go on until no group's logarithm of the determinant changes by more than 0.001, at most so many."""
    scale = core / _chi2_cdf(chi2_quantile(core, _DIM), _DIM + 2)
    now, rows = written(_starts(fit, quartiles), "centre"), groups * (1 + _SUBSETS)
    for _ in range(2):
        now = replaced_by(now, written(_step(fit, now, rows, core, scale), "centre"))
    best = now.groupBy("g").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("logdet", "s")).alias("e")).select("g", "e.*")
    now = replaced_by(now, written(best, "centre"))
    for _ in range(steps):
        new = written(_step(fit, now, groups, core, scale), "centre")
        moved = new.select("g", F.col("logdet").alias("new")).join(now.select("g", "logdet"), "g").agg(F.max(F.abs(F.col("new") - F.col("logdet")))).first()[0]
        now = replaced_by(now, new)
        if moved is None or moved < 1e-3:
            break
    return now.drop("s")


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    core: float = 0.7, tail: float = 1e-8, least: int = 60, carry: bool = False,
) -> DataFrame:
    """Per row: doc_id, COUNTS, base_failed, distance (squared; null if base_failed or ungrouped), kept and, if asked for,
    row, a struct of all its columns, which no count can clash with.

    Documents that fail the base rules take no part in the estimates. Null text is empty and fails; null languages and
    sources are groups of their own; groups of fewer than `least` rows join others of the language, then all others;
    if even those are too few, they are kept, as nothing can be estimated. Repeated rows count and are judged each, ids
    play no part; very long texts are one vector like others; an empty table gives an empty one. `core` is the share
    that concentration steps keep (more than the rest of a group may be outliers only at the estimate's cost), `tail`
    the chi-square tail of the cut.
    """
    named = [F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text_counts(F.col(text_col)).alias("c")]
    first = docs.select(*named, *([F.struct(*docs.columns).alias("row")] if carry else []))
    more = ["row"] if carry else []
    first = first.select("doc_id", "lang", "source", F.to_json(F.struct("lang", "source")).alias("k"), "c.*", base_failed(F.col("c")).alias("base_failed"), *more)
    counted = written(first, "counts")
    good = counted.filter(~F.col("base_failed"))
    keys, n = _groups(good, least)
    measured = good.select("k", "n_words", *measures(F.struct(*COUNTS)), F.xxhash64("doc_id", "n_words", "word_chars").alias("u"))
    measured = looked_up(measured, keys, "k", n, "inner").filter(F.col("g").isNotNull())
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))  # of whole numbers from a narrow range, so exact percentiles stay small
    quartiles = measured.groupBy("g").agg(F.count("*").alias("rows"), *(F.percentile(f"r{i}", at).alias(f"p{i}") for i in range(_DIM)))
    names = [F.col(f"p{i}")[k].alias(f"{name}{i}") for i in range(_DIM) for k, name in enumerate(("lower", "q", "upper"))]
    quartiles = written(quartiles.select("g", "rows", *names), "quartiles")
    medians = quartiles.select("g", "rows", *(f"q{i}" for i in range(_DIM)))
    fit = written(_vector(looked_up(measured, medians, "g", n)).select("g", "rows", "u", *(f"x{i}" for i in range(_DIM))), "vectors")
    verdicts = keys.join(medians.drop("rows").join(estimates(fit, quartiles, n, core), "g"), "g", "left").drop("g")
    each = counted.select("doc_id", "k", *COUNTS, "base_failed", *more, *measures(F.struct(*COUNTS)))
    each = _vector(looked_up(each, verdicts, "k", n))
    distance = F.when(~F.col("base_failed"), _distance())
    fits = ~F.col("base_failed") & F.coalesce(distance <= chi2_quantile(1 - tail, _DIM), F.lit(True))
    return each.select("doc_id", *COUNTS, "base_failed", distance.alias("distance"), fits.alias("kept"), *more)
