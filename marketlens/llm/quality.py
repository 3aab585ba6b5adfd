"""Quality rules with robust multivariate outliers.

Text statistics are transformed to a vector. For each language and source the minimum
covariance determinant estimator gives a centre and a covariance that outliers don't
move, and a document is rejected by its Mahalanobis distance. The estimator's
concentration steps run over all rows, as Spark aggregations by group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_groups
from .textops import gram_hashes, read_words, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, GAPS = "#*$%&|<>", " \t\n\v\f\r"
REPEAT = 5
#: The dimensions' least standard deviations, in transformed units: many texts have no symbols and no repeats at all.
FLOORS = (0.5, 0.1, 0.1, 0.2, 0.2)
#: Texts are counted in slices of about so many bytes.
SLICE = 1 << 20
#: A group's estimate is drawn towards its language's as by so many rows of it, that towards the whole table's, and
#: that towards a spread of WIDE in each dimension; so a small group weighs little, and no size is a threshold.
PRIOR = 50
WIDE = (2.0, 0.5, 0.5, 0.5, 0.5)
#: The share of rows that a concentration step keeps. Steps go on until no group's log determinant falls by more than STABLE.
SHARE, STABLE = 0.75, 0.01
#: Distances are counted in so many bins to the octave, from 2**-20 to 2**40.
OCTAVE, LOWEST, HIGHEST = 16, -20, 40


def text_statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, source, text) -> the first three and COUNTS."""
    for batch in slices(batches, size=SLICE):
        texts = batch.column(3).to_pylist()
        words = read_words(texts)
        grams = gram_hashes(words.hashes, REPEAT, 7)
        rows = []
        for text, (a, b) in zip(texts, words.per_text(), strict=True):
            text = text or ""
            lines = [x for x in text.split("\n") if x.strip(GAPS)]
            repeated = 0
            if b - a > REPEAT:
                own = grams[a : b - REPEAT + 1]
                ordered = np.sort(own)
                twice = ordered[1:][ordered[1:] == ordered[:-1]]
                if len(twice):
                    edges = np.zeros(b - a + 1, np.int64)
                    at = np.flatnonzero(np.isin(own, twice))
                    edges[at] += 1
                    edges[at + REPEAT] -= 1
                    repeated = int((np.cumsum(edges[:-1]) > 0).sum())
            chars = len(text) - sum(map(text.count, GAPS))
            rows.append((b - a, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["doc_id", "lang", "source", *COUNTS])


def vector() -> list[Column]:
    """The transformed statistics; a word length of 5 stands for 20 further words, so short texts vary less."""
    n = F.col("n_words").cast("double")
    share = lambda c: F.sqrt(F.col(c) / F.greatest(n, F.lit(1.0)))
    return [F.log1p(n), F.log((F.col("word_chars") + 100.0) / (n + 20.0)), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution, by the series of the incomplete gamma function."""
    term = total = 1 / (k / 2)
    for i in range(1, 1000):
        term *= (x / 2) / (k / 2 + i)
        total += term
    return min(1.0, total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _square(upper: list[float], d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def _floored(cov: np.ndarray, floors: tuple[float, ...]) -> np.ndarray:
    """A covariance whose variances are at least the floors' squares."""
    cov = cov.copy()
    i = np.diag_indices(len(floors))
    cov[i] = np.maximum(cov[i], 0)
    cov[i] += np.maximum(np.square(floors) - cov[i], 0)
    return cov


_ESTIMATE = "group string, size double, centre array<double>, cov array<double>, precision array<double>, logdet double"


def _shape(batches: Iterable[pa.RecordBatch], floors: tuple[float, ...], correct: float) -> Iterator[pa.RecordBatch]:
    """(group, size, n, sums, products) -> _ESTIMATE."""
    d = len(floors)
    floats = pa.list_(pa.float64())
    for batch in batches:
        rows = []
        for n, s, q in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
            mean = np.array(s) / n
            cov = (_square(q, d) / n - np.outer(mean, mean)) * correct
            full = _floored(cov, floors)
            rows.append((mean.tolist(), cov.ravel().tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.slogdet(full)[1])))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, floats) for c in columns[:3]], pa.array(columns[3], pa.float64())], ["group", "size", "centre", "cov", "precision", "logdet"])


def distance(x: Column, centre: Column, precision: Column, d: int) -> Column:
    """Squared Mahalanobis distance."""
    away = [x[i] - centre[i] for i in range(d)]
    return sum(((away[i] * away[j] * precision[i * d + j]) for i in range(d) for j in range(d)), F.lit(0.0))


def _group(level: int) -> Column:
    """A key for a row's source, language or everything."""
    parts = [F.lit(str(level)), *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source")[: 2 - level]]]
    return F.to_json(F.array(*parts))


def mcd(rows: DataFrame, floors: tuple[float, ...], share: float = SHARE) -> DataFrame:
    """(group, id, x) -> (group, size, centre, cov, precision, logdet) by concentration steps until the determinants are stable.

    They start from medians and quartiles, which are as robust. A step is one pass: moments are summed by group and
    bin of distance, combined before the shuffle; the nearest bins that make up the share are
    kept, of the last one as large a part as is needed. A group is never in one place, so it may be of any size.
    """
    d = len(floors)
    inner = chi2_quantile(share, d)
    correct = share / chi2_cdf(inner, d + 2)  # a covariance of the nearest rows is too small
    start = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(d)])
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(d)]
    diagonal = F.array(*[1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    first = start.select("group", F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("centre"), diagonal.alias("precision"))
    best = cut(first.select("group", F.lit(0.0).alias("size"), "centre", F.lit(None).cast("array<double>").alias("cov"), "precision", F.lit(float("inf")).alias("logdet"), F.lit(True).alias("open")))
    x = [F.col("x")[i] for i in range(d)]
    moments = [F.lit(1.0), *x, *[x[i] * x[j] for i in range(d) for j in range(i, d)]]
    names = [f"m{k}" for k in range(len(moments))]
    place = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**LOWEST))) * OCTAVE).cast("int")
    w = Window.partitionBy("group").orderBy("bin")
    before = F.coalesce(F.sum("m0").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a group goes on only as long as its determinant falls, and determinants have a floor, so this ends
    while not (going := best.filter("open").select("group", "centre", "precision")).isEmpty():
        far = join_groups(rows, going, "group", "id").select("group", "x", distance(F.col("x"), F.col("centre"), F.col("precision"), d).alias("d2"))
        binned = far.groupBy("group", F.least(place, F.lit(HIGHEST * OCTAVE)).alias("bin")).agg(*[F.sum(m).alias(n) for m, n in zip(moments, names, strict=True)])
        # at most (HIGHEST - LOWEST) * OCTAVE bins of a group come together
        part = F.least(F.greatest((F.col("size") * share - F.col("before")) / F.col("m0"), F.lit(0.0)), F.lit(1.0))
        near = binned.withColumns({"before": before, "size": F.sum("m0").over(Window.partitionBy("group"))}).withColumn("part", part).filter("part > 0")
        sums = near.groupBy("group", "size").agg(*[F.sum(F.col(n) * F.col("part")).alias(n) for n in names])
        packed = sums.select("group", "size", "m0", F.array(*names[1 : d + 1]), F.array(*names[d + 1 :]))
        found = packed.mapInArrow(lambda it: _shape(it, floors, correct), _ESTIMATE)
        new = found.select("group", F.struct("size", "centre", "cov", "precision", "logdet").alias("new"))
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - STABLE, F.lit(False))
        columns = [F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "centre", "cov", "precision", "logdet")]
        best = cut(best.join(new, "group", "left").select("group", *columns, falls.alias("open")))
    return best.drop("open")


def _drawn(batches: Iterable[pa.RecordBatch], floors: tuple[float, ...], prior: float, wide: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    """(group, and size, centre, cov of it, its language and the table) -> (group, centre, precision), each drawn towards the next."""
    d = len(floors)
    floats = pa.list_(pa.float64())
    for batch in batches:
        centres, precisions = [], []
        for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
            centre, cov = np.array(row[7]), np.diag(np.square(wide))
            for size, own, spread in (row[6:9], row[3:6], row[0:3]):
                a = size / (size + prior)
                away = np.array(own) - centre
                cov = a * np.reshape(spread, (d, d)) + (1 - a) * cov + a * (1 - a) * np.outer(away, away)
                centre = centre + a * away
            centres.append(centre.tolist())
            precisions.append(np.linalg.inv(_floored(cov, floors)).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, floats), pa.array(precisions, floats)], ["group", "centre", "precision"])


def judge(docs: DataFrame, keep: float = 0.9999, floors: tuple[float, ...] = FLOORS, prior: float = PRIOR, wide: tuple[float, ...] = WIDE) -> DataFrame:
    """doc_id, COUNTS, base_failed, distance2 and kept for every row of docs.

    A document fails the base rules with under 10 words, or if more than a fifth of its words
    repeat; what passes is rejected if its squared distance from its language and source's estimate is beyond the chi-squared quantile `keep`
    (one right at it is kept). That estimate is of the group's own rows, drawn towards the language's and the table's as by `prior` rows.
    Null and empty texts have no words and null languages and sources are groups of their own; very long texts are counted whole.
    Repeated rows all count. Other columns are left out; an empty table gives an empty one.
    """
    d = len(floors)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    stats = rows.mapInArrow(text_statistics, f"doc_id long, lang string, source string, {counts}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    own = {f"g{level}": _group(level) for level in (0, 1, 2)}
    stats = cut(stats.withColumns({"base_failed": failed, "x": F.array(*vector()), **own}).withColumn("id", F.xxhash64("doc_id", "n_words", "word_chars")).drop("lang", "source"))
    passed = stats.filter(~F.col("base_failed"))
    shape = mcd(passed.select("id", "x", F.explode(F.array(*own)).alias("group")), floors)
    groups = passed.select(*own).distinct()
    for level in (0, 1, 2):
        side = shape.select(F.col("group").alias(f"g{level}"), *[F.col(c).alias(f"{c}{level}") for c in ("size", "centre", "cov")])
        groups = groups.join(side, f"g{level}")
    wanted = groups.select("g0", *[f"{c}{level}" for level in (0, 1, 2) for c in ("size", "centre", "cov")])
    drawn = cut(wanted.mapInArrow(lambda it: _drawn(it, floors, prior, wide), "group string, centre array<double>, precision array<double>"))
    known = join_groups(stats.withColumnRenamed("g0", "group"), drawn, "group", "id", "left")
    known = known.withColumn("distance2", distance(F.col("x"), F.col("centre"), F.col("precision"), d))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(keep, d), F.lit(True))
    return known.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance2")


def op9(docs: DataFrame) -> DataFrame:
    return judge(docs)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """doc_id, COUNTS and base_failed, counted word by word."""
    import re

    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + REPEAT]) for i in range(len(words) - REPEAT + 1)]
        seen = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + REPEAT)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        out.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n))
    return out
