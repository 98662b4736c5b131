"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates for each language and source.

A document's statistics are counts over all of its text: letters, capitals and words among characters, words with
digits, repeated words and repeated lines. They become shares, drawn towards the group's own share as if ``PRIOR`` more characters or words
had been seen, and then arcsines of roots, whose variance doesn't depend on the share. Of each group's vectors the MCD seeks
the ``PART`` with the least determinant of covariance, to which ``FLOOR`` squared is added in every direction (the regularized
form, which is defined where a group doesn't vary). The search is that of the fast algorithm: concentration steps (distances,
the part that is nearest, its mean and covariance) from ``STARTS`` random starts and from medians on a bounded sample of the
group, then from the best ``BEST`` of these over all of its vectors, until no determinant falls by more than ``STILL``; the
least is taken. A step over all is one pass over the narrow table of vectors that sums products by group, start and interval of
distance, in the JVM with map-side combining; the rest works on a row for each group. The interval that completes the part
counts with the weight that it needs for that. A document is rejected if its squared Mahalanobis distance is beyond the
chi-squared quantile of ``LEVEL``.

A group of fewer than ``LEAST_ROWS`` documents takes its language's estimates over all sources; a language of fewer takes
those of all documents. If these are fewer, nothing is rejected and the distance is null. Every coordinate's variance has a
floor, so that coordinates in which a group doesn't vary do no harm.

Cases: a null or empty text has no counts, stands at the group's own shares, and its ``distance`` is null and it isn't
rejected; null language or source is a group of its own; texts of any length count whole; equal distances fall in one
interval, which the nearest part has or lacks as a whole; repeated rows count and are reported each, as do rows of null
``doc_id``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, cut, small, table

PART, LEVEL, LEAST_ROWS, PRIOR, FLOOR, STILL = 0.75, 0.9999, 50, 60, 0.03, 1e-3

#: Vectors of a group from which starts are made, starts, those that have more than two steps on these, and those that go on over all.
SAMPLE, STARTS, LONGER, BEST = 500, 150, 10, 2

#: (name, count, out of)
SHARES = (("letters", "letters", "solid"), ("capitals", "capitals", "letters"), ("numbers", "numbers", "words"), ("words", "words", "solid"), ("repeated", "again", "words"), ("lines", "same", "rows"))
COUNTS = ("solid", "letters", "capitals", "numbers", "words", "again", "rows", "same")
P = len(SHARES)
X = tuple(f"x{k}" for k in range(P))
PAIRS = tuple(combinations_with_replacement(range(P), 2))

#: Intervals of distance in a factor of e.
FINE = 200


def counts_of(texts: list) -> np.ndarray:
    """A row for each text, with COUNTS; a word counts as repeated if the two before it and itself came together earlier."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for a, b in chunked(texts):
        points, begins = tn.join(texts[a:b])
        kind, low = tn.kinds(points), tn.lowered(points)
        n = b - a
        add = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64)
        letter, digit = kind == tn.LETTER, kind == tn.NUMBER
        part = [add((kind != tn.SPACE) & (kind != tn.END)), add(letter), add(letter & (low != points))]
        starts, ends = tn.runs(letter | digit)
        row = np.searchsorted(begins, starts, "right") - 1
        upto = np.concatenate(([0], np.cumsum(digit)))
        part.append(np.bincount(row[upto[ends] > upto[starts]], minlength=n))
        h = tn.hashes_of(low, starts, ends)
        part.append(np.bincount(row, minlength=n))
        part.append(_again(row, tn.mix(h[:-2]) + tn.mix(h[1:-1], 1) + tn.mix(h[2:], 2), 3, n) if len(h) > 2 else np.zeros(n, np.int64))
        stop = np.flatnonzero((points == 10) | (kind == tn.END))
        start = np.concatenate(([0], stop[:-1] + 1))
        full = stop - start > 1
        start, stop = start[full], stop[full]
        row = np.searchsorted(begins, start, "right") - 1
        part += [np.bincount(row, minlength=n), _again(row, tn.hashes_of(low, start, stop), 1, n)]
        out[a:b] = np.column_stack(part)
    return out


def _again(row: np.ndarray, hashes: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each text, how many of its windows of ``size`` items repeat an earlier one of it."""
    whole = row[: len(hashes)] == row[size - 1 :]
    owner, key = row[: len(hashes)][whole], hashes[whole]
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    same = np.concatenate(([False], (owner[1:] == owner[:-1]) & (key[1:] == key[:-1]))) if len(key) else np.zeros(0, bool)
    return np.bincount(owner[same], minlength=n)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and COUNTS for each row of ``docs``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = counts_of(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(got[:, k]) for k in range(len(COUNTS)))], [*keep, *COUNTS])

    types = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), *(f"{c} bigint" for c in COUNTS)]))


def grouped(stats: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``stats`` with ``g``, the group whose estimates a row takes: source, language or all; null if all are too few."""
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_source"))
    langs = sizes.groupBy("lang").agg(F.sum("n_source").alias("n_lang"))
    every = langs.agg(F.sum("n_lang").alias("n_all"))
    name = lambda *c: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), x), F.lit("null")) for x in map(F.col, c)))
    g = F.when(F.col("n_source") >= least_rows, name("lang", "source")).when(F.col("n_lang") >= least_rows, name("lang")).when(F.col("n_all") >= least_rows, F.lit(""))
    known = sizes.join(langs.withColumnRenamed("lang", "l"), F.expr("lang <=> l")).crossJoin(every).select(F.col("lang").alias("l"), F.col("source").alias("s"), g.alias("g"))
    return stats.join(known, F.expr("lang <=> l and source <=> s")).drop("l", "s")


def vectors(rows: DataFrame, keep: list[str], prior: int = PRIOR) -> DataFrame:
    """``keep``, ``g`` and X for each row of ``rows`` that has a group."""
    ratio = [F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)).alias(f"r{k}") for k, (_, a, b) in enumerate(SHARES)]
    shares = rows.groupBy("g").agg(*ratio)
    x = [F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(a) + prior * F.col(f"r{k}")) / (F.col(b) + prior)))).alias(X[k]) for k, (_, a, b) in enumerate(SHARES)]
    return rows.where("g is not null").join(shares, "g").select(*keep, "g", *x)


def _distance(m: list[Column], s: list[Column]) -> Column:
    """Squared Mahalanobis distance, from the means and the rows of the inverse covariance's upper triangle."""
    d = [F.col(X[k]) - m[k] for k in range(P)]
    terms = [(s[k] * d[i] * d[j]) * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _solved(covariance: np.ndarray) -> tuple[list[float], float]:
    inverse = np.linalg.inv(covariance)
    return [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(covariance)[1])


ESTIMATE = "g string, start int, m array<double>, s array<double>, logdet double, cut int"


def _covariance(x: np.ndarray, weight: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance with its factor and floor, and log determinant, of weighted rows."""
    n = weight.sum()
    m = weight @ x / n
    c = factor * ((x - m).T * weight) @ (x - m) / n + FLOOR**2 * np.eye(x.shape[1])
    return m, c, float(np.linalg.slogdet(c)[1])


def _step(x: np.ndarray, m: np.ndarray, c: np.ndarray, part: float, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    weight = np.zeros(len(x))
    weight[np.argsort(d, kind="stable")] = np.clip(part * len(x) - np.arange(len(x)), 0, 1)
    return _covariance(x, weight, factor)


def best_starts(x: np.ndarray, part: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The BEST estimates from concentration steps over few vectors: from medians, and from random subsets of one more than
    the dimensions."""
    rng, factor = np.random.default_rng(seed), _consistency(part)
    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
    found = [(middle, np.diag(spread**2 + FLOOR**2), np.inf)]
    for _ in range(STARTS):
        some = x[rng.permutation(len(x))[: x.shape[1] + 1]]
        found.append(_covariance(some, np.ones(len(some)), 1.0))
    for _ in range(2):
        found = [_step(x, m, c, part, factor) for m, c, _ in found]
    done: list = []
    for now in sorted(found, key=lambda e: e[2])[:LONGER]:
        while (new := _step(x, *now[:2], part, factor))[2] < now[2] - STILL / 10:
            now = new
        if all(np.abs(now[0] - e[0]).max() > 1e-9 or abs(now[2] - e[2]) > 1e-9 for e in done):
            done.append(now)
    return sorted(done, key=lambda e: e[2])[:BEST]


def _start(points: DataFrame, part: float) -> DataFrame:
    """The starts of each group, from the SAMPLE vectors with the lowest hash."""
    order = Window.partitionBy("g").orderBy(F.xxhash64(*X), *X)
    few = points.select("g", *X).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SAMPLE).drop("_k")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = best_starts(rows[list(X)].to_numpy(), part)
        return pd.DataFrame({"g": [rows["g"].iloc[0]] * len(found), "start": range(len(found)), "m": [m for m, _, _ in found], "s": [_solved(c)[0] for _, c, _ in found], "logdet": np.inf, "cut": 1})

    return few.groupBy("g").applyInPandas(run, ESTIMATE)


def chi2_quantile(p: float, k: int) -> float:
    """Of an even number of degrees, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        term = total = 1.0
        for j in range(1, k // 2):
            term *= mid / 2 / j
            total += term
        low, high = (mid, high) if 1 - np.exp(-mid / 2) * total < p else (low, mid)
    return low


def _consistency(part: float) -> float:
    """What the covariance of the nearest ``part`` of normal vectors is multiplied with."""
    q = chi2_quantile(part, P)
    term = total = 1.0
    for j in range(1, P // 2 + 1):
        term *= q / 2 / j
        total += term
    return part / (1 - np.exp(-q / 2) * total)


def _concentrated(points: DataFrame, old: DataFrame, part: float) -> DataFrame:
    """The estimates from the nearest ``part`` of each group, by the distances of ``old``."""
    near = points.join(old.select("g", "start", "m", "s", F.col("logdet").alias("before")), "g")
    d = _distance([F.get("m", F.lit(k)) for k in range(P)], [F.get("s", F.lit(k)) for k in range(len(PAIRS))])
    binned = near.withColumn("b", F.ceil(F.log(d + 1e-6) * FINE).cast("int"))
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)]
    by = binned.groupBy("g", "start", "before", "b").agg(F.count(F.lit(1)).alias("n"), *sums)
    factor = _consistency(part)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        n = rows["n"].to_numpy(float)
        weight = np.clip((part * n.sum() - (np.cumsum(n) - n)) / n, 0, 1)
        whole = weight @ n
        m = weight @ rows[[f"s{k}" for k in range(P)]].to_numpy() / whole
        c = np.zeros((P, P))
        for k, (i, j) in enumerate(PAIRS):
            c[i, j] = c[j, i] = weight @ rows[f"p{k}"].to_numpy() / whole - m[i] * m[j]
        s, logdet = _solved(c * factor + FLOOR**2 * np.eye(P))
        fell = rows["before"].iloc[0] - logdet > STILL
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "start": [rows["start"].iloc[0]], "m": [m], "s": [s], "logdet": [logdet], "cut": [int(fell)]})

    return by.groupBy("g", "start").applyInPandas(solve, ESTIMATE)


def estimates(points: DataFrame, part: float = PART) -> DataFrame:
    """(g, start, m, s, logdet, cut): the MCD of each group of ``points``, a row each."""
    found, ended = cut(_start(points, part)), []
    while True:
        new = cut(_concentrated(points, found, part))
        ended.append(new.where("cut = 0"))
        found = new.where("cut = 1")
        if not found.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, ended)
    return cut(every.groupBy("g").agg(F.min_by(F.struct(*[c for c in every.columns if c != "g"]), F.struct("logdet", "start")).alias("e")).select("g", "e.*"))


def scored(docs: DataFrame, keep: list[str], level: float = LEVEL, part: float = PART, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``keep`` with ``distance``, squared, and ``rejected``, for each row of ``docs``."""
    own = list(dict.fromkeys([*keep, "lang", "source"]))
    rows = grouped(cut(statistics(docs, own)), least_rows)
    points = cut(vectors(rows, [*own, "solid"]))
    found = estimates(points.where("solid > 0").select("g", *X), part)
    d = _distance([F.get("m", F.lit(k)) for k in range(P)], [F.get("s", F.lit(k)) for k in range(len(PAIRS))])
    near = points.join(found.select("g", "m", "s"), "g", "left").select(*keep, "g", F.when(F.col("solid") > 0, d).alias("distance"))
    without = rows.where("g is null").select(*keep, F.lit(None).cast("string").alias("g"), F.lit(None).cast("double").alias("distance"))
    return near.unionByName(without).withColumn("rejected", F.coalesce(F.col("distance") > chi2_quantile(level, P), F.lit(False)))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), *(F.col(c).cast("string") for c in ("text", "lang", "source")))


def outliers(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """(doc_id, lang, source, distance, rejected) of every document."""
    return scored(_slim(docs), ["doc_id", "lang", "source"], level).select("doc_id", "lang", "source", "distance", "rejected")


def without_outliers(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs``, the columns of documents, whose ``doc_id`` isn't rejected in any row; null ids stay."""
    gone = outliers(docs, level).where("rejected").select("doc_id").distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(table(spark, sf_dir, "documents"))
