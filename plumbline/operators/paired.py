"""Paired tests of conditions against a baseline: one aggregation by case, one by test, whatever the number of tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ratings as R
from plumbline.functions import stats as S
from plumbline.operators.predictions import KEY

RESAMPLES, SEED = 10_000, 42


def pairs(predicted: DataFrame, baseline: str, conditions: list[str], rule: str = "lt3") -> DataFrame:
    """A row for each evaluator, condition and case that has both: what the baseline (a) and the condition (b) say.

    The cases are gathered by key once; no self-join. Several predictions for one case and condition count by the least.
    """
    base = F.min(F.when(F.col("condition") == baseline, F.col("avg_rating")))
    others = F.collect_list(F.when(F.col("condition").isin(conditions), F.struct("condition", "avg_rating")))
    both = predicted.where(F.col("condition").isin([baseline, *conditions])).groupBy("evaluator", *KEY).agg(base.alias("avg_a"), others.alias("b"))
    rows = both.where("avg_a is not null").select("evaluator", *KEY, "avg_a", F.inline("b")).withColumnRenamed("avg_rating", "avg_b")
    label = F.col("violation_label") == R.VIOLATION
    return rows.select(
        "evaluator", "condition", *KEY, "avg_a", "avg_b",
        R.says_violation(F.col("avg_a"), rule).alias("says_a"), R.says_violation(F.col("avg_b"), rule).alias("says_b"),
        R.right(F.col("avg_a"), label, rule).alias("right_a"), R.right(F.col("avg_b"), label, rule).alias("right_b"),
    )


def tests(paired: DataFrame, *groups: str) -> DataFrame:
    """Accuracies, discordant counts, exact p, alignment with its interval, effect size and verdict for each test."""
    a, b = F.col("right_a"), F.col("right_b")
    counts = paired.groupBy(*(groups or ("evaluator", "condition"))).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a.cast("double")).alias("accuracy_a"),
        F.avg(b.cast("double")).alias("accuracy_b"),
        F.count_if(~a & b).alias("n01"),
        F.count_if(a & ~b).alias("n10"),
        F.count_if(F.col("says_a") == F.col("says_b")).alias("aligned"),
    )
    low, high = S.wilson(F.col("aligned"), F.col("n"))
    full = counts.withColumns({"difference": F.col("accuracy_b") - F.col("accuracy_a"), "p_value": S.mcnemar_exact(F.col("n01"), F.col("n10")), "alignment": F.try_divide("aligned", "n"), "alignment_low": low, "alignment_high": high})
    return full.withColumns({"significant": F.col("p_value") < S.ALPHA, "verdict": S.verdict(F.col("p_value"), F.col("difference"))})


def bootstrap(paired: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(evaluator, condition, difference, ci_low, ci_high): percentiles of resampled mean differences, a draw of indices for
    each resample, from the cases in the order of their keys. One test's differences, a byte each, are held by one worker."""
    rows = paired.select("evaluator", "condition", "item_id", "article", "grp", (F.col("right_b").cast("int") - F.col("right_a").cast("int")).cast("byte").alias("d"))

    def resample(group: pd.DataFrame) -> pd.DataFrame:
        d = group.sort_values(["item_id", "article", "grp"])["d"].to_numpy()
        rng = np.random.RandomState(seed)
        means = np.fromiter((d[rng.choice(len(d), size=len(d), replace=True)].mean() for _ in range(resamples)), float, resamples)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"evaluator": group["evaluator"].iloc[:1], "condition": group["condition"].iloc[:1], "difference": float(d.mean()), "ci_low": low, "ci_high": high})

    return rows.groupBy("evaluator", "condition").applyInPandas(resample, "evaluator string, condition string, difference double, ci_low double, ci_high double")


def bootstrap_from_counts(tested: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """The same interval for tests of any size: as a difference has three values, the counts of a resample are multinomial.
    It takes one row for each test (n, n01, n10) and no case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, x in batch.iterrows():
                p = np.array([x.n01, x.n10, x.n - x.n01 - x.n10]) / x.n
                drawn = np.random.RandomState(seed).multinomial(x.n, p, resamples)
                low, high = np.percentile((drawn[:, 0] - drawn[:, 1]) / x.n, [2.5, 97.5])
                out.append((x.evaluator, x.condition, (x.n01 - x.n10) / x.n, low, high))
            yield pd.DataFrame(out, columns=["evaluator", "condition", "difference", "ci_low", "ci_high"])

    return tested.where("n > 0").select("evaluator", "condition", "n", "n01", "n10").mapInPandas(run, "evaluator string, condition string, difference double, ci_low double, ci_high double")


def adjusted(tested: DataFrame) -> DataFrame:
    """``tested`` with Holm's, Bonferroni's and Benjamini and Hochberg's adjusted p; a row for each test, so one window."""
    from pyspark.sql import Window

    order = Window.orderBy("p_value", "evaluator", "condition")
    every, falling = Window.partitionBy(), Window.orderBy(F.desc("p_value"), F.desc("evaluator"), F.desc("condition"))
    ranked = tested.withColumns({"rank": F.row_number().over(order), "m": F.count(F.lit(1)).over(every)})
    p = F.col("p_value")
    return ranked.withColumns({
        "p_bonferroni": F.least(F.lit(1.0), p * F.col("m")),
        "p_holm": F.max(F.least(F.lit(1.0), p * (F.col("m") - F.col("rank") + 1))).over(order),
        "p_bh": F.min(F.least(F.lit(1.0), p * F.col("m") / F.col("rank"))).over(falling),
    })
