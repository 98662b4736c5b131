"""Ratings gathered to one prediction for each evaluator, condition and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ratings as R

#: What a case is known by, with what it determines.
KEY = ("item_id", "case_name", "article", "grp", "violation_label")


def _vote() -> Column:
    """The most frequent class; of equally frequent ones the one that came first."""
    kinds = []
    for name in (R.VIOLATION, R.NO_VIOLATION, R.ABSTENTION):
        hit = R.class_of(F.col("rating")) == name
        kinds.append(F.struct(F.count_if(hit).alias("n"), (-F.min(F.when(hit, F.col("sample_idx")))).alias("first"), F.lit(name).alias("name")))
    return F.array_max(F.array(*kinds))


def predictions(ratings: DataFrame, *groups: str) -> DataFrame:
    """One row for each of ``groups`` (evaluator and condition if none are given) and case, in one aggregation.

    Null ratings count in ``num_samples`` but not in the mean or the vote; without any rating the mean and the prediction are null.
    """
    by = [*(groups or ("evaluator", "condition")), *KEY]
    vote = _vote()
    rows = ratings.groupBy(*by).agg(
        F.avg("rating").alias("avg_rating"),
        F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "rating"))), lambda x: x["rating"]).alias("ratings"),
        F.count(F.lit(1)).alias("num_samples"),
        F.count_if(F.col("rating") == 3).alias("num_abstentions"),
        vote.alias("vote"),
    )
    is_violation = F.col("violation_label") == R.VIOLATION
    return rows.select(
        *by,
        is_violation.alias("is_violation"),
        "avg_rating",
        "ratings",
        "num_samples",
        "num_abstentions",
        F.when(F.col("vote.n") > 0, F.col("vote.name")).alias("prediction"),
        R.accurate(F.col("avg_rating"), is_violation).alias("accurate"),
        F.when(F.col("vote.n") > 0, F.col("vote.name") == R.ABSTENTION).alias("abstained"),
    )


def abstention_rate(predicted: DataFrame, *groups: str) -> DataFrame:
    """Abstentions among all samples, 0 without any."""
    rate = F.coalesce(F.try_divide(F.sum("num_abstentions"), F.sum("num_samples")), F.lit(0.0))
    return predicted.groupBy(*groups).agg(F.sum("num_abstentions").alias("abstentions"), F.sum("num_samples").alias("samples"), rate.alias("abstention_rate"))


def stitched(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Every request with its answer's rating; a missing or failed answer is neutral. Of several answers the least counts."""
    got = answers.groupBy(*keys).agg(F.min(R.rating_of(F.col("response"), F.col("status"), None)).alias("got"))
    return requests.join(got, keys, "left").withColumn("rating", F.coalesce("got", F.lit(R.NEUTRAL))).drop("got")


def work_list(cases: DataFrame, evaluators: list[str], conditions: list[str], samples: int, done: DataFrame | None = None) -> DataFrame:
    """All (evaluator, condition, case, sample) but for the (evaluator, condition) that ``done`` has. No shuffle: the
    dimensions are literals, and what is done is small."""
    out = cases
    for name, values in (("evaluator", evaluators), ("condition", conditions)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    if done is not None:
        out = out.join(done.select("evaluator", "condition").distinct(), ["evaluator", "condition"], "left_anti")
    return out.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def request_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)
