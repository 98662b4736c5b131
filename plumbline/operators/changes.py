"""How ratings change between two conditions: directions, categories, magnitudes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ratings as R


def directional(paired: DataFrame, *groups: str) -> DataFrame:
    """Of mean ratings (avg_a, avg_b): the share changed, and of the changes the shares in either direction, to and from 3,
    and the mean magnitude; zeros without a change."""
    a, b = F.col("avg_a"), F.col("avg_b")
    part = lambda hit: F.coalesce(F.try_divide(100.0 * F.count_if(hit), F.count_if(a != b)), F.lit(0.0))
    return paired.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a != b).alias("changes"),
        F.coalesce(F.try_divide(100.0 * F.count_if(a != b), F.count(F.lit(1))), F.lit(0.0)).alias("pct_changed"),
        part(b < a).alias("pct_toward"),
        part(b > a).alias("pct_away"),
        part((a != 3) & (b == 3)).alias("pct_to_abstention"),
        part((a == 3) & (b != 3)).alias("pct_from_abstention"),
        F.coalesce(F.avg(F.when(a != b, F.abs(b - a))), F.lit(0.0)).alias("avg_magnitude"),
    )


def sample_pairs(ratings: DataFrame, before: str, after: str) -> DataFrame:
    """Every sample's rating under both conditions, from one aggregation by case and sample; samples that lack one are left out."""
    of: Column = F.col("rating")
    keys = ["evaluator", "item_id", "case_name", "article", "grp", "violation_label", "sample_idx"]
    got = ratings.where(F.col("condition").isin(before, after)).groupBy(*keys).agg(F.min(F.when(F.col("condition") == before, of)).alias("before"), F.min(F.when(F.col("condition") == after, of)).alias("after"))
    return got.where("before is not null and after is not null")


def unzipped(cases: DataFrame, before: str, after: str) -> DataFrame:
    """A row for each position of two parallel arrays; the shorter one's length counts."""
    both = F.arrays_zip(F.col(before).alias("before"), F.col(after).alias("after"))
    rest = [c for c in cases.columns if c not in (before, after)]
    return cases.select(*rest, F.posexplode(both).alias("sample_idx", "x")).select(*rest, "sample_idx", "x.before", "x.after").where("before is not null and after is not null")


def sample_directions(samples: DataFrame, *groups: str) -> DataFrame:
    b, a = F.col("before"), F.col("after")
    return samples.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(b != a).alias("changed"), F.count_if(a < b).alias("toward"), F.count_if(a > b).alias("away"),
        F.coalesce(F.avg(F.when(b != a, F.abs(a - b))), F.lit(0.0)).alias("avg_magnitude"),
    )


def categories(samples: DataFrame, *groups: str) -> DataFrame:
    c = R.change_category(F.col("before"), F.col("after"))
    return samples.groupBy(*groups).agg(*(F.count_if(c == name).alias(name) for name in ("unchanged", "flipping", "polarizing", "moderating")))


def change_rows(samples: DataFrame) -> DataFrame:
    """The samples that changed, with direction and magnitude."""
    b, a = F.col("before"), F.col("after")
    return samples.where(b != a).withColumns({"direction": R.direction(b, a), "magnitude": F.abs(a - b)})


def reconsidered(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions before and after a challenge, with whether the vote changed and the share of samples that did."""
    a = first.select(*keys, F.col("prediction").alias("original_prediction"), F.col("accurate").alias("original_accurate"), F.col("ratings").alias("original_ratings"))
    b = second.select(*keys, F.col("prediction").alias("challenged_prediction"), F.col("accurate").alias("challenged_accurate"), F.col("ratings").alias("challenged_ratings"))
    changed = F.size(F.filter(F.arrays_zip("original_ratings", "challenged_ratings"), lambda x: x["original_ratings"] != x["challenged_ratings"]))
    return a.join(b, keys).withColumns({
        "prediction_changed": ~F.col("original_prediction").eqNullSafe(F.col("challenged_prediction")),
        "individual_changes": changed,
        "change_rate": F.coalesce(F.try_divide(changed, F.size("original_ratings")), F.lit(0.0)),
    })
