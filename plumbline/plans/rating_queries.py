"""Queries over ratings: predictions, paired tests and changes, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ratings as R
from plumbline.functions import stats as S
from plumbline.operators import changes as C
from plumbline.operators import paired as T
from plumbline.operators import predictions as P
from plumbline.sources import fixtures as X

SUMMARIES = ["summary_v1", "summary_v2", "summary_v3"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return P.predictions(X.ratings(spark, sf))


def rating_extract(spark, sf):
    r = X.responses(spark, sf)
    return r.select("item_id", "evaluator", "sample_idx", R.extract_rating(F.col("response")).alias("naive"), R.rating_of(F.col("response"), F.col("status")).alias("got"))


def accuracy_by_evaluator(spark, sf):
    from plumbline.operators.reports import accuracy

    return rounded(accuracy(_predicted(spark, sf), "evaluator", "condition"))


def majority_vote(spark, sf):
    return _predicted(spark, sf).select("evaluator", "condition", "item_id", "prediction", "abstained")


def prediction_rows(spark, sf):
    return rounded(_predicted(spark, sf).select("evaluator", "condition", "item_id", F.array_join("ratings", ",").alias("ratings"), "avg_rating", "num_samples", "num_abstentions", "accurate"))


def abstention_rate(spark, sf):
    return rounded(P.abstention_rate(_predicted(spark, sf), "evaluator", "condition"))


def distance_score(spark, sf):
    r = X.ratings(spark, sf)
    return rounded(r.groupBy("evaluator", "condition", "violation_label").agg(F.avg(R.distance_score(F.col("rating"), F.col("violation_label") == "violation")).alias("score")))


def stitched_ratings(spark, sf):
    r = X.responses(spark, sf)
    keys = ["evaluator", "item_id", "sample_idx"]
    answers = r.where((F.col("doc_id") % 10 != 0) & (F.col("sample_idx") < 9)).select(*keys, "response", "status")
    return P.stitched(r.select(*keys), answers, keys).groupBy("evaluator", "item_id").agg(F.sum("rating").alias("total"), F.count_if(F.col("rating") == 3).alias("neutral"))


def _tests(spark, sf, baseline, conditions, rule="lt3"):
    return rounded(T.tests(T.pairs(_predicted(spark, sf), baseline, conditions, rule)), 9)


def framing_test(spark: SparkSession, sf: str) -> DataFrame:
    """Both framings against the predictive prompt, for every evaluator."""
    return _tests(spark, sf, "predictive", ["normative", "factual"])


def summary_test(spark, sf):
    return _tests(spark, sf, "predictive", SUMMARIES, "gt2_5")


def reconsideration_test(spark, sf):
    return _tests(spark, sf, "predictive", ["challenge"])


def mcnemar(spark, sf):
    """The exact test on a grid of counts that the events give."""
    e = X.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 == 0).alias("n01"), F.count_if(F.col("event_id") % 3 == 1).alias("n10"))
    return rounded(e.select("user_id", "n01", "n10", S.mcnemar_exact(F.col("n01"), F.col("n10")).alias("p_value")), 9)


def wilson(spark, sf):
    e = X.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 == 0).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return rounded(e.select("user_id", low.alias("low"), high.alias("high")), 9)


def alignment(spark, sf):
    p = T.pairs(_predicted(spark, sf), "predictive", [c for c in X.CONDITIONS if c != "predictive"])
    return rounded(p.groupBy("condition").agg(F.avg((F.col("says_a") == F.col("says_b")).cast("double")).alias("alignment"), F.count(F.lit(1)).alias("n")))


def adjusted_p(spark, sf):
    tested = T.tests(T.pairs(_predicted(spark, sf), "predictive", SUMMARIES))
    return rounded(T.adjusted(tested).select("evaluator", "condition", "rank", "p_bonferroni", "p_holm", "p_bh"), 9)


def effect_size(spark, sf):
    tested = T.tests(T.pairs(_predicted(spark, sf), "predictive", SUMMARIES))
    return rounded(tested.select("evaluator", "condition", S.cohens_h(F.col("accuracy_a"), F.col("accuracy_b")).alias("h")), 9)


def bootstrap_ci(spark, sf):
    return T.bootstrap(T.pairs(_predicted(spark, sf), "predictive", ["normative", "factual"]))


def bootstrap_counts(spark, sf):
    return T.bootstrap_from_counts(T.tests(T.pairs(_predicted(spark, sf), "predictive", ["normative", "factual"])))


def direction_avg(spark, sf):
    return rounded(C.directional(T.pairs(_predicted(spark, sf), "predictive", ["normative", "factual", "challenge"]), "evaluator", "condition"))


def _samples(spark, sf):
    return C.sample_pairs(X.ratings(spark, sf), "predictive", "challenge")


def direction_sample(spark, sf):
    return rounded(C.sample_directions(_samples(spark, sf), "evaluator"))


def direction_rows(spark, sf):
    return C.change_rows(_samples(spark, sf)).select("evaluator", "item_id", "sample_idx", "before", "after", "direction", "magnitude")


def polarization(spark, sf):
    return C.categories(_samples(spark, sf), "evaluator")


def reconsidered(spark, sf):
    p = _predicted(spark, sf)
    keys = ["evaluator", "item_id", "article", "grp", "violation_label"]
    got = C.reconsidered(p.where("condition = 'predictive'"), p.where("condition = 'challenge'"), keys)
    return rounded(got.select("evaluator", "item_id", "original_prediction", "challenged_prediction", "original_accurate", "challenged_accurate", "prediction_changed", "individual_changes", "change_rate"))


def weighted_challenge(spark, sf):
    from plumbline.operators.reports import weighted_challenge as report

    return rounded(report(_predicted(spark, sf), _samples(spark, sf)))


_ACCURATE = "CASE WHEN is_violation THEN avg_rating < 3 ELSE avg_rating > 3 END"
_VOTES = """votes AS (SELECT evaluator, condition, item_id, CASE WHEN rating <= 2 THEN 'violation' WHEN rating >= 4 THEN 'no_violation' ELSE 'abstention' END AS c, count(*) AS n, min(sample_idx) AS f
  FROM fx_ratings GROUP BY ALL),
vote AS (SELECT evaluator, condition, item_id, c AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY evaluator, condition, item_id ORDER BY n DESC, f) = 1)"""
_P = "least(1, 2 * list_sum(list_transform(range(0, CAST(least(n01, n10) AS BIGINT) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2)))))"
_P = f"CASE WHEN n01 + n10 = 0 THEN 1 ELSE {_P} END"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    z, p = "1.959963984540054", f"({k} / CAST({n} AS DOUBLE))"
    bound = f"(({p} + {z} * {z} / (2 * {n})) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))) / (1 + {z} * {z} / {n})"
    return f"greatest(0, {bound})" if sign == "-" else f"least(1, {bound})"


def _pairs_sql(baseline: str, conditions: list[str], rule: str = "lt3") -> str:
    says = {"lt3": "{}.avg_rating < 3", "gt2_5": "{}.avg_rating > 2.5"}[rule]
    a, b = says.format("a"), says.format("b")
    return f"""pairs AS (SELECT b.evaluator, b.condition, b.item_id, b.violation_label, a.avg_rating AS avg_a, b.avg_rating AS avg_b, ({a}) AS says_a, ({b}) AS says_b,
  ({a}) = a.is_violation AS right_a, ({b}) = b.is_violation AS right_b
FROM fx_predictions a JOIN fx_predictions b USING (evaluator, item_id, article, grp) WHERE a.condition = '{baseline}' AND b.condition IN ({", ".join(f"'{c}'" for c in conditions)}))"""


def _tests_sql(baseline: str, conditions: list[str], rule: str = "lt3") -> str:
    return f"""{_pairs_sql(baseline, conditions, rule)},
counts AS (SELECT evaluator, condition, count(*) AS n, avg(CAST(right_a AS INTEGER)) AS accuracy_a, avg(CAST(right_b AS INTEGER)) AS accuracy_b, count(*) FILTER (NOT right_a AND right_b) AS n01,
  count(*) FILTER (right_a AND NOT right_b) AS n10, count(*) FILTER (says_a = says_b) AS aligned FROM pairs GROUP BY ALL),
tested AS (SELECT *, accuracy_b - accuracy_a AS difference, {_P} AS p_value, aligned / CAST(n AS DOUBLE) AS alignment, {_wilson_sql("aligned", "n", "-")} AS alignment_low, {_wilson_sql("aligned", "n", "+")} AS alignment_high FROM counts)"""


_TEST_ROWS = """SELECT evaluator, condition, n, round(accuracy_a, 9) AS accuracy_a, round(accuracy_b, 9) AS accuracy_b, n01, n10, aligned, round(difference, 9) AS difference, round(p_value, 9) AS p_value, round(alignment, 9) AS alignment,
  round(alignment_low, 9) AS alignment_low, round(alignment_high, 9) AS alignment_high, p_value < 0.05 AS significant,
  CASE WHEN p_value < 0.05 AND difference > 0 THEN 'IMPROVES' WHEN p_value < 0.05 AND difference < 0 THEN 'WORSENS' ELSE 'NO CHANGE' END AS verdict FROM tested"""
_SAMPLES = """samples AS (SELECT a.evaluator, a.item_id, a.sample_idx, a.rating AS before, b.rating AS after FROM fx_ratings a JOIN fx_ratings b USING (evaluator, item_id, article, grp, sample_idx)
  WHERE a.condition = 'predictive' AND b.condition = 'challenge')"""
_COUNTS_SQL = "SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS n01, count(*) FILTER (event_id % 3 = 1) AS n10, count(*) AS n FROM events GROUP BY user_id"
_ACCURACY = f"""count(*) AS n, round(avg(CAST({_ACCURATE} AS INTEGER)), 6) AS accuracy, round(sum(num_abstentions) / CAST(sum(num_samples) AS DOUBLE), 6) AS abstention_rate, round(avg(avg_rating), 6) AS mean_rating,
  round(avg(CAST({_ACCURATE} AS INTEGER)) FILTER (is_violation), 6) AS accuracy_violation, round(avg(CAST({_ACCURATE} AS INTEGER)) FILTER (NOT is_violation), 6) AS accuracy_no_violation"""


def _share_sql(hit: str) -> str:
    return f"round(coalesce(100.0 * count(*) FILTER ({hit}) / nullif(count(*) FILTER (avg_a <> avg_b), 0), 0), 6)"


QUERIES = {f.__name__: f for f in (rating_extract, accuracy_by_evaluator, majority_vote, prediction_rows, abstention_rate, distance_score, stitched_ratings, framing_test, summary_test, reconsideration_test, mcnemar, wilson, alignment, adjusted_p, effect_size, bootstrap_ci, bootstrap_counts, direction_avg, direction_sample, direction_rows, polarization, reconsidered, weighted_challenge)}

_DIGIT = "coalesce(TRY_CAST(nullif(regexp_extract(response, '[1-5]'), '') AS INTEGER), 3)"
ORACLE = {
    "rating_extract": X.with_views("fx_responses", f"SELECT item_id, evaluator, CAST(sample_idx AS INTEGER) AS sample_idx, {_DIGIT} AS naive, CASE WHEN status = 'ok' THEN {_DIGIT} ELSE 3 END AS got FROM fx_responses"),
    "accuracy_by_evaluator": X.with_views("fx_predictions", f"SELECT evaluator, condition, {_ACCURACY} FROM fx_predictions GROUP BY ALL"),
    "majority_vote": X.with_views("fx_ratings", f"{_VOTES}\nSELECT *, prediction = 'abstention' AS abstained FROM vote"),
    "prediction_rows": X.with_views("fx_predictions", f"""lists AS (SELECT evaluator, condition, item_id, string_agg(CAST(rating AS VARCHAR), ',' ORDER BY sample_idx) AS ratings FROM fx_ratings GROUP BY ALL)
SELECT evaluator, condition, item_id, ratings, round(avg_rating, 6) AS avg_rating, num_samples, num_abstentions, {_ACCURATE} AS accurate FROM fx_predictions JOIN lists USING (evaluator, condition, item_id)"""),
    "abstention_rate": X.with_views("fx_ratings", "SELECT evaluator, condition, count(*) FILTER (rating = 3) AS abstentions, count(*) AS samples, round(count(*) FILTER (rating = 3) / CAST(count(*) AS DOUBLE), 6) AS abstention_rate FROM fx_ratings GROUP BY ALL"),
    "distance_score": X.with_views("fx_ratings", "SELECT evaluator, condition, violation_label, round(avg(1 - abs(rating - CASE WHEN violation_label = 'violation' THEN 1 ELSE 5 END) / 4.0), 6) AS score FROM fx_ratings GROUP BY ALL"),
    "stitched_ratings": X.with_views("fx_responses", f"""got AS (SELECT evaluator, item_id, CASE WHEN doc_id % 10 <> 0 AND sample_idx < 9 AND status = 'ok' THEN {_DIGIT} ELSE 3 END AS r FROM fx_responses)
SELECT evaluator, item_id, CAST(sum(r) AS BIGINT) AS total, count(*) FILTER (r = 3) AS neutral FROM got GROUP BY ALL"""),
    "framing_test": X.with_views("fx_predictions", f"{_tests_sql('predictive', ['normative', 'factual'])}\n{_TEST_ROWS}"),
    "summary_test": X.with_views("fx_predictions", f"{_tests_sql('predictive', SUMMARIES, 'gt2_5')}\n{_TEST_ROWS}"),
    "reconsideration_test": X.with_views("fx_predictions", f"{_tests_sql('predictive', ['challenge'])}\n{_TEST_ROWS}"),
    "mcnemar": f"SELECT user_id, n01, n10, round({_P}, 9) AS p_value FROM ({_COUNTS_SQL})",
    "wilson": f"SELECT user_id, round({_wilson_sql('n01', 'n', '-')}, 9) AS low, round({_wilson_sql('n01', 'n', '+')}, 9) AS high FROM ({_COUNTS_SQL})",
    "alignment": X.with_views("fx_predictions", f"{_pairs_sql('predictive', [c for c in X.CONDITIONS if c != 'predictive'])}\nSELECT condition, round(avg(CAST(says_a = says_b AS INTEGER)), 6) AS alignment, count(*) AS n FROM pairs GROUP BY condition"),
    "adjusted_p": X.with_views("fx_predictions", f"""{_tests_sql('predictive', SUMMARIES)},
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY p_value, evaluator, condition) AS INTEGER) AS rank, count(*) OVER () AS m FROM tested)
SELECT evaluator, condition, rank, round(least(1, p_value * m), 9) AS p_bonferroni, round(max(least(1, p_value * (m - rank + 1))) OVER (ORDER BY rank), 9) AS p_holm,
  round(min(least(1, p_value * m / rank)) OVER (ORDER BY rank DESC), 9) AS p_bh FROM ranked"""),
    "effect_size": X.with_views("fx_predictions", f"{_tests_sql('predictive', SUMMARIES)}\nSELECT evaluator, condition, round(2 * asin(sqrt(accuracy_b)) - 2 * asin(sqrt(accuracy_a)), 9) AS h FROM tested"),
    "direction_avg": X.with_views("fx_predictions", f"""{_pairs_sql('predictive', ['normative', 'factual', 'challenge'])}
SELECT evaluator, condition, count(*) AS total, count(*) FILTER (avg_a <> avg_b) AS changes, round(100.0 * count(*) FILTER (avg_a <> avg_b) / count(*), 6) AS pct_changed, {_share_sql('avg_b < avg_a')} AS pct_toward, {_share_sql('avg_b > avg_a')} AS pct_away,
  {_share_sql('avg_a <> 3 AND avg_b = 3')} AS pct_to_abstention, {_share_sql('avg_a = 3 AND avg_b <> 3')} AS pct_from_abstention, round(coalesce(avg(abs(avg_b - avg_a)) FILTER (avg_a <> avg_b), 0), 6) AS avg_magnitude FROM pairs GROUP BY ALL"""),
    "direction_sample": X.with_views("fx_ratings", f"""{_SAMPLES}
SELECT evaluator, count(*) AS samples, count(*) FILTER (before <> after) AS changed, count(*) FILTER (after < before) AS toward, count(*) FILTER (after > before) AS away, round(coalesce(avg(abs(after - before)) FILTER (before <> after), 0), 6) AS avg_magnitude FROM samples GROUP BY evaluator"""),
    "direction_rows": X.with_views("fx_ratings", f"""{_SAMPLES}
SELECT evaluator, item_id, CAST(sample_idx AS INTEGER) AS sample_idx, before, after, CASE WHEN after < before THEN 'toward_violation' ELSE 'away_from_violation' END AS direction, abs(after - before) AS magnitude FROM samples WHERE before <> after"""),
    "polarization": X.with_views("fx_ratings", f"""{_SAMPLES},
named AS (SELECT evaluator, CASE WHEN before = after THEN 'u' WHEN (before - 3) * (after - 3) < 0 THEN 'f' WHEN abs(after - 3) > abs(before - 3) THEN 'p' ELSE 'm' END AS c FROM samples)
SELECT evaluator, count(*) FILTER (c = 'u') AS unchanged, count(*) FILTER (c = 'f') AS flipping, count(*) FILTER (c = 'p') AS polarizing, count(*) FILTER (c = 'm') AS moderating FROM named GROUP BY evaluator"""),
    "reconsidered": X.with_views("fx_predictions", f"""{_VOTES},
{_SAMPLES},
moved AS (SELECT evaluator, item_id, CAST(count(*) FILTER (before <> after) AS INTEGER) AS individual_changes, count(*) AS n FROM samples GROUP BY ALL),
full_ AS (SELECT p.evaluator, p.item_id, p.condition, v.prediction, {_ACCURATE} AS accurate FROM fx_predictions p JOIN vote v ON p.evaluator = v.evaluator AND p.condition = v.condition AND p.item_id = v.item_id)
SELECT a.evaluator, a.item_id, a.prediction AS original_prediction, b.prediction AS challenged_prediction, a.accurate AS original_accurate, b.accurate AS challenged_accurate, a.prediction <> b.prediction AS prediction_changed,
  individual_changes, round(individual_changes / CAST(n AS DOUBLE), 6) AS change_rate
FROM full_ a JOIN full_ b ON a.evaluator = b.evaluator AND a.item_id = b.item_id AND a.condition = 'predictive' AND b.condition = 'challenge' JOIN moved m ON m.evaluator = a.evaluator AND m.item_id = a.item_id"""),
    "weighted_challenge": X.with_views("fx_predictions", f"""{_SAMPLES},
acc AS (SELECT evaluator, condition, sum(CASE WHEN {_ACCURATE} THEN num_samples ELSE 0 END) / CAST(sum(num_samples) AS DOUBLE) AS a FROM fx_predictions GROUP BY ALL),
moved AS (SELECT evaluator, count(*) FILTER (before <> after) / CAST(count(*) AS DOUBLE) AS r FROM samples GROUP BY ALL)
SELECT x.evaluator, round(x.a, 6) AS accuracy_before, round(y.a, 6) AS accuracy_after, round(r, 6) AS change_rate FROM acc x JOIN acc y ON x.evaluator = y.evaluator JOIN moved m ON m.evaluator = x.evaluator
WHERE x.condition = 'predictive' AND y.condition = 'challenge'"""),
}
