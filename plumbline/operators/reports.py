"""Reports over predictions: accuracy tables, pivots, balanced accuracy, completeness, dataset statistics and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ratings as R
from plumbline.operators.predictions import KEY


def _share(hit: Column) -> Column:
    return F.avg(hit.cast("double"))


def accuracy(predicted: DataFrame, *groups: str) -> DataFrame:
    """Cases, accuracy, abstention, mean rating, and the accuracy of each label; null for a label without cases."""
    v = F.col("is_violation")
    return predicted.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        _share(F.col("accurate")).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum("num_abstentions"), F.sum("num_samples")), F.lit(0.0)).alias("abstention_rate"),
        F.avg("avg_rating").alias("mean_rating"),
        _share(F.when(v, F.col("accurate"))).alias("accuracy_violation"),
        _share(F.when(~v, F.col("accurate"))).alias("accuracy_no_violation"),
    )


def pivoted(rows: DataFrame, by: list[str], across: str, values: list, of: str, digits: int = 3) -> DataFrame:
    """``of`` rounded, a column for each of the given values: one pass, as the values are known."""
    return rows.groupBy(*by).pivot(across, values).agg(F.round(F.first(of), digits))


BALANCED_LEVELS = ("all", "article", "group")


def balanced(predicted: DataFrame) -> DataFrame:
    """For each evaluator over all, by article and by group: pass rates and the mean of the present labels' accuracies."""
    g = F.grouping_id()
    v, ok = F.col("is_violation"), F.col("accurate").cast("double")
    rows = predicted.groupingSets([["evaluator"], ["evaluator", "article"], ["evaluator", "grp"]], "evaluator", "article", "grp").agg(
        F.when(g == 3, "all").when(g == 1, "article").otherwise("group").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(v).alias("n_violation"),
        F.count_if(~v).alias("n_no_violation"),
        F.count_if(F.col("accurate")).alias("passed"),
        F.avg(ok).alias("pass_rate"),
        F.avg(F.when(v, ok)).alias("accuracy_violation"),
        F.avg(F.when(~v, ok)).alias("accuracy_no_violation"),
    )
    a, b = F.col("accuracy_violation"), F.col("accuracy_no_violation")
    return rows.withColumn("balanced_accuracy", F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))


def failing(predicted: DataFrame, evaluators: list[str]) -> DataFrame:
    """A row for each case with every evaluator's pass flag, null where it has none, and whether all or some fail; a missing
    one counts as not passed. It equals a chain of full outer joins, and is one aggregation."""
    flags = predicted.groupBy(*KEY).pivot("evaluator", evaluators).agg(F.first("accurate"))
    passed = sum((F.coalesce(F.col(f"`{e}`").cast("int"), F.lit(0)) for e in evaluators), F.lit(0))
    return flags.withColumn("n_passed", passed).withColumn("fails_all", F.col("n_passed") == 0).withColumn("fails_some", (F.col("n_passed") > 0) & (F.col("n_passed") < len(evaluators)))


def weighted_challenge(predicted: DataFrame, samples: DataFrame) -> DataFrame:
    """By evaluator: case correctness weighted with samples before and after, and changed samples among all."""
    acc = predicted.groupBy("evaluator").agg(*(F.try_divide(F.sum(F.when(F.col("condition") == c, F.when(F.col("accurate"), F.col("num_samples")).otherwise(0))), F.sum(F.when(F.col("condition") == c, F.col("num_samples")))).alias(n) for c, n in (("predictive", "accuracy_before"), ("challenge", "accuracy_after"))))
    change = samples.groupBy("evaluator").agg(F.try_divide(F.count_if(F.col("before") != F.col("after")), F.count(F.lit(1))).alias("change_rate"))
    return acc.join(change, "evaluator", "left")


def compared(full: DataFrame, pilot: DataFrame, by: str = "evaluator") -> DataFrame:
    a, b = (x.groupBy(by).agg(F.count(F.lit(1)).alias(f"n_{n}"), _share(F.col("accurate")).alias(f"accuracy_{n}")) for x, n in ((full, "full"), (pilot, "pilot")))
    return a.join(b, by).withColumn("difference", F.col("accuracy_full") - F.col("accuracy_pilot"))


def completeness(predicted: DataFrame, cases: DataFrame, evaluators: list[str], conditions: list[str]) -> DataFrame:
    """Rows that each evaluator and condition has, against the number of cases, with a status; also those without a row."""
    spark = cases.sparkSession
    dims = spark.range(1).select(F.explode(F.array(*map(F.lit, evaluators))).alias("evaluator")).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    expected = cases.agg(F.count(F.lit(1)).alias("expected"))
    got = predicted.groupBy("evaluator", "condition").agg(F.count(F.lit(1)).alias("actual"))
    rows = dims.join(got, ["evaluator", "condition"], "left").crossJoin(expected).withColumn("actual", F.coalesce("actual", F.lit(0).cast("bigint")))
    missing = F.col("expected") - F.col("actual")
    return rows.withColumn("missing", missing).withColumn("status", F.when(F.col("actual") == 0, "MISSING").when(missing > 0, "INCOMPLETE").when(missing < 0, "EXTRA").otherwise("COMPLETE"))


def collisions(rows: DataFrame, text: str) -> DataFrame:
    """Items of several rows that share exactly one non-empty text; an empty one beside it doesn't count."""
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif(F.trim(text), F.lit(""))).alias("texts")).where("n > 1 and texts = 1")


def dataset_stats(cases: DataFrame) -> DataFrame:
    """One row: pairs, distinct cases, countries and articles, and the labels' shares."""
    return cases.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct("item_id").alias("cases"),
        F.count_distinct("respondent").alias("countries"),
        F.count_distinct("article").alias("articles"),
        _share(F.col("violation_label") == R.VIOLATION).alias("violation_share"),
        F.min("decision_date").alias("first_date"),
        F.max("decision_date").alias("last_date"),
    )


def country_stats(cases: DataFrame) -> DataFrame:
    return cases.groupBy("respondent").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("item_id").alias("cases"), (100 * _share(F.col("violation_label") == R.VIOLATION)).alias("violation_pct"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; null counts as a value of its own."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def top_k(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The most frequent values; of equally frequent ones those of the least value. Only k rows of each task are sorted."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(k)


#: Of each kind of call: the stage, calls for each case without and with a factor of samples, tokens in and out.
CALLS = (("baseline", 0, 1, 16000, 10), ("rq1", 3, 0, 15000, 600), ("rq1", 0, 3, 800, 10), ("rq2", 0, 3, 800, 10), ("rq3", 0, 2, 16000, 10))


def costs(cases: DataFrame, models: DataFrame, samples: int) -> DataFrame:
    """(model, stage, calls, cost) with the total of each model and of all in rows of null stage and model; models are
    (model, price_in, price_out) for a million tokens."""
    kinds = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(once + each * samples).alias("per_case"), F.lit(i).alias("tokens_in"), F.lit(o).alias("tokens_out")) for s, once, each, i, o in CALLS))
    rows = models.crossJoin(cases.agg(F.count(F.lit(1)).alias("n"))).select("*", F.explode(kinds).alias("k"))
    calls = F.col("n") * F.col("k.per_case")
    return rows.select("model", "k.stage", calls.alias("calls"), (calls * (F.col("k.tokens_in") * F.col("price_in") + F.col("k.tokens_out") * F.col("price_out")) / 1e6).alias("cost")).rollup("model", "stage").agg(F.sum("calls").alias("calls"), F.sum("cost").alias("cost"))


def progress(done: DataFrame, models: list[str], stages: list[str]) -> DataFrame:
    """A row for each model with done or PENDING for each stage."""
    rows = done.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, models))).alias("model"))
    known = done.groupBy("model").pivot("stage", stages).agg(F.count(F.lit(1)))
    return rows.join(known, "model", "left").select("model", *(F.when(F.col(s) > 0, "done").otherwise("PENDING").alias(s) for s in stages))


def latex(table: DataFrame, caption: str) -> str:
    """A small report as a LaTeX table, its rows in the order of the first column."""
    rows = table.orderBy(table.columns[0]).collect()
    body = " \\\\\n".join(" & ".join("--" if v is None else str(v) for v in r) for r in rows)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(table.columns)}}}\n{' & '.join(table.columns)} \\\\\\hline\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}"
