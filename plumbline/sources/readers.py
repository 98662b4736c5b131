"""Sources and sinks: cases as JSON or Parquet, a database, result trees and per-evaluator CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "item_id string, case_name string, article string, violation_label string, full_case_text string, case_text string, verdict_free_text string, decision_date string, judgment_date string, date string, respondent string, conclusion string, language string, importance string"
RESULT_SCHEMA = "case_name string, article string, violation_label string, avg_rating double, is_accurate boolean, num_abstentions int, num_samples int, sample_ratings string"
CHALLENGE_SCHEMA = "case_name string, article string, violation_label string, sample_idx int, initial_rating int, challenged_rating int, changed boolean, is_accurate_initial boolean, is_accurate_challenged boolean"


def _filled(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def cases(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, schema: str = CASE_SCHEMA) -> DataFrame:
    """Cases from JSON arrays or Parquet, by the path's ending, with one name for date and text; dated within [since, until).
    Rows without a date go only if a bound is given. Filters on Parquet reach the scan."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        for field in schema.split(", "):
            name, kind = field.split()
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
    else:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    date = F.substring(_filled("decision_date", "judgment_date", "date"), 1, 10)
    rows = rows.withColumns({"decision_date": date, "full_text": _filled("full_case_text", "case_text", "verdict_free_text")})
    if since:
        rows = rows.where(F.col("decision_date") >= since)
    if until:
        rows = rows.where(F.col("decision_date") < until)
    return rows.drop("judgment_date", "date", "full_case_text", "case_text")


def database_cases(spark: SparkSession, url: str, dbtable: str, country: str | None = None, language: str | None = None, since: str | None = None, least_chars: int = 500, **options: str) -> DataFrame:
    """Cases of a database that have a text of some length and a conclusion and aren't translations; the conditions are
    pushed into the database's own query. ``options`` may partition the read."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    rows = rows.where("full_text is not null and conclusion is not null").where(F.length("full_text") > least_chars).where(~F.col("case_name").ilike("%Translation%"))
    for name, value in (("respondent", country), ("language", language)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows.where(F.col("decision_date") >= since) if since else rows


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The tree <folder>/<model>/<stage>_results.json as one table with ``model`` and ``stage``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/*_results.json").select("*", F.col("_metadata.file_path").alias("_p"))
    return rows.withColumn("model", F.regexp_extract("_p", r"/([^/]+)/[^/]+_results\.json$", 1)).withColumn("stage", F.regexp_extract("_p", r"/([^/]+)_results\.json$", 1)).drop("_p")


def result_csvs(spark: SparkSession, pattern: str, ending: str = "_mft_samples", schema: str = RESULT_SCHEMA) -> DataFrame:
    """Per-evaluator CSV files as one table; the evaluator is the file's name before ``ending``, ratings are an array."""
    rows = spark.read.schema(schema).csv(pattern, header=True, multiLine=True, escape='"').select("*", F.col("_metadata.file_name").alias("_p"))
    rows = rows.withColumn("evaluator", F.regexp_extract("_p", rf"^(.*?){ending}", 1)).drop("_p")
    return rows.withColumn("sample_ratings", ratings_array(F.col("sample_ratings"))) if "sample_ratings" in rows.columns else rows


def ratings_array(text: Column) -> Column:
    """``"[2, 2, 3]"`` as an array of int; null for what isn't one."""
    return F.from_json(text, "array<int>")


def truth(cases_: DataFrame, order: str) -> DataFrame:
    """One label for each (case_name, article): of repeated ones the last."""
    return cases_.groupBy("case_name", "article").agg(F.max_by("violation_label", order).alias("violation_label"))


def search_query(*, articles: list[str] = (), country: str = "", language: str = "", since: str = "", until: str = "") -> str:
    """The terms of a search, dates as a half-open range."""
    terms = [f'(article="{a}")' for a in articles]
    parts = [" OR ".join(terms) if len(terms) < 2 else f"({' OR '.join(terms)})", f'(respondent="{country}")' if country else "", f'(languageisocode="{language}")' if language else ""]
    if since or until:
        parts.append(f"(kpdate:[{since or '*'} TO {until or '*'}}})")
    return " AND ".join(p for p in parts if p)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_results(rows: DataFrame, path: str) -> None:
    """Partitioned by model and stage; only the partitions that ``rows`` has are replaced, so finished ones stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "stage").parquet(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(model, stage) of what has been written, from the names of its folders."""
    return spark.read.parquet(path).select("model", "stage").distinct()
