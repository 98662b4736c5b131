"""Cases, ratings, responses and texts derived from the driver's tables by integer arithmetic, in Spark and in SQL.

The tables have no ratings and no legal texts; these views give every operator rows that exercise it. ``CTE`` has the same
views for DuckDB: ``with_views("fx_ratings", body)`` puts those that are needed before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = ("2", "3", "5", "6", "8", "10", "14", "P1-1")
RAW_RESPONDENTS = ("RUSSIA", "THE NETHERLANDS", "TÜRKİYE", "V. POLAND", "AND OTHERS V. UKRAINE", "UNKNOWN", "REPUBLIC OF MOLDOVA", "THE UNITED KINGDOM", "ROMANIA", "ITALIE", "FRANCE AND GERMANY", "HUNGARY [GC]")
EVALUATORS = ("model-a", "model-b", "model-c", "model-d")
CONDITIONS = ("predictive", "normative", "factual", "summary_v1", "summary_v2", "summary_v3", "challenge")
SAMPLES = 10
FORMS = 7


def _pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], at: str) -> str:
    return "(list_value(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"))[CAST({at} AS BIGINT) + 1]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id")
    d = F.col("doc_id")
    return labels.join(docs, "doc_id").select(
        d,
        F.concat(F.when(d % 6 == 0, "002-").otherwise("001-"), d.cast("string")).alias("item_id"),
        F.concat(F.lit("CASE "), (d - d % 2).cast("string")).alias("case_name"),
        _pick(ARTICLES, d % 8).alias("article"),
        F.when(F.col("quality") == 1, "violation").otherwise("no_violation").alias("violation_label"),
        F.when(F.col("toxic") == 1, "b").otherwise("a").alias("grp"),
        _pick(RAW_RESPONDENTS, d % 12).alias("respondent"),
        F.date_add(F.lit("2017-01-01").cast("date"), (d % 3287).cast("int")).alias("decision_date"),
    )


CASES_SQL = f"""SELECT l.doc_id, CASE WHEN l.doc_id % 6 = 0 THEN '002-' ELSE '001-' END || l.doc_id AS item_id, 'CASE ' || (l.doc_id - l.doc_id % 2) AS case_name,
  {_pick_sql(ARTICLES, "l.doc_id % 8")} AS article, CASE WHEN quality = 1 THEN 'violation' ELSE 'no_violation' END AS violation_label,
  CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END AS grp, {_pick_sql(RAW_RESPONDENTS, "l.doc_id % 12")} AS respondent,
  DATE '2017-01-01' + CAST(l.doc_id % 3287 AS INTEGER) AS decision_date
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case, evaluator, condition and sample; the three small dimensions are generated in place."""
    one = cases(spark, sf_dir).select("doc_id", "item_id", "article", "grp", "case_name", "violation_label")
    e, k, s, d = (F.col(c) for c in ("e", "k", "sample_idx", "doc_id"))
    for name, n in (("e", len(EVALUATORS)), ("k", len(CONDITIONS)), ("sample_idx", SAMPLES)):
        one = one.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    h = (d * 7919 + e * 104729 + k * 1299709 + s * 15485863 + (d % 11) * (s + 1) * (k + 1) * 37 + (d % 7) * (e + 1) * 41) % 100
    b = F.when(h < 45, 1).when(h < 60, 2).when(h < 75, 3).when(h < 90, 4).otherwise(5)
    rating = F.when(F.col("violation_label") == "violation", b).otherwise(6 - b)
    return one.select("doc_id", "item_id", "case_name", "article", "grp", "violation_label", _pick(EVALUATORS, e).alias("evaluator"), _pick(CONDITIONS, k).alias("condition"), s.cast("int").alias("sample_idx"), rating.cast("int").alias("rating"))


RATINGS_SQL = f"""SELECT doc_id, item_id, case_name, article, grp, violation_label, {_pick_sql(EVALUATORS, "e")} AS evaluator, {_pick_sql(CONDITIONS, "k")} AS condition, s AS sample_idx,
  CAST(CASE WHEN violation_label = 'violation' THEN b ELSE 6 - b END AS INTEGER) AS rating
FROM (SELECT *, CASE WHEN h < 45 THEN 1 WHEN h < 60 THEN 2 WHEN h < 75 THEN 3 WHEN h < 90 THEN 4 ELSE 5 END AS b
  FROM (SELECT c.*, e, k, s, (doc_id * 7919 + e * 104729 + k * 1299709 + s * 15485863 + (doc_id % 11) * (s + 1) * (k + 1) * 37 + (doc_id % 7) * (e + 1) * 41) % 100 AS h
    FROM fx_cases c, range({len(EVALUATORS)}) t1(e), range({len(CONDITIONS)}) t2(k), range({SAMPLES}) t3(s)))"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first condition's ratings as texts in seven forms, with the status of the request."""
    r = ratings(spark, sf_dir).where("condition = 'predictive'")
    form, t = (F.col("doc_id") + F.col("sample_idx")) % FORMS, F.col("rating").cast("string")
    text = F.when(form == 0, t).when(form == 1, F.concat(F.lit("Rating: "), t)).when(form == 2, F.concat(F.lit("I rate it "), t, F.lit("/5"))).when(form == 3, "")
    text = text.when(form == 4, F.lit(None).cast("string")).when(form == 5, "ERROR: Error code: 429").otherwise("no idea")
    return r.drop("condition").withColumn("response", text).withColumn("status", F.when(form == 5, "error").otherwise("ok"))


RESPONSES_SQL = f"""SELECT *, CASE (doc_id + sample_idx) % {FORMS} WHEN 0 THEN '' || rating WHEN 1 THEN 'Rating: ' || rating WHEN 2 THEN 'I rate it ' || rating || '/5'
  WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'ERROR: Error code: 429' ELSE 'no idea' END AS response, CASE (doc_id + sample_idx) % {FORMS} WHEN 5 THEN 'error' ELSE 'ok' END AS status
FROM fx_ratings WHERE condition = 'predictive'"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of five sentences put after its first 600 characters, and the article that it is about."""
    d, article = F.col("doc_id"), _pick(ARTICLES, F.col("doc_id") % 8)
    form = d % 5
    put = F.when(form == 0, "").when(form == 1, F.concat(F.lit(" Accordingly, there has been no violation of Article "), article, F.lit(" of the Convention. ")))
    put = put.when(form == 2, "\nMERITS\n").when(form == 3, "\nFOR THESE REASONS, THE COURT\n").otherwise(" The applicant alleged a violation of Article 3. ")
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(d, F.concat(F.lit("001-"), d.cast("string")).alias("item_id"), article.alias("article"), F.concat(F.substring(t, 1, 600), put, F.substring(t, 601, 2147483647)).alias("full_text"))


TEXTS_SQL = f"""SELECT doc_id, '001-' || doc_id AS item_id, article, substr(text, 1, 600) || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Accordingly, there has been no violation of Article ' || article || ' of the Convention. '
  WHEN 2 THEN E'\\nMERITS\\n' WHEN 3 THEN E'\\nFOR THESE REASONS, THE COURT\\n' ELSE ' The applicant alleged a violation of Article 3. ' END || substr(text, 601) AS full_text
FROM (SELECT *, {_pick_sql(ARTICLES, "doc_id % 8")} AS article FROM documents)"""

CONCLUSIONS = ("Violation of Article 6", "No violation of Article 10; Violation of Article 13", "No violation of Article 8; Violation of Article 3", "Violation of Article 1 of Protocol No. 1", "Struck out of the list", "")


def conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d, F.concat(F.lit("001-"), d.cast("string")).alias("item_id"), _pick(CONCLUSIONS, d % 6).alias("conclusion"))


CONCLUSIONS_SQL = f"SELECT doc_id, '001-' || doc_id AS item_id, {_pick_sql(CONCLUSIONS, 'doc_id % 6')} AS conclusion FROM documents"


def records(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """The events as records to be refreshed: keyed by user and type, in the order of their ids."""
    chosen = F.col("event_id") % 3 == 0 if new else F.col("event_id") % 3 != 0
    return table(spark, sf_dir, "events").where(chosen).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_id"), F.col("event_type").alias("article"), F.date_format("ts", "yyyy-MM-dd").alias("decision_date"), F.round("value", 6).alias("value"), F.col("event_id").alias("ord"))


RECORDS_SQL = "SELECT 'u' || user_id AS item_id, event_type AS article, strftime(ts, '%Y-%m-%d') AS decision_date, round(value, 6) AS value, event_id AS ord FROM events WHERE event_id % 3 {} 0"

CTE = {
    "fx_cases": CASES_SQL,
    "fx_ratings": RATINGS_SQL,
    "fx_responses": RESPONSES_SQL,
    "fx_text": TEXTS_SQL,
    "fx_conclusion": CONCLUSIONS_SQL,
    "fx_existing": RECORDS_SQL.format("<>"),
    "fx_new": RECORDS_SQL.format("="),
    "fx_predictions": """SELECT evaluator, condition, item_id, case_name, article, grp, violation_label, violation_label = 'violation' AS is_violation, avg(rating) AS avg_rating, count(*) AS num_samples,
  count(*) FILTER (rating = 3) AS num_abstentions FROM fx_ratings GROUP BY ALL""",
}
NEEDS = {"fx_ratings": ("fx_cases",), "fx_responses": ("fx_cases", "fx_ratings"), "fx_predictions": ("fx_cases", "fx_ratings")}


def with_views(names: str, body: str) -> str:
    """``body`` after the views of ``names`` and those that they need; a body that begins with a name goes on with more views."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*NEEDS.get(name, ()), name) if x not in wanted]
    views = ",\n".join(f"{x} AS ({CTE[x]})" for x in wanted)
    return f"WITH {views}\n{body}" if body.lstrip().upper().startswith("SELECT") else f"WITH {views},\n{body}"
