"""Queries over cases and texts: reports, curation, refresh, prompts, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ratings as R
from plumbline.functions import text as T
from plumbline.operators import curate as C
from plumbline.operators import infer, prompts
from plumbline.operators import reports as G
from plumbline.operators.predictions import predictions, request_id, work_list
from plumbline.plans.rating_queries import _ACCURATE, _predicted, rounded
from plumbline.sources import fixtures as X

MODELS = (("model-a", 2.5, 10.0), ("model-b", 0.4, 1.6), ("model-c", 3.0, 15.0), ("model-d", 0.27, 1.1))
MODEL_IDS = ("openai/gpt-5", "google/gemini-2.0", "deepseek/deepseek-v4", "meta/llama-3.3")
SLOTS = {"[NAME]": "the applicant", "[NAME_2]": "the other", "the": "THE"}


def _baseline(spark, sf) -> DataFrame:
    return predictions(X.ratings(spark, sf).where("condition = 'predictive'"))


def baseline_by_article(spark, sf):
    return rounded(G.accuracy(_baseline(spark, sf), "article").withColumn("title", prompts._lookup(F.col("article"), 0)).orderBy(F.length("article"), "article"))


def country_pivot(spark, sf):
    """Accuracy by country and evaluator; cases join by their id, and an unknown country is named so."""
    named = C.clean_respondents(X.cases(spark, sf)).select("item_id", "respondent")
    rows = _baseline(spark, sf).join(named, "item_id", "left").withColumn("respondent", F.coalesce("respondent", F.lit("UNKNOWN")))
    flat = rows.groupBy("respondent", "evaluator").agg(F.avg(F.col("accurate").cast("double")).alias("accuracy"))
    return G.pivoted(flat, ["respondent"], "evaluator", list(X.EVALUATORS), "accuracy")


def summary_matrix(spark, sf):
    flat = G.accuracy(_predicted(spark, sf), "evaluator", "condition")
    return G.pivoted(flat, ["condition"], "evaluator", list(X.EVALUATORS), "accuracy")


def balanced_accuracy(spark, sf):
    return rounded(G.balanced(_baseline(spark, sf)))


def failing_cases(spark, sf):
    p = _baseline(spark, sf).where("not (evaluator = 'model-d' and article = '14')")
    return G.failing(p, list(X.EVALUATORS)).drop("case_name", "article", "grp", "violation_label")


def pilot_compare(spark, sf):
    p = _baseline(spark, sf)
    return rounded(G.compared(p, p.where("article in ('3', '6', '8')")))


def completeness(spark, sf):
    p = _predicted(spark, sf).where("not (evaluator = 'model-b' and condition = 'factual') and not (evaluator = 'model-c' and article = '10')")
    return G.completeness(p, X.cases(spark, sf), list(X.EVALUATORS), list(X.CONDITIONS))


def collision_check(spark, sf):
    r = X.responses(spark, sf).where("sample_idx < 3 and evaluator = 'model-a'")
    return G.collisions(r, "response")


def dataset_stats(spark, sf):
    got = rounded(G.dataset_stats(X.cases(spark, sf)))
    return got.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


def country_stats(spark, sf):
    return rounded(G.country_stats(X.cases(spark, sf)))


def value_counts(spark, sf):
    return G.value_counts(X.cases(spark, sf), ["violation_label", "article", "grp", "respondent"])


def cost_model(spark, sf):
    return rounded(G.costs(X.cases(spark, sf), spark.createDataFrame(MODELS, "model string, price_in double, price_out double"), 5))


def progress_matrix(spark, sf):
    done = _predicted(spark, sf).where("condition in ('predictive', 'challenge') and evaluator <> 'model-b'").select(F.col("evaluator").alias("model"), F.col("condition").alias("stage"))
    return G.progress(done, list(X.EVALUATORS), ["predictive", "normative", "challenge"])


def todo(spark, sf):
    done = _predicted(spark, sf).where("evaluator in ('model-a', 'model-b') and condition = 'predictive'").select("evaluator", "condition")
    w = work_list(X.cases(spark, sf).select("item_id", "article", "grp"), list(X.EVALUATORS), ["predictive", "normative"], 3, done)
    return w.select("evaluator", "condition", request_id(F.col("item_id"), F.col("article"), F.col("grp"), F.concat(F.lit("sample_"), F.col("sample_idx").cast("string"))).alias("request"))


def top_k(spark, sf):
    return G.top_k(X.table(spark, sf, "events").withColumn("user_id", F.col("user_id").cast("string")), "user_id", 15)


def conclusion_pairs(spark, sf):
    return C.conclusion_pairs(X.conclusions(spark, sf), keep_unparsed=True).select("doc_id", "article", "violation_label")


def truncate_marker(spark, sf):
    t = F.col("full_text")
    return X.texts(spark, sf).select("doc_id", F.md5(T.before_marker(t).cast("binary")).alias("head"), t.rlike(T.MARKER).alias("marked"))


def verdict_free(spark, sf):
    """Curated texts: truncated, scrubbed, measured, excluded where too short."""
    return rounded(C.verdict_free(X.texts(spark, sf)).drop("full_text"))


def conclusion_scrub(spark, sf):
    clean, gone = T.scrubbed(F.col("full_text"))
    return X.texts(spark, sf).select("doc_id", clean.alias("clean"), gone.alias("n_dropped"))


def scrub_lines(spark, sf):
    """The scrub over lines as sentences, which SQL can split alike."""
    lines = F.split("full_text", "\n")
    kept = F.filter(lines, lambda s: ~s.rlike(T.LEAK))
    return X.texts(spark, sf).select("doc_id", (F.size(lines) - F.size(kept)).alias("n_dropped"), F.length(F.array_join(kept, "\n")).alias("n_chars"))


def leak_flag(spark, sf):
    return X.texts(spark, sf).select("doc_id", T.own_article_leak(F.col("full_text"), F.col("article")).alias("leak"))


def stage3_repair(spark, sf):
    leak = F.when(F.col("doc_id") % 5 == 1, F.array(F.concat(F.lit("Accordingly, there has been no violation of Article "), F.col("article"), F.lit(" of the Convention.")))).otherwise(F.array().cast("array<string>"))
    t = X.texts(spark, sf).withColumn("leaking_sentences", leak).withColumnRenamed("full_text", "text_nv")
    return C.repaired(t).drop("leaking_sentences")


def verified_cases(spark, sf):
    d = F.col("doc_id")
    reply = F.when(d % 4 == 0, F.lit('```json\n{"leaks_verdict": true, "leaking_sentences": ["a", "b"], "confidence": "high"}\n```')).when(d % 4 == 1, '{"leaks_verdict": false, "leaking_sentences": []}').otherwise("not json")
    cases = X.texts(spark, sf).select("item_id", "doc_id")
    replies = cases.where(d % 3 != 0).select("item_id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("verifier"), F.when(F.col("verifier") == "first", reply).otherwise('{"leaks_verdict": false, "leaking_sentences": ["c"]}').alias("reply"))
    return C.verified(cases, replies).select("doc_id", "leaks", F.array_join("leaking_sentences", ",").alias("sentences"))


def html_text(spark, sf):
    return C.html_texts(X.table(spark, sf, "pages")).select("page_id", "text")


def respondent_clean(spark, sf):
    return C.clean_respondents(X.cases(spark, sf)).select("doc_id", "old_respondent", "respondent")


def rename_log(spark, sf):
    return C.rename_log(C.clean_respondents(X.cases(spark, sf)))


def contamination_input(spark, sf):
    cases = X.cases(spark, sf).join(X.texts(spark, sf).select("doc_id", "full_text"), "doc_id").withColumn("text_nv", T.before_marker(F.col("full_text")))
    got = C.contamination_input(cases, articles={"2": "P1-2"})
    return got.select("doc_id", "item_id", "article", F.length("full_case_text_no_verdict").alias("n_free"), F.length("full_case_text").alias("n_full"))


def upsert_merge(spark, sf):
    got = C.upserted(X.records(spark, sf, False), X.records(spark, sf, True))
    return got.select("item_id", "article", "decision_date", "value", "ord", "replaced", F.col("place.ord").alias("place"))


def refresh_since(spark, sf):
    got = C.refreshed(X.records(spark, sf, False).where("ord % 7 <> 1"), X.records(spark, sf, True).withColumn("item_id", F.concat("item_id", F.lit("-"), (F.col("ord") % 5).cast("string"))))
    return got.select("item_id", "article", "decision_date", "ord")


def stratified_sample(spark, sf):
    return C.stratified(X.cases(spark, sf), 5, 10).select("respondent", "item_id", "article")


def placeholder_replace(spark, sf):
    t = X.table(spark, sf, "conversations")
    text = F.concat(F.lit("[NAME] told [NAME_2]: "), F.coalesce("text", F.lit("")))
    return t.select("conv_id", "turn", F.md5(T.replaced(text, SLOTS).cast("binary")).alias("replaced"), F.md5(T.pronouns(F.concat(F.lit("gave [P] it. [P] left. "), F.coalesce("text", F.lit(""))), "[P]", "they", "them", ["gave", "told"]).cast("binary")).alias("pronouns"))


def prompt_build(spark, sf):
    return X.texts(spark, sf).select("doc_id", F.md5(prompts.prompt(prompts.TEMPLATES["normative"], F.col("article"), F.col("full_text"), 50_000).cast("binary")).alias("prompt"))


def messages_build(spark, sf):
    got = prompts.conversations(X.table(spark, sf, "conversations"))
    return got.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "|").cast("binary")).alias("messages"), "n_turns")


def request_params(spark, sf):
    m = X._pick(MODEL_IDS, F.col("doc_id") % 4)
    return X.cases(spark, sf).select("doc_id", m.alias("model"), prompts.short_name(m).alias("file"), *(c.alias(n) for n, c in prompts.request_params(m).items()))


def inference(spark, sf):
    """The baseline stage from cases to votes, with answers that need no network."""
    cases = X.cases(spark, sf).select("item_id", "case_name", "article", "grp", "violation_label")
    work = work_list(cases, list(X.EVALUATORS[:2]), ["predictive"], 3).withColumn("model", F.col("evaluator"))
    asked = work.withColumn("messages", prompts.messages(F.col("model"), F.lit(prompts.SYSTEM), F.concat_ws("::", "item_id", F.col("sample_idx").cast("string"))))
    rated = infer.respond(asked).withColumn("rating", R.rating_of(F.col("response"), F.col("status")))
    return rounded(predictions(rated).select("evaluator", "item_id", "avg_rating", "prediction", "accurate"))


QUERIES = {f.__name__: f for f in (baseline_by_article, country_pivot, summary_matrix, balanced_accuracy, failing_cases, pilot_compare, completeness, collision_check, dataset_stats, country_stats, value_counts, cost_model, progress_matrix, todo, top_k, conclusion_pairs, truncate_marker, verdict_free, conclusion_scrub, scrub_lines, leak_flag, stage3_repair, verified_cases, html_text, respondent_clean, rename_log, contamination_input, upsert_merge, refresh_since, stratified_sample, placeholder_replace, prompt_build, messages_build, request_params, inference)}

# RE2 has the same patterns but for the flag of Unix line ends, which it always has
_MARKER = T.MARKER.replace("(?imd)", "(?im)").replace("'", "''")
_LEAK = T.LEAK.replace("'", "''")
_RESPONDENTS = """CASE respondent WHEN 'THE NETHERLANDS' THEN 'NETHERLANDS' WHEN 'TÜRKİYE' THEN 'TURKEY' WHEN 'V. POLAND' THEN 'POLAND' WHEN 'AND OTHERS V. UKRAINE' THEN 'UKRAINE' WHEN 'REPUBLIC OF MOLDOVA' THEN 'MOLDOVA'
  WHEN 'THE UNITED KINGDOM' THEN 'UNITED KINGDOM' WHEN 'ITALIE' THEN 'ITALY' WHEN 'HUNGARY [GC]' THEN 'HUNGARY' ELSE respondent END"""
_BASE = "base AS (SELECT *, CAST(" + _ACCURATE + " AS INTEGER) AS ok FROM fx_predictions WHERE condition = 'predictive')"


def _pivot_sql(of: str) -> str:
    return ", ".join(f"round(max({of}) FILTER (evaluator = '{e}'), 3) AS \"{e}\"" for e in X.EVALUATORS)


def _lookup_sql(which: int) -> str:
    return "CASE article " + " ".join(f"WHEN '{a}' THEN '{t[which]}'" for a, t in prompts.TESTS.items()) + f" ELSE '{prompts.OTHER[which]}' END"


def _prompt_sql() -> str:
    out = "'" + prompts.TEMPLATES["normative"].replace("'", "''") + "'"
    for name, value in (("{article}", "article"), ("{title}", _lookup_sql(0)), ("{test}", _lookup_sql(1)), ("{case_text}", "substr(full_text, 1, 50000)")):
        out = f"replace({out}, '{name}', {value})"
    return out


def _replaced_sql(text: str) -> str:
    for old in sorted(SLOTS, key=len, reverse=True):
        text = f"replace({text}, '{old}', '{SLOTS[old]}')"
    return text


_LEVEL = "count(*) AS n, count(*) FILTER (is_violation) AS n_violation, count(*) FILTER (NOT is_violation) AS n_no_violation, count(*) FILTER (ok = 1) AS passed, avg(ok) AS r, avg(ok) FILTER (is_violation) AS v, avg(ok) FILTER (NOT is_violation) AS w"
ORACLE = {
    "baseline_by_article": X.with_views("fx_predictions", f"""{_BASE}
SELECT article, count(*) AS n, round(avg(ok), 6) AS accuracy, round(sum(num_abstentions) / CAST(sum(num_samples) AS DOUBLE), 6) AS abstention_rate, round(avg(avg_rating), 6) AS mean_rating,
  round(avg(ok) FILTER (is_violation), 6) AS accuracy_violation, round(avg(ok) FILTER (NOT is_violation), 6) AS accuracy_no_violation, {_lookup_sql(0)} AS title FROM base GROUP BY article"""),
    "country_pivot": X.with_views("fx_predictions", f"""{_BASE},
named AS (SELECT item_id, {_RESPONDENTS} AS respondent FROM fx_cases),
flat AS (SELECT respondent, evaluator, avg(ok) AS a FROM base JOIN named USING (item_id) GROUP BY ALL)
SELECT respondent, {_pivot_sql("a")} FROM flat GROUP BY respondent"""),
    "summary_matrix": X.with_views("fx_predictions", f"""flat AS (SELECT condition, evaluator, avg(CAST({_ACCURATE} AS INTEGER)) AS a FROM fx_predictions GROUP BY ALL)
SELECT condition, {_pivot_sql("a")} FROM flat GROUP BY condition"""),
    "balanced_accuracy": X.with_views("fx_predictions", f"""{_BASE},
rows_ AS (SELECT evaluator, NULL AS article, NULL AS grp, 'all' AS level, {_LEVEL} FROM base GROUP BY evaluator
  UNION ALL SELECT evaluator, article, NULL, 'article', {_LEVEL} FROM base GROUP BY evaluator, article
  UNION ALL SELECT evaluator, NULL, grp, 'group', {_LEVEL} FROM base GROUP BY evaluator, grp)
SELECT evaluator, article, grp, level, n, n_violation, n_no_violation, passed, round(r, 6) AS pass_rate, round(v, 6) AS accuracy_violation, round(w, 6) AS accuracy_no_violation,
  round(CASE WHEN v IS NULL THEN w WHEN w IS NULL THEN v ELSE (v + w) / 2 END, 6) AS balanced_accuracy FROM rows_"""),
    "failing_cases": X.with_views("fx_predictions", f"""{_BASE},
flags AS (SELECT item_id, {", ".join(f"bool_or(ok = 1) FILTER (evaluator = '{e}') AS \"{e}\"" for e in X.EVALUATORS)}, CAST(sum(ok) AS INTEGER) AS n_passed FROM base WHERE NOT (evaluator = 'model-d' AND article = '14') GROUP BY item_id)
SELECT *, n_passed = 0 AS fails_all, n_passed > 0 AND n_passed < {len(X.EVALUATORS)} AS fails_some FROM flags"""),
    "pilot_compare": X.with_views("fx_predictions", f"""{_BASE},
two AS (SELECT evaluator, count(*) AS n_full, avg(ok) AS a, count(*) FILTER (article IN ('3', '6', '8')) AS n_pilot, avg(ok) FILTER (article IN ('3', '6', '8')) AS b FROM base GROUP BY evaluator)
SELECT evaluator, n_full, round(a, 6) AS accuracy_full, n_pilot, round(b, 6) AS accuracy_pilot, round(a - b, 6) AS difference FROM two WHERE n_pilot > 0"""),
    "completeness": X.with_views("fx_predictions", f"""got AS (SELECT evaluator, condition, count(*) FILTER (NOT (evaluator = 'model-b' AND condition = 'factual') AND NOT (evaluator = 'model-c' AND article = '10')) AS actual FROM fx_predictions GROUP BY ALL),
full_ AS (SELECT *, (SELECT count(*) FROM fx_cases) AS expected FROM got)
SELECT *, expected - actual AS missing, CASE WHEN actual = 0 THEN 'MISSING' WHEN actual < expected THEN 'INCOMPLETE' WHEN actual > expected THEN 'EXTRA' ELSE 'COMPLETE' END AS status FROM full_"""),
    "collision_check": X.with_views("fx_responses", "SELECT item_id, count(*) AS n, count(DISTINCT nullif(trim(response), '')) AS texts FROM fx_responses WHERE sample_idx < 3 AND evaluator = 'model-a' GROUP BY item_id HAVING n > 1 AND texts = 1"),
    "dataset_stats": X.with_views("fx_cases", "SELECT count(*) AS pairs, count(DISTINCT item_id) AS cases, count(DISTINCT respondent) AS countries, count(DISTINCT article) AS articles, round(avg(CAST(violation_label = 'violation' AS INTEGER)), 6) AS violation_share, CAST(min(decision_date) AS VARCHAR) AS first_date, CAST(max(decision_date) AS VARCHAR) AS last_date FROM fx_cases"),
    "country_stats": X.with_views("fx_cases", "SELECT respondent, count(*) AS pairs, count(DISTINCT item_id) AS cases, round(100 * avg(CAST(violation_label = 'violation' AS INTEGER)), 6) AS violation_pct FROM fx_cases GROUP BY respondent"),
    "value_counts": X.with_views("fx_cases", " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM fx_cases GROUP BY {c}" for c in ("violation_label", "article", "grp", "respondent"))),
    "cost_model": X.with_views("fx_cases", f"""models(model, price_in, price_out) AS (VALUES {", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, a, b in MODELS)}),
kinds(stage, per_case, tin, tout) AS (VALUES {", ".join(f"('{s}', {once + each * 5}, {i}, {o})" for s, once, each, i, o in G.CALLS)}),
rows_ AS (SELECT model, stage, (SELECT count(*) FROM fx_cases) * per_case AS calls, price_in, price_out, tin, tout FROM models, kinds)
SELECT model, stage, CAST(sum(calls) AS BIGINT) AS calls, round(sum(calls * (tin * price_in + tout * price_out) / 1e6), 6) AS cost FROM rows_ GROUP BY ROLLUP (model, stage)"""),
    "progress_matrix": f"SELECT model, CASE WHEN model = 'model-b' OR (SELECT count(*) FROM labels) = 0 THEN 'PENDING' ELSE 'done' END AS predictive, 'PENDING' AS normative, CASE WHEN model = 'model-b' OR (SELECT count(*) FROM labels) = 0 THEN 'PENDING' ELSE 'done' END AS challenge FROM (VALUES {', '.join(f"('{e}')" for e in X.EVALUATORS)}) t(model)",
    "todo": X.with_views("fx_cases", f"""SELECT e.evaluator, c.condition, item_id || '::' || article || '::' || grp || '::sample_' || s AS request
FROM fx_cases, (VALUES {", ".join(f"('{e}')" for e in X.EVALUATORS)}) e(evaluator), (VALUES ('predictive'), ('normative')) c(condition), range(3) t(s) WHERE NOT (e.evaluator IN ('model-a', 'model-b') AND c.condition = 'predictive')"""),
    "top_k": "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 15",
    "conclusion_pairs": X.with_views("fx_conclusion", """parts AS (SELECT doc_id, unnest(string_split(conclusion, ';')) AS p FROM fx_conclusion),
found AS (SELECT doc_id, regexp_extract(p, '(?i)article\\s+([P\\d][-\\d]*)', 1) AS article, CASE WHEN regexp_matches(p, '(?i)no\\s+violation') THEN 'no_violation' WHEN regexp_matches(p, '(?i)violation') THEN 'violation' END AS violation_label FROM parts),
good AS (SELECT * FROM found WHERE article <> '' AND violation_label IS NOT NULL)
SELECT f.doc_id, coalesce(article, '') AS article, coalesce(violation_label, 'unknown') AS violation_label FROM fx_conclusion f LEFT JOIN good USING (doc_id)"""),
    "truncate_marker": X.with_views("fx_text", f"SELECT doc_id, md5(regexp_extract(full_text || chr(1), '(?s)^(.*?)(?:\\x01$|' || '{_MARKER.replace('^', '(?m:^)').replace('(?im)', '(?i)').replace('merits$', 'merits(?m:$)')}' || ')', 1)) AS head, regexp_matches(full_text, '{_MARKER}') AS marked FROM fx_text"),
    "scrub_lines": X.with_views("fx_text", f"""lines AS (SELECT doc_id, string_split(full_text, E'\\n') AS l FROM fx_text),
kept AS (SELECT doc_id, len(l) AS n, list_filter(l, lambda s: NOT regexp_matches(s, '{_LEAK}')) AS k FROM lines)
SELECT doc_id, CAST(n - len(k) AS INTEGER) AS n_dropped, CAST(length(array_to_string(k, E'\\n')) AS INTEGER) AS n_chars FROM kept"""),
    "leak_flag": X.with_views("fx_text", "SELECT doc_id, regexp_matches(full_text, '(?i)there has (?:accordingly )?been (?:no|a) violation of article\\s+\\Q' || article || '\\E\\b') AS leak FROM fx_text"),
    "verified_cases": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 = 0 AS leaks, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'a,b,c' ELSE 'c' END AS sentences FROM documents",
    "respondent_clean": X.with_views("fx_cases", f"SELECT doc_id, respondent AS old_respondent, {_RESPONDENTS} AS respondent FROM fx_cases"),
    "rename_log": X.with_views("fx_cases", f"SELECT respondent AS old_respondent, {_RESPONDENTS} AS respondent, count(*) AS n FROM fx_cases GROUP BY ALL HAVING respondent <> {_RESPONDENTS}").replace("HAVING respondent <>", "HAVING fx_cases.respondent <>"),
    "contamination_input": X.with_views("fx_cases fx_text", f"""joined AS (SELECT c.doc_id, c.item_id, CASE c.article WHEN '2' THEN 'P1-2' ELSE c.article END AS article, full_text, regexp_extract(full_text || chr(1), '(?s)^(.*?)(?:\\x01$|' || '{_MARKER.replace('^', '(?m:^)').replace('(?im)', '(?i)').replace('merits$', 'merits(?m:$)')}' || ')', 1) AS head FROM fx_cases c JOIN fx_text t ON c.doc_id = t.doc_id)
SELECT doc_id, item_id, article, CAST(length(head) AS INTEGER) AS n_free, CAST(length(full_text) AS INTEGER) AS n_full FROM joined WHERE item_id LIKE '001-%' AND length(head) > 0"""),
    "upsert_merge": X.with_views("fx_existing fx_new", """every AS (SELECT *, 0 AS src FROM fx_existing UNION ALL SELECT *, 1 FROM fx_new),
firsts AS (SELECT item_id, article, min(src) AS src0, arg_min(ord, src * 1000000000000 + ord) AS place, max(src) AS src1 FROM every GROUP BY ALL),
last_new AS (SELECT * FROM fx_new QUALIFY row_number() OVER (PARTITION BY item_id, article ORDER BY ord DESC) = 1),
first_old AS (SELECT * FROM fx_existing QUALIFY row_number() OVER (PARTITION BY item_id, article ORDER BY ord) = 1)
SELECT f.item_id, f.article, coalesce(n.decision_date, o.decision_date) AS decision_date, coalesce(n.value, o.value) AS value, coalesce(n.ord, o.ord) AS ord, src0 = 0 AND src1 = 1 AS replaced, place
FROM firsts f LEFT JOIN last_new n ON f.item_id = n.item_id AND f.article = n.article LEFT JOIN first_old o ON f.item_id = o.item_id AND f.article = o.article"""),
    "refresh_since": X.with_views("fx_existing fx_new", """old AS (SELECT * FROM fx_existing WHERE ord % 7 <> 1), since AS (SELECT max(CAST(decision_date AS DATE)) - 1 AS d FROM old)
SELECT item_id || '-' || (ord % 5) AS item_id, article, decision_date, ord FROM fx_new, since WHERE CAST(decision_date AS DATE) >= d AND item_id || '-' || (ord % 5) NOT IN (SELECT item_id FROM old)"""),
    "stratified_sample": X.with_views("fx_cases", """tops AS (SELECT respondent FROM fx_cases GROUP BY respondent ORDER BY count(*) DESC, respondent LIMIT 5),
ids AS (SELECT DISTINCT respondent, item_id FROM fx_cases WHERE respondent IN (SELECT respondent FROM tops)),
chosen AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY respondent ORDER BY md5(item_id || ':42'), item_id) <= 10)
SELECT respondent, item_id, article FROM fx_cases JOIN chosen USING (respondent, item_id)"""),
    "placeholder_replace": f"""SELECT conv_id, turn, md5({_replaced_sql("'[NAME] told [NAME_2]: ' || coalesce(text, '')")}) AS replaced, md5(replace(regexp_replace('gave [P] it. [P] left. ' || coalesce(text, ''), '(?i)(gave|told)\\s+\\[P\\]', '\\1 them', 'g'), '[P]', 'they')) AS pronouns FROM conversations""",
    "prompt_build": X.with_views("fx_text", f"SELECT doc_id, md5({_prompt_sql()}) AS prompt FROM fx_text"),
    "messages_build": "SELECT conv_id, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn, role, text)) AS messages, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "request_params": X.with_views("fx_cases", f"""m AS (SELECT doc_id, {X._pick_sql(MODEL_IDS, "doc_id % 4")} AS model FROM fx_cases)
SELECT doc_id, model, replace(split_part(model, '/', 2), '.', '_') AS file, CASE WHEN model LIKE '%gpt-5%' THEN 2048 END AS max_completion_tokens, CASE WHEN model LIKE '%gpt-5%' THEN 'low' END AS reasoning_effort,
  CASE WHEN model LIKE '%gemini%' OR model LIKE '%deepseek-v4%' THEN 4096 WHEN model NOT LIKE '%gpt-5%' THEN 100 END AS max_tokens, CASE WHEN model NOT LIKE '%gpt-5%' THEN CAST(1.0 AS DOUBLE) END AS temperature FROM m"""),
}
