"""Operators on small tables: ties, nulls, empty groups, repeated rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import changes, curate, infer, paired, prompts, reports
from plumbline.operators.predictions import predictions, stitched, work_list
from plumbline.sources import readers
from plumbline.streaming import refresh

RATING = "evaluator string, condition string, item_id string, case_name string, article string, grp string, violation_label string, sample_idx int, rating int"


def rated(spark, cases):
    """{(evaluator, condition, item, label): ratings}"""
    return spark.createDataFrame([(e, c, i, i, "3", "a", label, k, r) for (e, c, i, label), rs in cases.items() for k, r in enumerate(rs)], RATING)


def test_votes(spark):
    votes = {"tie": [4, 1, 5, 2, 3], "all3": [3, 3], "null": [None, None], "most": [3, 3, 1], "first": [1, 5]}
    got = {r.item_id: r for r in predictions(rated(spark, {("e", "predictive", k, "violation"): v for k, v in votes.items()})).collect()}
    assert {k: got[k].prediction for k in votes} == {"tie": "no_violation", "all3": "abstention", "null": None, "most": "abstention", "first": "violation"}
    assert got["tie"].ratings == votes["tie"] and got["all3"].abstained and got["null"].avg_rating is None and got["all3"].accurate is False
    assert predictions(rated(spark, {("e", "c", "i", "violation"): [1]}).limit(0)).count() == 0


def paired_rows(spark):
    cases = {}
    for k in range(30):
        label = "violation" if k % 3 else "no_violation"
        cases["e", "predictive", f"i{k:02}", label] = [1 + k % 5] * 2
        cases["e", "normative", f"i{k:02}", label] = [1 + (k * 7) % 5, 1 + k % 2]
    cases["e", "normative", "only", "violation"] = [1]
    return paired.pairs(predictions(rated(spark, cases)), "predictive", ["normative"])


def test_paired(spark):
    rows = paired_rows(spark)
    assert rows.count() == 30
    t = paired.tests(rows).first()
    by = [(r.right_a, r.right_b) for r in rows.collect()]
    assert (t.n, t.n01, t.n10) == (30, by.count((False, True)), by.count((True, False)))
    assert t.difference == pytest.approx((t.n01 - t.n10) / 30)
    swapped = rows.select("evaluator", "condition", F.col("right_b").alias("right_a"), F.col("right_a").alias("right_b"), "says_a", "says_b")
    s = paired.tests(swapped).first()
    assert (s.n01, s.n10, s.p_value) == (t.n10, t.n01, t.p_value)


def test_bootstrap(spark):
    rows = paired_rows(spark)
    got = paired.bootstrap(rows, 2000).first()
    d = np.array([int(r.right_b) - int(r.right_a) for r in rows.orderBy("item_id").collect()])
    rng = np.random.RandomState(42)
    means = [rng.choice(d, size=len(d), replace=True).mean() for _ in range(2000)]
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    counts = paired.bootstrap_from_counts(paired.tests(rows)).first()
    assert counts.ci_low == pytest.approx(got.ci_low, abs=0.07) and counts.ci_high == pytest.approx(got.ci_high, abs=0.07)


def test_adjusted(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("e", str(k), x) for k, x in enumerate(p)], "evaluator string, condition string, p_value double")
    got = {r.condition: r for r in paired.adjusted(df).collect()}
    assert [got[str(k)].p_holm for k in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [got[str(k)].p_bh for k in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_directional(spark):
    df = spark.createDataFrame([("e", 3.0, 2.0), ("e", 2.0, 3.0), ("e", 4.0, 4.0), ("f", 1.0, 1.0)], "evaluator string, avg_a double, avg_b double")
    got = {r.evaluator: r for r in changes.directional(df, "evaluator").collect()}
    assert got["e"].pct_toward + got["e"].pct_away == 100 and got["e"].pct_from_abstention == 50 and got["e"].avg_magnitude == 1
    assert got["f"].changes == 0 and got["f"].pct_toward == 0 and got["f"].avg_magnitude == 0
    arrays = spark.createDataFrame([("e", [1, 2, 3], [2, 2])], "evaluator string, o array<int>, c array<int>")
    assert changes.unzipped(arrays, "o", "c").count() == 2


def test_stitch_and_work(spark):
    req = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "item_id string, sample_idx int")
    ans = spark.createDataFrame([("a", 0, "5", "ok"), ("a", 1, "429", "error")], "item_id string, sample_idx int, response string, status string")
    assert sorted(tuple(r) for r in stitched(req, ans, ["item_id", "sample_idx"]).collect()) == [("a", 0, 5), ("a", 1, 3), ("b", 0, 3)]
    done = spark.createDataFrame([("x", "p")], "evaluator string, condition string")
    assert work_list(spark.range(3), ["x", "y"], ["p", "q"], 2, done).count() == 3 * 3 * 2


def test_balanced_single_class(spark):
    p = predictions(rated(spark, {("e", "predictive", "i", "violation"): [1], ("e", "predictive", "j", "violation"): [5]}))
    got = reports.balanced(p).where("level = 'all'").first()
    assert (got.balanced_accuracy, got.accuracy_no_violation, got.n_no_violation) == (0.5, None, 0)
    f = reports.failing(p, ["e", "missing"]).collect()
    assert all(r.missing is None for r in f) and sum(r.fails_all for r in f) == 1


def test_upsert(spark):
    schema = "item_id string, article string, decision_date string, value double, ord bigint"
    old = spark.createDataFrame([("a", "1", "d", 1.0, 1), ("a", "1", "d", 2.0, 2), ("b", "1", "d", 3.0, 3), (None, "1", "d", 4.0, 4)], schema)
    new = spark.createDataFrame([("a", "1", "d", 5.0, 5), ("a", "1", "d", 6.0, 6), ("c", "1", "d", 7.0, 7), (None, "1", "d", 8.0, 8)], schema)
    got = {r.item_id: (r.value, r.replaced, r.place.ord) for r in curate.upserted(old, new).collect()}
    assert got == {"a": (6.0, True, 1), "b": (3.0, False, 3), "c": (7.0, False, 7), None: (4.0, False, 4)}
    once = curate.upserted(old, new).select(*old.columns)
    assert sorted(map(str, curate.upserted(once, new).select(*old.columns).collect())) == sorted(map(str, once.collect()))
    assert curate.upserted(old.limit(0), new.limit(0)).count() == 0


def test_refresh(spark):
    schema = "item_id string, decision_date string"
    old = spark.createDataFrame([("a", "2024-03-05"), ("b", "2024"), ("c", None)], schema)
    new = spark.createDataFrame([("a", "2024-03-06"), ("d", "2024-03-04"), ("e", "2024-03-03"), ("f", "bad")], schema)
    assert [r.item_id for r in curate.refreshed(old, new).collect()] == ["d"]
    assert {r.item_id for r in curate.refreshed(old.limit(0), new).collect()} == {"a", "d", "e"}


def test_stratified(spark):
    rows = [(c, f"{c}{k // 2}", str(k)) for c, n in (("X", 20), ("Y", 10), ("Z", 4), ("W", 10)) for k in range(n)]
    got = curate.stratified(spark.createDataFrame(rows, "respondent string, item_id string, article string"), 2, 3).collect()
    assert {r.respondent for r in got} == {"X", "W"} and len({r.item_id for r in got}) == 6 and len(got) == 12


def test_respondents_with_and(spark):
    rows = [("DOE AND RUSSIA", "x"), ("LEE AND UKRAINE", "x"), ("ARMENIA AND AZERBAIJAN", "x"), ("BOSNIA AND HERZEGOVINA", "x"), ("LEE AND THE NETHERLANDS", "x"), ("LEE AND NOBODY", "x"), ("FOO V. AND BAR", "A v. Italie"), (None, None), ("THE " + "X" * 2000, "x")]
    got = [r.respondent for r in curate.clean_respondents(spark.createDataFrame(rows, "respondent string, case_name string")).collect()]
    assert got[:6] == ["RUSSIA", "UKRAINE", "ARMENIA AND AZERBAIJAN", "BOSNIA AND HERZEGOVINA", "NETHERLANDS", "LEE AND NOBODY"]
    assert got[7:] == [None, "THE " + "X" * 2000]


def test_repairs_that_leave_too_little(spark):
    long = "A sentence that stays. " * 200
    rows = [("Short. Leak here.", ["Leak here."], "m", 100, False, None), (long + "Leak here.", ["Leak here."], "m", 9200, True, "before"), (long, None, "m", 4600, None, None), (None, [], None, None, None, None)]
    got = curate.repaired(spark.createDataFrame(rows, "text_nv string, leaking_sentences array<string>, method string, original_length int, excluded boolean, exclusion_reason string")).collect()
    assert got[0].text_nv == "Short. Leak here." and got[0].verdict_free_length == 17 and got[0].excluded and got[0].exclusion_reason == "too_short_after_repair"
    assert got[1].text_nv == long.strip() and got[1].excluded and got[1].exclusion_reason == "before" and got[1].method.startswith("m; ") and abs(got[1].retention - 50) < 0.1
    assert not got[2].excluded and got[2].method == "m" and got[3].excluded


def test_repair():
    text = "First fact. " * 3 + "Leak here. The Court therefore concludes x. Tail."
    got, done = curate.repaired_text(text, ["Leak here.", "", "missing"])
    assert got == ("First fact. " * 3).strip() and done == "removed; cleaned"
    assert curate.repaired_text("", ["x"]) == ("", "")


def test_verdict_free(spark):
    body = "The applicant was born in 1950. " * 30
    rows = [(1, "3", body + "\nMERITS\nx"), (2, "3", "short"), (3, "3", None), (4, "8", body + "Accordingly, there has been no violation of Article 8 of it. Next.")]
    got = {r.doc_id: r for r in curate.verdict_free(spark.createDataFrame(rows, "doc_id int, article string, full_text string")).collect()}
    assert got[1].truncated and not got[1].excluded and got[2].excluded and got[3].excluded
    curate.assert_no_leak(spark.createDataFrame([(got[4].article, got[4].text_nv)], "article string, text_nv string"))
    with pytest.raises(ValueError):
        curate.assert_no_leak(spark.createDataFrame(rows[3:], "doc_id int, article string, text_nv string"))


def test_html():
    page = "<title>T</title><style>x{}</style><p>A &amp;  B</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script><br>C"
    assert curate.text_of_html(page) == "T\nA & B\n\n1 2\n\nC"
    assert curate.text_of_html(None) is None and curate.text_of_html("") == ""


def test_inference(spark):
    calls = spark.createDataFrame([(k, m) for k, m in enumerate(["good", "busy", "dead", "bad"])], "id int, model string").withColumn("messages", prompts.messages(F.col("model"), F.lit("s"), F.lit("u")))

    def responder(model, messages):
        assert json.loads(messages)[-1]["role"] == "user"
        if model == "busy":
            raise infer.Retry
        if model == "dead":
            raise RuntimeError
        return "4"

    got = {r.model: (r.response, r.status) for r in infer.respond(calls, responder, 2, 1, 0.01).collect()}
    assert got == {"good": ("4", "ok"), "busy": (None, "error"), "dead": (None, "error"), "bad": ("4", "ok")}


def test_messages(spark):
    df = spark.createDataFrame([("google/gemini-2",), ("openai/gpt-5",)], "m string")
    a, b = (r[0] for r in df.select(prompts.challenged(F.col("m"), F.lit("s"), F.lit("u"), F.lit("2"), F.lit("sure?"))).collect())
    assert [x.role for x in a] == ["user", "assistant", "user"] and [x.role for x in b] == ["system", "user", "assistant", "user"]
    p = df.select(prompts.prompt(prompts.TEMPLATES["normative"], F.lit("99"), F.lit("text {title}"))).first()[0]
    assert p.endswith("text {title}") and "Article 99" in p


def test_readers(spark, tmp_path):
    rows = [{"item_id": "1", "decision_date": "2024-01-02T00:00", "case_text": "x"}, {"item_id": "2", "date": "2023-01-01", "verdict_free_text": "y"}, {"item_id": "3"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    assert readers.cases(spark, str(tmp_path / "c.json")).count() == 3
    got = readers.cases(spark, str(tmp_path / "c.json"), "2023-06-01", "2025-01-01").collect()
    assert [(r.item_id, r.full_text, r.decision_date) for r in got] == [("1", "x", "2024-01-02")]
    (tmp_path / "m1_mft_samples.csv").write_text('case_name,article,violation_label,avg_rating,is_accurate,num_abstentions,num_samples,sample_ratings\n"A, ""q""\nv. B",3,violation,2.0,True,0,2,"[2, 2]"\n')
    r = readers.result_csvs(spark, str(tmp_path / "*_mft_samples.csv")).first()
    assert (r.evaluator, r.sample_ratings, r.is_accurate, r.case_name) == ("m1", [2, 2], True, 'A, "q"\nv. B')
    for model in ("a", "b"):
        (tmp_path / "t" / model).mkdir(parents=True)
        (tmp_path / "t" / model / "rq1_results.json").write_text(json.dumps([{"case_name": "c"}]))
    assert {(r.model, r.stage) for r in readers.results(spark, str(tmp_path / "t"), "case_name string").collect()} == {("a", "rq1"), ("b", "rq1")}
    out = str(tmp_path / "o")
    readers.write_results(spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "model string, stage string, v int"), out)
    readers.write_results(spark.createDataFrame([("b", "x", 2)], "model string, stage string, v int"), out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("model", "v").collect()) == [("a", 1), ("b", 2)] and readers.finished(spark, out).count() == 2


def test_streaming(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    for k, rows in enumerate([[("a", 1.0, 1), ("b", 2.0, 2)], [("a", 3.0, 3), ("c", 4.0, 4)]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"item_id": i, "article": "x", "decision_date": "2024-01-01", "value": v, "ord": o}) for i, v, o in rows))
        refresh.refresh(spark, str(source), target, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.item_id: r.value for r in refresh.current(spark, target).collect()} == {"a": 3.0, "b": 2.0, "c": 4.0}
    again = spark.read.schema(refresh.RECORD).json(str(source / "1.json"))
    refresh.upsert_batch(again, 1, target)
    assert {r.item_id: r.value for r in refresh.current(spark, target).collect()} == {"a": 3.0, "b": 2.0, "c": 4.0}


def test_collisions(spark):
    rows = [("a", "t"), ("a", "t"), ("b", "t"), ("b", "u"), ("c", "t"), ("d", ""), ("d", "t"), ("e", None), ("e", None)]
    assert sorted(r.item_id for r in reports.collisions(spark.createDataFrame(rows, "item_id string, text string"), "text").collect()) == ["a", "d"]


def test_costs(spark):
    models = spark.createDataFrame([("m", 1.0, 10.0)], "model string, price_in double, price_out double")
    got = {r.stage: r for r in reports.costs(spark.range(10), models, 5).where("model = 'm'").collect()}
    assert got["rq1"].calls == 10 * 3 + 10 * 3 * 5 and got["rq3"].calls == 100
    assert got["baseline"].cost == pytest.approx(50 * (16000 + 100) / 1e6)
    assert got[None].calls == sum(got[s].calls for s in ("baseline", "rq1", "rq2", "rq3"))
