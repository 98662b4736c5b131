"""Hand-computed answers for ratings, statistics and texts."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ratings as R
from plumbline.functions import stats as S
from plumbline.functions import text as T


def column(spark, values, kind, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_extract_rating(spark):
    texts = ["4", "Rating: 4", "I rate it 4/5", "", None, "ERROR: Error code: 429", "no idea", "10", "9 8 7 6 5"]
    assert column(spark, texts, "string", R.extract_rating) == [4, 4, 4, 3, 3, 4, 3, 1, 5]
    assert column(spark, texts[3:5], "string", lambda c: R.extract_rating(c, None)) == [None, None]
    assert column(spark, ["ERROR: 429"], "string", lambda c: R.rating_of(c, F.lit("error"))) == [3]


def test_accuracy_at_three(spark):
    assert column(spark, [2.9, 3.0, 3.1, None], "double", lambda c: R.accurate(c, F.lit(True))) == [True, False, False, None]
    assert column(spark, [2.9, 3.0, 3.1], "double", lambda c: R.accurate(c, F.lit(False))) == [False, False, True]
    assert column(spark, [2.6, 3.0], "double", R.says_violation) == [True, False]
    assert column(spark, [2.6, 2.5], "double", lambda c: R.says_violation(c, "gt2_5")) == [True, False]
    assert column(spark, [1, 3, 5], "int", lambda c: R.distance_score(c, F.lit(True))) == [1.0, 0.5, 0.0]
    assert column(spark, [1, 5], "int", lambda c: R.oriented(c, "high")) == [5, 1]


@pytest.mark.parametrize("before, after, want", [(2, 4, "flipping"), (3, 5, "polarizing"), (4, 3, "moderating"), (2, 1, "polarizing"), (1, 2, "moderating"), (3, 3, "unchanged"), (5, 1, "flipping")])
def test_change_category(spark, before, after, want):
    assert column(spark, [0], "int", lambda c: R.change_category(F.lit(before), F.lit(after))) == [want]


def test_percent(spark):
    assert column(spark, [0.1234, None, math.nan], "double", R.percent) == ["12.3", "--", "--"]


def exact(n01, n10):
    n, k = n01 + n10, min(n01, n10)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def test_mcnemar(spark):
    pairs = [(0, 0), (1, 5), (5, 1), (3, 3), (0, 12), (40, 61), (480, 530), (0, 1)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a bigint, b bigint")
    got = [r[0] for r in df.orderBy("k").select(S.mcnemar_exact(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([exact(*p) for p in pairs], abs=1e-12)


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 10), (10, 10), (0, 0)], "k bigint, n bigint")
    got = df.select(*S.wilson(F.col("k"), F.col("n"))).collect()
    assert got[0] == pytest.approx((0.490162, 0.943318), abs=1e-6)
    assert got[1][0] == 0 and got[2][1] == pytest.approx(1) and tuple(got[3]) == (None, None)


LEAKY = "The applicant complained. 60. Accordingly, there has been no violation of Article 8 of the Convention. Article 13 was also invoked. The Government disagreed."


def test_scrub(spark):
    clean = column(spark, [LEAKY, "Nothing here. Nor here.", None], "string", lambda c: F.struct(*T.scrubbed(c)))
    assert tuple(clean[0]) == ("The applicant complained. 60. Article 13 was also invoked. The Government disagreed.", 1)
    assert tuple(clean[1]) == ("Nothing here. Nor here.", 0) and clean[2][0] is None
    again = column(spark, [clean[0][0]], "string", lambda c: T.scrubbed(c)[1])
    assert again == [0]


def test_own_leak(spark):
    leak = lambda a: column(spark, [LEAKY], "string", lambda c: T.own_article_leak(c, F.lit(a)))
    assert leak("8") == [True] and leak("13") == [False] and leak("P1-1") == [False]


def test_truncate(spark):
    texts = ["Facts here.\nMERITS\nThe rest.", "Facts. More facts. The Court finds that there has been a violation of Article 3. End.", "Plain facts.", "violation of", None, "Facts.\nII. THE COURT’S ASSESSMENT\nx", "No stop violated Article 3"]
    got = column(spark, texts, "string", lambda c: F.struct(*T.truncated(c)))
    assert tuple(got[0]) == ("Facts here.", "court_assessment_start")
    assert tuple(got[1]) == ("Facts. More facts.", "aggressive_fix: conclusory_pattern")
    assert tuple(got[2]) == ("Plain facts.", "no_truncation") and tuple(got[4]) == (None, None)
    assert got[5][0] == "Facts." and tuple(got[6]) == ("No stop violated Article 3", "no_truncation")


def test_conclusions(spark):
    texts = ["Violation of Article 3", "No violation of Article 8; Violation of Article 3", "Violation of Article 1 of Protocol No. 1", "Struck out", "", None, "Article 5"]
    got = column(spark, texts, "string", T.conclusion_parts)
    assert [[tuple(x) for x in r] for r in got] == [[("3", "violation")], [("8", "no_" + "violation"), ("3", "violation")], [("1", "violation")], [], [], [], []]


def test_respondents(spark):
    names = ["THE NETHERLANDS", "TÜRKİYE", "V. POLAND", "AND OTHERS V. UKRAINE", "HUNGARY [GC]", '"MALTA"', "ATLANTIS", "AND X V. BOSNIA AND HERZEGOVINA", "THE REPUBLIC OF MOLDOVA"]
    assert column(spark, names, "string", T.normal_country) == ["NETHERLANDS", "TURKEY", "POLAND", "UKRAINE", "HUNGARY", "MALTA", "ATLANTIS", "BOSNIA AND HERZEGOVINA", "MOLDOVA"]
    assert column(spark, ["X v. France", "Y c. Italie (no. 2)", "Z", "A v. Turkey [GC]"], "string", T.extracted_respondent) == ["FRANCE", "ITALIE", None, "TURKEY"]
    assert column(spark, ["UNKNOWN", "V. X", "FRANCE", "AND B"], "string", T.needs_extraction) == [True, True, False, True]
    assert column(spark, ["FRANCE AND GERMANY", "FRANCE", "A AND B"], "string", T.is_multiple) == [True, False, False]


def test_placeholders(spark):
    assert column(spark, ["[N] and [N_2]"], "string", lambda c: T.replaced(c, {"[N": "x", "[N_2]": "y", "[N]": "z"})) == ["z and y"]
    assert column(spark, ["He told [P]. [P] left"], "string", lambda c: T.pronouns(c, "[P]", "she", "her", ["told"])) == ["He told her. she left"]


def test_verifier(spark):
    got = column(spark, ['```json\n{"leaks_verdict": true, "leaking_sentences": ["a"]}\n```', "nonsense"], "string", T.verifier_reply)
    assert got[0].leaks_verdict is True and got[0].leaking_sentences == ["a"] and got[1].leaks_verdict is None
