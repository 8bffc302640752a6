"""Scalar functions against small frames and the Python rules they stand for."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrascope.functions import contracts as C
from narrascope.functions import text as X


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_unknown_if_blank(spark):
    values = [None, "", "nan", " None ", "NaN\t", " a b ", "none such", " x "]
    expected = ["UNKNOWN"] * 5 + ["a b", "none such", "x"]
    assert apply(spark, X.unknown_if_blank, values) == expected


def test_strip_html(spark):
    values = ["<a href='x'>I-12</a>", "<br>", None, " plain ", "a < b"]
    assert apply(spark, X.strip_html, values) == ["I-12", "<br>", "UNKNOWN", "plain", "a < b"]


def test_codes_and_sex(spark):
    values = ["71.0", "71.5", " 12 ", "x1", None, "1e3", "nan", "-4.0", "inf"]
    assert apply(spark, X.normalize_code, values) == ["71", "71.5", "12", "x1", None, "1000", "nan", "-4", "inf"]
    assert apply(spark, X.integer_text, ["7.9", "", "abc", "5"]) == ["7", "UNKNOWN", "abc", "5"]
    assert apply(spark, X.decode_sex, ["1", "2.0", "3", "", None, "m"]) == ["male", "female"] + ["UNKNOWN"] * 4


def test_site_label(spark):
    rows = spark.createDataFrame([("Austin", "TX"), ("Austin", None), (" ", "TX"), (None, "nan")], "a string, b string")
    got = [r[0] for r in rows.select(X.site_label(F.col("a"), F.col("b"))).collect()]
    assert got == ["Austin, TX", "Austin", "TX", "UNKNOWN"]


def test_malformed_and_usable(spark):
    values = [None, "", "abcd", "abcde", " abcd ", "unknown", "  UNKNOWN\n", "a b c", "é" * 4, "é" * 5]
    assert apply(spark, X.is_malformed, values) == [True, True, True, False, True, True, True, False, True, False]
    assert apply(spark, X.usable_text, values) == [False, False, True, True, True, False, False, True, True, True]


def test_pii(spark):
    values = ["mail a.b@c.org now", "call 555-123-4567", "+1 (555) 123-4567", "id 1234567890123456789", "x@y", "12345678", None]
    assert apply(spark, X.has_pii, values) == [True, True, True, False, False, True, False]


def test_parse_bool_and_words(spark):
    assert apply(spark, X.parse_bool, ["True", " true ", "False", "1", None]) == [True, True, False, False, False]
    texts = ["a b\tc\n", "", None, "one two three", "   "]
    assert apply(spark, X.word_count, texts) == [3, 0, 0, 3, 0]


def python_norm(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower(), flags=re.UNICODE)).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aB1_ éßñ.-,!\t\n  Ж中", max_size=30), min_size=20, max_size=40))
def test_normalize_text_matches_python(spark, texts):
    assert apply(spark, X.normalize_text, texts) == [python_norm(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="unkowUNKOW \t\n\x1c  ab", max_size=12), min_size=30, max_size=60))
def test_blank_tests_match_python(spark, texts):
    assert apply(spark, X.is_malformed, texts) == [len(t.strip()) < 5 or t.strip().upper() == "UNKNOWN" for t in texts]
    assert apply(spark, X.usable_text, texts) == [t.strip() != "" and t.strip().upper() != "UNKNOWN" for t in texts]


def test_long_blank_runs_stay_linear(spark):
    text = " " * 300_000 + "x" + " " * 300_000 + "y"
    assert apply(spark, X.is_malformed, [text]) == [False]


def test_sif_bands(spark):
    got = apply(spark, lambda p: C.sif_contract(p)["sif_potential"], [0.0, 0.3499999, 0.35, 0.6999, 0.70, 1.0, 1.7, -3.0], "double")
    assert got == ["No", "No", "NEEDS_REVIEW", "NEEDS_REVIEW", "Yes", "Yes", "Yes", "No"]
    reason = apply(spark, C.band_reason, [0.1234, 0.5, 0.9], "double")
    assert reason[0] == "P(Yes)=0.123 below low threshold 0.35 -> No"
    assert reason[2] == "P(Yes)=0.900 at/above high threshold 0.7 -> Yes"


def test_sif_reasons_order(spark):
    rows = spark.sql("""SELECT 0.9D p, array(named_struct('phrase', 'a', 'weight', 0.1D), named_struct('phrase', 'b', 'weight', -0.5D),
      named_struct('phrase', 'c', 'weight', 0.1D), named_struct('phrase', 'd', 'weight', 0.3D)) ph""")
    reasons = rows.select(C.sif_reasons(F.col("p"), F.col("ph"))).first()[0]
    assert reasons[1:] == ["contributing phrase 'b' (toward No, weight=-0.500)",
                           "contributing phrase 'd' (toward Yes, weight=0.300)",
                           "contributing phrase 'a' (toward Yes, weight=0.100)"]


def contract(spark, probs):
    values = ", ".join(f"named_struct('rule', '{r}', 'p', CAST({p} AS DOUBLE))" for r, p in probs)
    return spark.sql(f"SELECT array({values}) probs").select(C.rule_contract(F.col("probs")).alias("c")).first()["c"]


def test_rule_contract_bounds(spark):
    sure = contract(spark, [("A", 0.65), ("B", 0.35)])
    assert (sure["rule_prediction"], sure["needs_review"], sure["review_reason"]) == ("A", False, None)
    exact = contract(spark, [("A", 0.5), ("B", 0.25), ("C", 0.25)])
    assert exact["rule_prediction"] == "A" and exact["runner_up_rule"] == "C"
    weak = contract(spark, [("A", 0.4), ("B", 0.35), ("C", 0.25)])
    assert weak["rule_prediction"] == "NEEDS_REVIEW" and weak["top_rule"] == "A"
    assert weak["review_reason"] == ("top-class confidence 0.400 < threshold 0.50; "
                                     "confidence gap 0.050 < ambiguity margin 0.15 ('A' vs 'B')")
    alone = contract(spark, [("A", 0.9)])
    assert alone["runner_up_rule"] is None and alone["needs_review"] is False


def test_conditional_rule_defaults(spark):
    rows = spark.sql("SELECT 'No' sif, array(named_struct('rule', 'A', 'p', 0.9D)) probs")
    got = rows.select(C.conditional_rule(F.col("sif"), C.rule_contract(F.col("probs"))).alias("c")).first()["c"]
    assert (got["life_saving_rule"], got["rule_confidence"], got["rule_needs_review"], got["rule_model_name"]) == ("N/A", 0.0, False, None)


def test_risk_score_and_levels(spark):
    rows = spark.sql("SELECT 1.0D p, 'Hot Work' rule, 5L n, 10L m UNION ALL SELECT 0.5D, 'N/A', 0L, 10L UNION ALL SELECT 2.0D, 'Driving', 20L, 10L")
    got = [r[0] for r in rows.select(C.risk_score(F.col("p"), F.col("rule"), F.col("n"), F.col("m"))).collect()]
    assert got == [88, 38, 96]  # 60 + 12.5 + 15 is a tie that goes to the even number
    assert apply(spark, C.risk_level, [70, 69, 40, 39], "int") == ["High", "Medium", "Medium", "Low"]
    assert apply(spark, C.precursor_severity, [10, 9, 5, 4], "int") == ["High", "Medium", "Medium", "Low"]


def test_highlight_quotes_phrases(spark):
    rows = spark.sql(r"""SELECT 'A (b) fell. a (B)' t, array(named_struct('phrase', '(b)', 'weight', 1.0D), named_struct('phrase', 'fell', 'weight', -1.0D)) ph""")
    assert rows.select(C.highlight_phrases(F.col("t"), F.col("ph"))).first()[0] == "A <mark>(b)</mark> fell. a <mark>(B)</mark>"


def test_rounding_of_ties(spark):
    from narrascope.functions.numbers import round_even, three_places

    values = [0.39135, 0.28505, 0.00305, 0.14500, 0.0625, 0.1875, 0.1235, 0.0005, 0.9995, 0.7, 0.0, 1.0, 2 / 3, None]
    rows = spark.createDataFrame([(v,) for v in values], "p double").select(
        "p", round_even(F.col("p"), 4).alias("four"), three_places(F.col("p")).alias("three")).collect()
    scaled = lambda p: float(np.rint(p * 1e4) / 1e4)
    assert [(r["four"], r["three"]) for r in rows] == [(None, None) if p is None else (scaled(p), f"{p:.3f}") for p in values]
    # 0.39135 lies below the tie once scaled: its decimal text rounds to 0.3914
    assert rows[0]["four"] == 0.3913
    ties = spark.range(1000).select(((F.col("id") * 2 + 1) / 2000.0).alias("p"))
    assert all(r["t"] == f"{r['p']:.3f}" for r in ties.select("p", three_places(F.col("p")).alias("t")).collect())
