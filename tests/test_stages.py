"""The scoring plan as saved pipeline stages equals the functions, also when loaded elsewhere."""

import re

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bindings import QUERIES, models
from narrascope.plans import models as M
from narrascope.plans.scoring import score_reports
from narrascope.plans.stages import RiskScore, RuleContract, SifContract, Without, scoring_pipeline
from narrascope.schemas import RULES
from narrascope.session import new_scratch, written


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(f"R{i}", f"worker {['fell', 'drove', 'welded'][i % 3]} near {['gate', 'tank'][i % 2]} {i % 7}", f"site {i % 3}", "shift", i % 2, RULES[i % 3])
            for i in range(120)]
    return spark.createDataFrame(rows, "report_id string, narrative_text string, site string, activity string, y int, life_saving_rule string")


@pytest.fixture(scope="module")
def fitted(spark, reports):
    features = M.text_features("narrative_text").fit(reports)
    made = written(features.transform(reports), "features")
    return features, M.train_sif(made), M.train_rule(made)


def shown(df):
    return sorted(map(str, df.select("report_id", "sif_potential", "confidence", "sif_reasons", "sif_model_name", "sif_decision_thresholds", "life_saving_rule",
                                     "rule_confidence", "rule_needs_review", "rule_review_reason", "rule_runner_up", "risk_score", "risk_level", "critical").collect()))


def test_saved_pipeline_scores_raw_texts(spark, reports, fitted):
    features, sif, rule = fitted
    recurrence = new_scratch(spark, "recurrence")
    reports.groupBy("site", "activity", "life_saving_rule").agg(F.count(F.lit(1)).alias("n")).write.parquet(recurrence)
    raw = reports.drop("y", "life_saving_rule")
    path = new_scratch(spark, "pipeline")
    scoring_pipeline(features, sif, rule, recurrence).write().save(path)
    scored = M.positive_probability(sif.transform(features.transform(raw))).drop("probability", "prediction", "rawPrediction")
    plain = score_reports(rule.transform(scored).withColumn("class_probs", M.class_probabilities()), spark.read.parquet(recurrence))
    other = spark.newSession()
    found = PipelineModel.load(path).transform(other.read.parquet(written(raw, "raw").scratch_path))
    assert shown(found) == shown(plain)
    assert not [c for c in found.columns if c.startswith("_")] and "features" not in found.columns


def test_parameters_are_written(spark, reports, fitted):
    path = new_scratch(spark, "pipeline")
    scoring_pipeline(*fitted, low=0.2, high=0.6, confidence=0.9, margin=0.3).write().save(path)
    stages = PipelineModel.load(path).stages
    contract = next(s for s in stages if isinstance(s, SifContract))
    assert (contract.value("low"), contract.value("high")) == (0.2, 0.6)
    assert next(s for s in stages if isinstance(s, RuleContract)).value("confidence") == 0.9
    assert isinstance(stages[-1], Without) and isinstance(stages[-2], RiskScore)
    found = PipelineModel.load(path).transform(reports.drop("life_saving_rule"))
    assert {r.low for r in found.select(F.col("sif_decision_thresholds")["low"].alias("low")).distinct().collect()} == {0.2}


def scored_folder(spark, folder, texts):
    """The scoring query over rows (doc_id, text) and four labels."""
    rows = [(i, text, "en", f"site {n % 2}", 1) for n, (i, text) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in (0, 2, 4, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return QUERIES["scoring_pipeline"](spark, str(folder))


TEXTS = [(i, f"worker {['fell', 'drove', 'welded'][i % 3]} near {['gate', 'tank'][i % 2]} {i % 7}") for i in range(40)]


def test_scoring_query_counts_repeated_and_missing_ids_once(spark, tmp_path):
    made = scored_folder(spark, tmp_path, [*TEXTS, (5, "worker fell"), (None, "drove near tank"), (None, "gate"), (41, None), (42, "")])
    assert [tuple(row) for row in made.collect()] == [(44, 44, 0)]


def exchanged(df):
    """Names of the columns that the exchanges of a plan take in."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", df._jdf.queryExecution().explainString(mode))
    return {name.split("#")[0].strip() for names in found for name in names.split(",")}


def test_scoring_query_moves_and_stores_no_words(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(models, "written", lambda df, label: kept.append(df) or written(df, label))
    monkeypatch.setattr("bindings.views.spread", lambda df, key: df)  # as with more splits than cores
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with more labels than a broadcast holds
    try:
        moved = set().union(*map(exchanged, (scored_folder(spark, tmp_path, TEXTS), *kept)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "doc_id" in moved and not moved & {"text", "narrative_text"}
    assert kept and not [name for df in kept for name in df.columns if name.startswith("_")]


def test_words_are_runs_of_letters_digits_and_underscores(spark):
    text = "".join(chr(c) + ("" if c % 5 else "-") for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)
    rows = spark.createDataFrame([(text,), ("",), (" -- ",), ("_a-b_ \u0130x",)], "t string")
    found = rows.select(F.split(F.lower("t"), M.WORD).alias("a"), F.split(F.lower("t"), r"[^\p{L}\p{N}_]+").alias("b"))
    assert found.filter("a != b").isEmpty()
