"""The scoring plan as pipeline stages: one saved pipeline scores a table of raw texts.

Every stage has parameters that are written with it, so thresholds and names travel with the model. Stages
only add or drop columns; the recurrence table is named by its path and read when rows are scored.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.contracts import conditional_rule, flag_critical, risk_level, risk_score, rule_contract, sif_contract
from narrascope.plans.models import class_probabilities, positive_probability
from narrascope.plans.scoring import RULE_COLUMNS, with_recurrence
from narrascope.schemas import RULE_CONFIDENCE, RULE_MARGIN, RULES, SIF_HIGH, SIF_LOW


class Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose keyword arguments are its parameters."""

    def _put(self, **values) -> None:
        self._setDefault(**self.defaults)
        self._set(**{name: value for name, value in values.items() if value is not None})

    def value(self, name: str):
        return self.getOrDefault(name)


class SifContract(Stage):
    """The three-way decision of a probability of Yes, with reasons, model and thresholds.

    `probability` names a column of numbers, or of vectors whose second entry counts.
    """

    probability = Param(Params._dummy(), "probability", "column with P(Yes)", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "below it the answer is No", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "from it on the answer is Yes", TypeConverters.toFloat)
    modelName = Param(Params._dummy(), "modelName", "shown with the decision", TypeConverters.toString)
    modelVersion = Param(Params._dummy(), "modelVersion", "shown with the decision", TypeConverters.toString)
    defaults = {"probability": "p", "low": SIF_LOW, "high": SIF_HIGH, "modelName": "embedding + logistic regression", "modelVersion": "1.0.0"}

    @keyword_only
    def __init__(self, *, probability=None, low=None, high=None, modelName=None, modelVersion=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.value("probability")
        if dataset.schema[column].dataType.typeName() != "double":
            dataset = positive_probability(dataset, column, "p")
        elif column != "p":
            dataset = dataset.withColumn("p", F.col(column))
        decided = dataset.withColumn("_sif", sif_contract(
            F.col("p"), self.value("low"), self.value("high"), self.value("modelName"), self.value("modelVersion")))
        return decided.withColumns({
            "sif_potential": F.col("_sif.sif_potential"), "confidence": F.col("_sif.confidence"), "sif_reasons": F.array("_sif.band_reason"),
            "sif_model_name": F.col("_sif.model_name"), "sif_model_version": F.col("_sif.model_version"),
            "sif_decision_thresholds": F.col("_sif.thresholds")}).drop("_sif")


class RuleContract(Stage):
    """The rule decision of class probabilities, where the three-way decision is not a No.

    `probability` names an array of (rule, p), or of vectors in the order of the rules.
    """

    probability = Param(Params._dummy(), "probability", "column with class probabilities", TypeConverters.toString)
    confidence = Param(Params._dummy(), "confidence", "below it a rule needs review", TypeConverters.toFloat)
    margin = Param(Params._dummy(), "margin", "a smaller lead needs review", TypeConverters.toFloat)
    rules = Param(Params._dummy(), "rules", "classes of a vector, in order", TypeConverters.toListString)
    modelName = Param(Params._dummy(), "modelName", "shown with the decision", TypeConverters.toString)
    modelVersion = Param(Params._dummy(), "modelVersion", "shown with the decision", TypeConverters.toString)
    defaults = {"probability": "class_probs", "confidence": RULE_CONFIDENCE, "margin": RULE_MARGIN, "rules": list(RULES),
                "modelName": "rule_classifier", "modelVersion": "1.0.0"}

    @keyword_only
    def __init__(self, *, probability=None, confidence=None, margin=None, rules=None, modelName=None, modelVersion=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.value("probability")
        classes = F.col(column) if dataset.schema[column].dataType.typeName() == "array" else class_probabilities(column, tuple(self.value("rules")))
        contract = rule_contract(classes, self.value("confidence"), self.value("margin"), self.value("modelName"), self.value("modelVersion"))
        decided = dataset.withColumn("_rule", conditional_rule(F.col("sif_potential"), contract))
        return decided.withColumns({name: F.col(f"_rule.{name}") for name in RULE_COLUMNS}).drop("_rule")


class RiskScore(Stage):
    """Score, level and critical flag of decided reports; recurrence counts come from a stored table if one is named."""

    recurrence = Param(Params._dummy(), "recurrence", "path of a table (site, activity, life_saving_rule, n); empty: none", TypeConverters.toString)
    rowId = Param(Params._dummy(), "rowId", "column that differs between rows", TypeConverters.toString)
    defaults = {"recurrence": "", "rowId": "report_id"}

    @keyword_only
    def __init__(self, *, recurrence=None, rowId=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        path, score = self.value("recurrence"), risk_score(F.col("p"), F.col("life_saving_rule"))
        if path:
            table = dataset.sparkSession.read.parquet(path)
            dataset = with_recurrence(dataset, table, F.xxhash64(self.value("rowId")))
            score = risk_score(F.col("p"), F.col("life_saving_rule"), F.col("recurrence"), table.agg(F.max("n")).scalar())
        scored = dataset.withColumn("risk_score", score)
        return scored.withColumns({"risk_level": risk_level(F.col("risk_score")),
                                   "critical": flag_critical(F.col("sif_potential"), F.col("risk_score")).cast("int")})


class Without(Stage):
    """Drop columns, such as vectors that only later stages need."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)
    defaults = {"columns": []}

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.value("columns"))


def _renamed(model: LogisticRegressionModel, name: str) -> LogisticRegressionModel:
    """The model with output columns of its own, so that two fit one pipeline."""
    copy = model.copy()
    return copy.setProbabilityCol(f"_{name}_probability").setPredictionCol(f"_{name}_class").setRawPredictionCol(f"_{name}_raw")


def scoring_pipeline(features: PipelineModel, sif: LogisticRegressionModel, rule: LogisticRegressionModel,
                     recurrence: str = "", row_id: str = "report_id", **params) -> PipelineModel:
    """Texts to decisions in one model that can be saved: features, both classifiers, both contracts, risk.

    `params` are those of the stages, as `low`, `high`, `confidence` and `margin`.
    """
    def given(stage: type[Stage], **own) -> Stage:
        return stage(**own, **{k: v for k, v in params.items() if stage.hasParam(stage(), k)})

    made = [stage.getOutputCol() for stage in features.stages]
    hidden = [*made, *[f"_{name}_{kind}" for name in ("sif", "rule") for kind in ("probability", "class", "raw")]]
    return PipelineModel([
        *features.stages, _renamed(sif, "sif"), _renamed(rule, "rule"), given(SifContract, probability="_sif_probability"),
        given(RuleContract, probability="_rule_probability"), RiskScore(recurrence=recurrence, rowId=row_id), Without(columns=hidden)])
