"""Scoring of reports: probabilities to decisions, risk, flags and taxonomy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.contracts import (
    conditional_rule, flag_critical, phrase_reasons, risk_level, risk_score, rule_contract, sif_contract,
)
from narrascope.functions.text import known, strip
from narrascope.operators.reporting import bulk_summary
from narrascope.operators.skew import left_lookup, lookup_join, small
from narrascope.operators.tables import upsert
from narrascope.session import written
from narrascope.sources.taxonomy import taxonomy_lookup

RULE_COLUMNS = (
    "life_saving_rule", "rule_confidence", "rule_needs_review", "rule_review_reason",
    "rule_runner_up", "rule_runner_up_confidence", "rule_model_name", "rule_model_version",
)
# fixed values: what a submission gets when a field is missing
SUBMISSION_DEFAULTS = {
    "site": "Unknown", "activity": "Unknown", "report_type": "Manual", "source": "api",
    "sif_potential": "No", "life_saving_rule": "N/A", "risk_level": "Low", "status": "Submitted",
}
BULK_DEFAULTS = {"site": "Unknown", "activity": "Unknown", "report_type": "Bulk"}
NUMBER_DEFAULTS = {"confidence": 0.0, "risk_score": 0, "rule_confidence": 0.0}
KEY = ["site", "activity", "life_saving_rule"]


@dataclass(frozen=True)
class Recurrence:
    """A recurrence table that is looked up many times: its size and its largest count are found once."""

    table: DataFrame
    largest: int | None
    fits: bool

    @classmethod
    def of(cls, table: DataFrame) -> Recurrence:
        return cls(table, table.agg(F.max("n")).first()[0], small(table))


def with_recurrence(df: DataFrame, recurrence: DataFrame | Recurrence, spread: Column) -> DataFrame:
    """Count of past reports with the same site, activity and rule, 0 by default."""
    known = isinstance(recurrence, Recurrence)
    table = (recurrence.table if known else recurrence).select(*KEY, F.col("n").alias("recurrence"))
    if known and recurrence.fits:
        joined = df.join(F.broadcast(table), KEY, "left")
    elif known:
        joined = left_lookup(df, table, KEY, spread)
    else:
        joined = lookup_join(df, table, KEY, spread)
    return joined.na.fill(0, ["recurrence"])


def score_reports(df: DataFrame, recurrence: DataFrame | Recurrence | None = None, taxonomy: DataFrame | None = None,
                  p: str = "p", probs: str = "class_probs", row_id: str = "report_id",
                  phrases: str | None = None) -> DataFrame:
    """Decisions for rows that carry P(Yes) and class probabilities.

    Without a recurrence table that part of the score is zero. `phrases` names
    a column array<struct<phrase, weight>> whose top entries join the reasons.
    Lookups are broadcast within a checked size, so nothing here shuffles the
    reports.
    """
    reasons = F.array("_sif.band_reason")
    if phrases is not None:
        shown = F.coalesce(phrase_reasons(F.col(phrases)), F.array().cast("array<string>"))
        reasons = F.concat(reasons, shown)
    decided = df.withColumn("_sif", sif_contract(F.col(p)))
    decided = decided.withColumn("_rule", conditional_rule(
        F.col("_sif.sif_potential"), rule_contract(F.col(probs))))
    decided = decided.withColumns({
        "sif_potential": F.col("_sif.sif_potential"), "confidence": F.col("_sif.confidence"),
        "sif_reasons": reasons, "sif_model_name": F.col("_sif.model_name"),
        "sif_model_version": F.col("_sif.model_version"), "sif_decision_thresholds": F.col("_sif.thresholds"),
        **{name: F.col(f"_rule.{name}") for name in RULE_COLUMNS}}).drop("_sif", "_rule")
    if recurrence is None:
        score = risk_score(F.col(p), F.col("life_saving_rule"))
    else:
        decided = with_recurrence(decided, recurrence, F.xxhash64(row_id))
        largest = F.lit(recurrence.largest).cast("bigint") if isinstance(recurrence, Recurrence) else recurrence.agg(F.max("n")).scalar()
        score = risk_score(F.col(p), F.col("life_saving_rule"), F.col("recurrence"), largest)
    scored = decided.withColumn("risk_score", score)
    scored = scored.withColumns({
        "risk_level": risk_level(F.col("risk_score")),
        "critical": flag_critical(F.col("sif_potential"), F.col("risk_score")).cast("int")})
    return scored if taxonomy is None else taxonomy_lookup(scored, taxonomy)


def draft_id(submitted_at: Column) -> Column:
    return F.concat(F.lit("DRAFT-"), F.date_format(submitted_at, "yyyyMMddHHmmssSSSSSS"))


def submission_defaults(df: DataFrame, submitted_at: Column, position: str) -> DataFrame:
    """Complete submitted rows: ids, defaults and JSON text columns for the store.

    A draft id is the time and the unique `position` column (the readers number rows on request), so that rows of
    one batch get different ids even if they agree in everything else.
    """
    draft = F.concat_ws("-", draft_id(submitted_at), F.col(position).cast("string"))
    defaults = {**SUBMISSION_DEFAULTS, **NUMBER_DEFAULTS}
    filled = df.na.fill({name: value for name, value in defaults.items() if name in df.columns})
    made = {
        "report_id": F.coalesce(F.nullif(F.col("report_id"), F.lit("")), draft),
        "date": F.coalesce(F.col("date"), F.date_format(submitted_at, "yyyy-MM-dd")),
        "top_phrases": F.coalesce(F.to_json("top_phrases"), F.lit("[]")),
        "sif_reasons": F.to_json("sif_reasons"),
        "sif_decision_thresholds": F.to_json("sif_decision_thresholds"),
        "analyzed_at": submitted_at,
    }
    return filled.withColumns({name: value for name, value in made.items()
                               if name in df.columns or name in ("report_id", "date", "analyzed_at")})


def prepare_upload(df: DataFrame, submitted_at: Column | None = None, position: str | None = None) -> DataFrame:
    """Uploaded rows with defaults for missing fields; rows without text are skipped.

    Rows without an id get a draft id; the unique `position` column keeps the
    drafts of one upload apart.
    """
    if "report_text" not in df.columns:
        raise ValueError("an upload must have a report_text column")
    for name, default in BULK_DEFAULTS.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(value.cast("string"), F.lit(default)))
    if position is not None:
        given = F.col("report_id").cast("string") if "report_id" in df.columns else F.lit(None).cast("string")
        draft = F.concat_ws("-", draft_id(submitted_at), F.col(position).cast("string"))
        df = df.withColumn("report_id", F.coalesce(known(given), draft))
    return df.filter(F.coalesce(strip(F.col("report_text")), F.lit("")) != "").withColumns({
        "source": F.lit("bulk_upload"), "status": F.lit("Submitted")})


def upload_summary(uploaded: DataFrame, recurrence: DataFrame | None = None) -> DataFrame:
    """Processed, flagged and other counts of an upload that carries probabilities."""
    return bulk_summary(score_reports(prepare_upload(uploaded), recurrence))


def bulk_upload(current: DataFrame, uploaded: DataFrame, submitted_at: Column, position: str,
                recurrence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Score an upload and upsert it: the new report table and the three counts.

    The scored rows are written once, since both results read them.
    """
    scored = written(score_reports(prepare_upload(uploaded, submitted_at, position), recurrence), "upload")
    missing = {field.name: F.lit(None).cast(field.dataType) for field in current.schema
               if field.name not in scored.columns}
    rows = scored.withColumns(missing).withColumn("critical", F.col("critical").cast("int"))
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in current.schema], position)
    return upsert(current, typed, "report_id", position), bulk_summary(scored)
