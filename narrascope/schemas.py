"""Schemas, sentinels and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: sentinels ------------------------------------------------
UNKNOWN = "UNKNOWN"
UNMAPPED = "Unmapped"
NOT_EVALUATED = "N/A"
NEEDS_REVIEW = "NEEDS_REVIEW"
SCHEMA_VERSION = "1.0.0"

# --- fixed values: decision contracts ---------------------------------------
SIF_LOW = 0.35
SIF_HIGH = 0.70
RULE_CONFIDENCE = 0.50
RULE_MARGIN = 0.15
CRITICAL_RISK = 70
RISK_HIGH = 70
RISK_MEDIUM = 40
RISK_WEIGHTS = {"confidence": 0.60, "recurrence": 0.25, "severity": 0.15}
DEFAULT_SEVERITY = 0.5

# --- fixed values: the nine rules and their severity weights ----------------
RULE_SEVERITY = {
    "Bypassing Safety Controls": 0.7,
    "Confined Space": 1.0,
    "Driving": 0.7,
    "Energy Isolation": 1.0,
    "Hot Work": 1.0,
    "Line of Fire": 1.0,
    "Safe Mechanical Lifting": 0.85,
    "Work Authorisation": 0.7,
    "Working at Height": 0.85,
}
RULES = tuple(RULE_SEVERITY)

# --- fixed values: domains --------------------------------------------------
SEED_SOURCES = ("real_ihm_stefanini", "synthetic")
ROLES = ("Reporter", "Supervisor", "HSE", "Admin")
USER_STATUSES = ("active", "disabled")
REPORT_STATUSES = ("Submitted", "Reviewed", "Investigation", "Action Assigned", "Closed")
UNDER_REVIEW = ("Submitted", "Reviewed", "Investigation")
NO_RULE = ("Unmapped", "None", "N/A", "")
EVIDENCE_FIELDS = ("unsafe_act", "unsafe_condition", "barrier", "potential_consequence")

# --- fixed values: evaluation grid ------------------------------------------
THRESHOLD_STEPS = (5, 95)  # hundredths
PRECISION_FLOOR = 0.50
RECALL_TARGET = 0.85
SPLIT_SHARE = 0.15
CALIBRATION_BINS = 10

# --- fixed values: the 29 master columns, in order --------------------------
MASTER_COLUMNS = (
    "record_id", "source_organization", "source_dataset", "source_url",
    "source_record_id", "source_type", "is_synthetic", "date", "site",
    "industry_domain", "report_type", "activity", "narrative_text", "hazard",
    "unsafe_act", "unsafe_condition", "barrier", "barrier_status",
    "potential_consequence", "actual_outcome", "sif_potential", "sif_reason",
    "life_saving_rule", "injury_severity_actual", "age", "sex", "naics_code",
    "ingestion_date", "schema_version",
)

MASTER = T.StructType([
    T.StructField(name, T.BooleanType() if name == "is_synthetic" else T.StringType(), False)
    for name in MASTER_COLUMNS
])


def strings(*names: str) -> T.StructType:
    """A struct of nullable strings, for CSV sources."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


MANIFEST_COLUMNS = (
    "category", "dataset_name", "local_path", "source_organization", "source_url",
    "license", "row_count", "source_record_id_field", "source_type_value",
    "narrative_text_column", "notes",
)
MANIFEST = strings(*MANIFEST_COLUMNS)

SEED_COLUMNS = (
    "report_id", "date", "site", "activity", "report_type", "report_text",
    "sif_potential", "life_saving_rule", "hazard", "barrier", "barrier_status",
    "risk_level", "source",
)
SEED = strings(*SEED_COLUMNS)

TAXONOMY_JSON = T.StructType([
    T.StructField("life_saving_rules", T.ArrayType(T.StructType([
        T.StructField("rule", T.StringType()),
        T.StructField("barriers", T.ArrayType(T.StringType())),
        T.StructField("typical_hazards", T.ArrayType(T.StringType())),
    ]))),
])

VOCABULARY = T.StructType([
    T.StructField("field", T.StringType(), False),
    T.StructField("category_order", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("phrase_order", T.IntegerType(), False),
    T.StructField("phrase", T.StringType(), False),
])

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("site", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

REPORTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("report_id", T.StringType(), False),
    T.StructField("report_text", T.StringType(), False),
    T.StructField("date", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("activity", T.StringType()),
    T.StructField("report_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("sif_potential", T.StringType()),
    T.StructField("life_saving_rule", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("rule_confidence", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("top_phrases", T.StringType()),
    T.StructField("analyzed_at", T.TimestampType()),
    T.StructField("reporter_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("critical", T.IntegerType()),
    T.StructField("sif_reasons", T.StringType()),
    T.StructField("sif_model_name", T.StringType()),
    T.StructField("sif_model_version", T.StringType()),
    T.StructField("sif_decision_thresholds", T.StringType()),
    T.StructField("sif_prediction_timestamp", T.StringType()),
    T.StructField("rule_needs_review", T.IntegerType()),
    T.StructField("rule_review_reason", T.StringType()),
    T.StructField("rule_runner_up", T.StringType()),
    T.StructField("rule_runner_up_confidence", T.DoubleType()),
    T.StructField("rule_model_name", T.StringType()),
    T.StructField("rule_model_version", T.StringType()),
    T.StructField("rule_prediction_timestamp", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# columns replaced when a report id is submitted again; the rest keep the old value
UPSERT_COLUMNS = (
    "report_text", "site", "activity", "sif_potential", "life_saving_rule",
    "confidence", "risk_score", "rule_confidence", "risk_level", "top_phrases",
    "analyzed_at", "status", "critical",
)

AUDIT_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("actor_user_id", T.LongType()),
    T.StructField("actor_name", T.StringType()),
    T.StructField("action", T.StringType(), False),
    T.StructField("target_type", T.StringType(), False),
    T.StructField("target_id", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
