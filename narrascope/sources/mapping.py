"""Source mappers: one declarative select per source into the 29 master columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.text import (
    decode_sex, integer_text, make_record_id, site_label, strip, strip_html, unknown_if_blank,
)
from narrascope.operators.identity import dedupe_ids, fallback_ids, row_index_ids
from narrascope.operators.skew import lookup_join
from narrascope.schemas import MASTER_COLUMNS, SCHEMA_VERSION, UNKNOWN
from narrascope.session import local_table
from narrascope.sources.files import POSITION
from narrascope.sources.term_maps import RISK_OF_LEVEL, SERIOUS_LEVELS

@dataclass(frozen=True)
class Provenance:
    """What the manifest says about a source."""

    dataset: str
    organization: str | None = None
    url: str | None = None
    source_type: str | None = None


def field(df: DataFrame, name: str) -> Column:
    """A source column, or null where the file lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def to_master(df: DataFrame, provenance: Provenance, record: Column, spec: Mapping[str, Column],
              ingestion_date: str) -> DataFrame:
    """The 29 columns in order; what the source does not map is UNKNOWN."""
    given: dict[str, Column] = {
        "record_id": make_record_id(F.lit(provenance.dataset), record),
        "source_organization": unknown_if_blank(F.lit(provenance.organization)),
        "source_dataset": F.lit(provenance.dataset),
        "source_url": unknown_if_blank(F.lit(provenance.url)),
        "source_record_id": record,
        "source_type": unknown_if_blank(F.lit(provenance.source_type)),
        "is_synthetic": F.lit(False),
        "ingestion_date": F.lit(ingestion_date),
        "schema_version": F.lit(SCHEMA_VERSION),
        **spec,
    }
    return df.select(*[given.get(name, F.lit(UNKNOWN)).alias(name) for name in MASTER_COLUMNS])


def map_seed(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Labelled seed reports; labels pass through."""
    def text(name: str) -> Column:
        return unknown_if_blank(field(df, name))

    passed = ("date", "site", "report_type", "activity", "hazard", "barrier", "barrier_status",
              "sif_potential", "life_saving_rule")
    return to_master(df, provenance, text("report_id"), {
        **{name: text(name) for name in passed},
        "narrative_text": text("report_text"),
        "industry_domain": F.lit("oil_and_gas"),
        "is_synthetic": F.coalesce(F.startswith(strip(field(df, "source")), F.lit("synthetic")), F.lit(False)),
    }, ingestion_date)


def map_severe_injury(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Severe injury reports; ids repeat within the source and are told apart by suffix."""
    source = df.withColumns({"_ds": F.lit(provenance.dataset), "_raw": integer_text(field(df, "ID"))})
    named = dedupe_ids(source, "_ds", "_raw", POSITION, "_rid")
    nature = unknown_if_blank(field(df, "NatureTitle"))
    return to_master(named, provenance, F.col("_rid"), {
        "date": unknown_if_blank(field(df, "EventDate")),
        "site": site_label(field(df, "City"), field(df, "State")),
        "industry_domain": F.lit("general_industrial"),
        "report_type": F.lit("severe_injury_report"),
        "narrative_text": unknown_if_blank(field(df, "Final Narrative")),
        "hazard": unknown_if_blank(field(df, "SourceTitle")),
        "actual_outcome": nature,
        "injury_severity_actual": nature,
        "naics_code": unknown_if_blank(field(df, "Primary NAICS")),
    }, ingestion_date)


def map_abstracts(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Construction accident abstracts."""
    source = df.withColumns({"_ds": F.lit(provenance.dataset), "_raw": integer_text(field(df, "summary_nr"))})
    named = dedupe_ids(source, "_ds", "_raw", POSITION, "_rid")
    return to_master(named, provenance, F.col("_rid"), {
        "date": unknown_if_blank(field(df, "Event Date")),
        "industry_domain": F.lit("construction"),
        "report_type": F.lit("hse_abstract"),
        "activity": unknown_if_blank(field(df, "Task Assigned")),
        "narrative_text": unknown_if_blank(field(df, "Abstract Text")),
        "hazard": unknown_if_blank(field(df, "Environmental Factor")),
        "actual_outcome": unknown_if_blank(field(df, "Nature of Injury")),
        "injury_severity_actual": unknown_if_blank(field(df, "Degree of Injury")),
    }, ingestion_date)


def map_industrial(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Industrial accident database; the record id is the row index."""
    named = row_index_ids(df.withColumn("_ds", F.lit(provenance.dataset)), "_ds", POSITION, "_rid")
    return to_master(named, provenance, F.col("_rid"), {
        "date": unknown_if_blank(field(df, "Data")),
        "site": site_label(field(df, "Local"), field(df, "Countries")),
        "industry_domain": unknown_if_blank(field(df, "Industry Sector")),
        "report_type": F.lit("accident_report"),
        "narrative_text": unknown_if_blank(field(df, "Description")),
        "hazard": unknown_if_blank(field(df, "Critical Risk")),
        "injury_severity_actual": unknown_if_blank(field(df, "Accident Level")),
        "sex": unknown_if_blank(field(df, "Genre")),
    }, ingestion_date)


def map_injury_narratives(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Coded injury narratives; the record id is the row index."""
    named = row_index_ids(df.withColumn("_ds", F.lit(provenance.dataset)), "_ds", POSITION, "_rid")
    return to_master(named, provenance, F.col("_rid"), {
        "industry_domain": F.lit("general_industrial"),
        "report_type": F.lit("injury_narrative"),
        "narrative_text": unknown_if_blank(field(df, "text")),
        "age": integer_text(field(df, "age")),
        "sex": decode_sex(field(df, "sex")),
    }, ingestion_date)


def map_hazmat(df: DataFrame, provenance: Provenance, ingestion_date: str) -> DataFrame:
    """Hazardous material incidents: report numbers wrapped in HTML, missing or repeated."""
    number = strip_html(field(df, "Report Number"))
    made = fallback_ids(df, F.nullif(number, F.lit(UNKNOWN)), POSITION, "_raw")
    named = dedupe_ids(made.withColumn("_ds", F.lit(provenance.dataset)), "_ds", "_raw", POSITION, "_rid")
    return to_master(named, provenance, F.col("_rid"), {
        "source_type": F.lit("real_phmsa_hazmat"),
        "date": unknown_if_blank(field(df, "Date Of Incident")),
        "site": site_label(field(df, "Incident City"), field(df, "Incident State")),
        "industry_domain": F.lit("hazmat_transportation"),
        "report_type": F.lit("hazmat_incident_report"),
        "activity": unknown_if_blank(field(df, "Mode Of Transportation")),
        "narrative_text": unknown_if_blank(field(df, "Description Of Events")),
        "hazard": unknown_if_blank(field(df, "Commodity Short Name")),
    }, ingestion_date)


Mapper = Callable[[DataFrame, Provenance, str], DataFrame]

MAPPERS: dict[str, Mapper] = {
    "seed": map_seed,
    "severe_injury": map_severe_injury,
    "abstracts": map_abstracts,
    "industrial": map_industrial,
    "injury_narratives": map_injury_narratives,
    "hazmat": map_hazmat,
}


def real_to_seed(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Industrial accident rows in the seed layout (without ids).

    `rules` is the (critical_risk, rule) table; rows without a description are
    left out. Absent columns read as their defaults.
    """
    text = strip(field(df, "Description"))
    level = F.coalesce(strip(field(df, "Potential Accident Level")), F.lit(""))
    risk = F.coalesce(strip(field(df, "Critical Risk")), F.lit(""))
    graded = F.lit("LOW")
    for name, value in RISK_OF_LEVEL.items():
        graded = F.when(level == name, value).otherwise(graded)
    kept = df.withColumn("_risk", risk).filter(F.coalesce(text, F.lit("")) != "")
    joined = lookup_join(kept, rules.withColumnsRenamed({"critical_risk": "_risk", "rule": "_rule"}),
                         ["_risk"], F.xxhash64(*kept.columns))
    return joined.select(
        F.split_part(F.coalesce(field(df, "Data"), F.lit("")), F.lit(" "), F.lit(1)).alias("date"),
        F.concat(F.lit("Real-"), F.coalesce(field(df, "Local"), F.lit("Unknown"))).alias("site"),
        F.coalesce(field(df, "Industry Sector"), F.lit("Unknown")).alias("activity"),
        F.lit("Incident").alias("report_type"),
        text.alias("report_text"),
        F.when(level.isin(*SERIOUS_LEVELS), "Yes").otherwise("No").alias("sif_potential"),
        F.coalesce("_rule", F.lit("Unmapped")).alias("life_saving_rule"),
        F.when(F.col("_risk") != "", F.col("_risk")).otherwise("Unspecified").alias("hazard"),
        F.lit("Unknown (not recorded in source)").alias("barrier"),
        F.lit("Unknown").alias("barrier_status"),
        graded.alias("risk_level"),
        F.lit("real_ihm_stefanini").alias("source"),
        *[F.col(POSITION)] if POSITION in df.columns else [],
    )


def rule_table(spark, terms: Mapping[str, str], key: str = "critical_risk", value: str = "rule") -> DataFrame:
    """A fixed term table as a DataFrame."""
    return local_table(spark, list(terms.items()), f"{key} string, {value} string")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Mapped sources one after another, in the master column order."""
    first, *others = [part.select(*MASTER_COLUMNS) for part in parts]
    for part in others:
        first = first.unionByName(part)
    return first
