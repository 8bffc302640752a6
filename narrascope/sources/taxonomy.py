"""The rule taxonomy and legacy vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.functions.text import matches, normalize_code, strip, strip_html, whole_number
from narrascope.operators.skew import lookup_join
from narrascope.schemas import NOT_EVALUATED, TAXONOMY_JSON, UNMAPPED
from narrascope.session import local_table
from narrascope.sources import term_maps


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ /]", "_")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a taxonomy document, with ids and joined examples."""
    rules = spark.read.schema(TAXONOMY_JSON).json(path, multiLine=True).select(
        F.explode("life_saving_rules").alias("r"))

    def joined(name: str) -> Column:
        return F.array_join(F.coalesce(F.col(f"r.{name}"), F.array().cast("array<string>")), "; ")

    return rules.select(
        slug(F.col("r.rule")).alias("rule_id"), F.col("r.rule").alias("rule_name"),
        F.concat(F.lit("IOGP Life-Saving Rule: "), F.col("r.rule")).alias("description"),
        joined("typical_hazards").alias("hazard_examples"), joined("barriers").alias("barrier_examples"))


def taxonomy_lookup(reports: DataFrame, taxonomy: DataFrame, rule: str = "life_saving_rule") -> DataFrame:
    """Comma-joined hazards and barriers of each report's rule, N/A without one.

    `taxonomy` has rule, typical_hazards and barriers (arrays); it has one row
    per rule and is broadcast within a checked size.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(name, ", "), F.lit("")), F.lit(NOT_EVALUATED))

    table = taxonomy.select(
        F.col("rule").alias(rule), shown("typical_hazards").alias("typical_hazard"),
        shown("barriers").alias("typical_barrier"))
    joined = lookup_join(reports, table, [rule], F.xxhash64(*reports.columns))
    return joined.na.fill(NOT_EVALUATED, ["typical_hazard", "typical_barrier"])


def taxonomy_diff(expected: DataFrame, actual: DataFrame, name: str = "rule") -> DataFrame:
    """Names on one side only, with the side they are on."""
    left, right = expected.select(name).distinct(), actual.select(name).distinct()
    extra = left.join(right, name, "left_anti").withColumn("side", F.lit("expected_only"))
    missing = right.join(left, name, "left_anti").withColumn("side", F.lit("actual_only"))
    return extra.unionByName(missing)


def require_taxonomy(expected: DataFrame, actual: DataFrame, name: str = "rule") -> None:
    wrong = taxonomy_diff(expected, actual, name).take(20)
    if wrong:
        raise ValueError("taxonomy differs: " + ", ".join(f"{row[name]} ({row['side']})" for row in wrong))


def distinct_terms(df: DataFrame, dataset: Column, columns: list[str], html: bool = False) -> DataFrame:
    """Distinct non-blank values of several columns, whole numbers without fraction.

    One scan and one grouping cover all columns.
    """
    raw = df.select(*[F.col(f"`{name}`").cast("string").alias(name) for name in columns]).unpivot(
        [], [F.col(f"`{name}`") for name in columns], "column_name", "raw")
    clean = (strip_html if html else strip)(F.col("raw"))
    kept = raw.filter(F.col("raw").isNotNull() & ~matches(F.col("raw"), "(?i:nan)?"))
    return kept.select(
        dataset.alias("source_dataset"), "column_name", normalize_code(clean).alias("source_term")).distinct()


def map_terms(terms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Terms with their rule, confidence and a note.

    `mapping` is (source_dataset, column_name, term, rule_id): a term matches as
    text first, else in its integer form.
    """
    keys = ["source_dataset", "column_name"]
    whole = whole_number(F.col("source_term"))
    spread = F.xxhash64("source_dataset", "column_name", "source_term")

    def table(key: str, value: str) -> DataFrame:
        return mapping.select(*keys, F.col("term").alias(key), F.col("rule_id").alias(value))

    by_text = lookup_join(terms, table("source_term", "_text_rule"), [*keys, "source_term"], spread)
    by_both = lookup_join(by_text.withColumn("_whole", whole), table("_whole", "_whole_rule"),
                          [*keys, "_whole"], spread)
    rule = F.coalesce("_text_rule", "_whole_rule", F.lit(UNMAPPED))
    note = F.concat(F.lit("No confident IOGP rule match for '"), F.col("source_term"), F.lit("' in "),
                    F.col("column_name"))
    return by_both.select(
        *keys, "source_term", rule.alias("mapped_rule_id"),
        F.when(rule == UNMAPPED, "n/a").otherwise("high").alias("mapping_confidence"),
        F.when(rule == UNMAPPED, note).otherwise("").alias("notes"))


def mapping_rate(mapped: DataFrame) -> DataFrame:
    """Mapped and total terms per dataset and over all (dataset null)."""
    is_mapped = F.col("mapped_rule_id") != UNMAPPED
    counts = mapped.rollup("source_dataset").agg(
        F.count(F.lit(1)).alias("terms"), F.count_if(is_mapped).alias("mapped"))
    return counts.withColumn("pct", round_even(100.0 * F.col("mapped") / F.col("terms"), 1))


def map_critical_risk(df: DataFrame, mapping: DataFrame, risk: str) -> DataFrame:
    """Left lookup of a critical-risk category (critical_risk, rule); Unmapped by default."""
    joined = lookup_join(df, mapping.withColumnsRenamed({"critical_risk": risk, "rule": "mapped_rule"}),
                         [risk], F.xxhash64(*df.columns))
    return joined.na.fill(UNMAPPED, ["mapped_rule"])


def known_terms(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """The fixed term table; `datasets` names the dataset of each known source."""
    columns = {
        "industrial": [("Critical Risk", term_maps.CRITICAL_RISK)],
        "severe_injury": [("Event", term_maps.SEVERE_INJURY_EVENTS)],
        "abstracts": [("Event type", term_maps.ABSTRACT_EVENT_TYPES),
                      ("Human Factor", term_maps.ABSTRACT_HUMAN_FACTORS),
                      ("Environmental Factor", term_maps.ABSTRACT_ENVIRONMENT)],
        "hazmat": [("Failure Cause Description", term_maps.FAILURE_CAUSES)],
        "injury_narratives": [("event", term_maps.NARRATIVE_EVENTS)],
    }
    rows = [(datasets[source], column, term, rule)
            for source, tables in columns.items() if source in datasets
            for column, terms in tables for term, rule in terms.items()]
    return local_table(spark, rows, "source_dataset string, column_name string, term string, rule_id string")
