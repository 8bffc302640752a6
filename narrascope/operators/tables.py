"""Keyed table maintenance: upsert, insert-if-absent, latest version, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.skew import small
from narrascope.schemas import SEED_SOURCES, UPSERT_COLUMNS
from narrascope.session import written

# fixed values: what the scoring engine writes to the audit log
ENGINE_NAME = "AI Engine"
CRITICAL_ACTION = "critical_flag_raised"
CRITICAL_REASON = "Auto-flagged for immediate Reviewer alert"


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows that have a key. Rows without one cannot be matched, and grouping would merge them."""
    return rows.filter(F.col(key).isNotNull())


def rejected(rows: DataFrame, key: str) -> DataFrame:
    """The rows that `upsert` and `insert_ignore` leave out for lack of a key, to be counted or kept aside."""
    return rows.filter(F.col(key).isNull())


def latest_per_key(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of every key.

    max_by combines before the shuffle, so many versions of one key do not
    meet in one task.
    """
    names = [name for name in versions.columns if name != key]
    versions = keyed(versions, key)
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("v"))
    return latest.select(key, "v.*").select(*versions.columns)


def upsert(current: DataFrame, new: DataFrame, key: str, order: str | None = None,
           replaced: tuple[str, ...] = UPSERT_COLUMNS) -> DataFrame:
    """Insert new keys; on a known key take the listed columns from the new row.

    Several new rows of one key count as successive submissions: the last one
    by `order` supplies the listed columns, the first one the others. New rows
    without a key are left out (see `rejected`). While the new rows fit a broadcast,
    the rows of the table are not shuffled; beyond it both sides are, by key.
    """
    new = keyed(new, key)
    if order is not None:
        names = [name for name in current.columns if name != key]
        new = new.groupBy(key).agg(
            F.min_by(F.struct(*names), order).alias("_first"),
            F.max_by(F.struct(*names), order).alias("_last"),
        ).select(key, *[F.col("_last" if name in replaced else "_first")[name].alias(name) for name in names])
    # written once: the size check, the broadcast, the list of known keys and the join read it
    fresh = written(new.select(F.col(key).alias("_key"), *[
        F.col(name).alias(f"_new_{name}") for name in current.columns if name != key]), "upload")
    old = current.withColumn("_old", F.lit(True))
    if small(fresh):
        both = old.join(F.broadcast(fresh), F.col(key) == F.col("_key"), "left")
        # keys of the upload that the table has: no more than the upload
        known = current.select(F.col(key).alias("_key")).join(F.broadcast(fresh.select("_key")), "_key", "left_semi").distinct()
        both = both.unionByName(fresh.join(F.broadcast(known), "_key", "left_anti"), allowMissingColumns=True)
    else:
        both = old.join(fresh, F.col(key) == F.col("_key"), "full_outer")

    def merged(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(key), F.col("_key")).alias(key)
        takes_new = F.col("_key").isNotNull() & (
            F.lit(True) if name in replaced else F.col("_old").isNull())
        return F.when(takes_new, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return both.select(*[merged(name) for name in current.columns])


def insert_ignore(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Add rows with unknown keys; the first of several new rows of a key wins."""
    names = [name for name in current.columns if name != key]
    new = keyed(new, key)
    first = new.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("v")).select(key, "v.*")
    return current.unionByName(first.join(current.select(key), key, "left_anti").select(*current.columns))


def seed_reports(seed: DataFrame) -> DataFrame:
    """Seed rows as closed reports; risk levels are compared without regard to case."""
    level = F.initcap(F.lower("risk_level"))
    level = F.when(level.isin("High", "Medium", "Low"), level).otherwise("Low")
    return seed.select(
        "report_id", "report_text", "date", "site", "activity", "report_type", "source",
        "sif_potential", "life_saving_rule", level.alias("risk_level"), F.lit("Closed").alias("status"),
        ((F.col("sif_potential") == "Yes") & (level == "High")).cast("int").alias("critical"))


def critical_audit(scored: DataFrame) -> DataFrame:
    """One audit row for every report that was flagged critical."""
    return scored.filter(F.col("critical") == 1).select(
        F.lit(None).cast("bigint").alias("actor_user_id"), F.lit(ENGINE_NAME).alias("actor_name"),
        F.lit(CRITICAL_ACTION).alias("action"), F.lit("report").alias("target_type"),
        F.col("report_id").alias("target_id"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"),
        F.format_string("sif_potential=Yes risk_score=%d", "risk_score").alias("new_value"),
        F.lit(CRITICAL_REASON).alias("reason"))


def change_audit(changes: DataFrame, action: str, target_type: str, field: str) -> DataFrame:
    """Audit rows for role or status changes (columns target_id, old_value, new_value, ...)."""
    return changes.select(
        "actor_user_id", "actor_name", F.lit(action).alias("action"), F.lit(target_type).alias("target_type"),
        F.col("target_id").cast("string").alias("target_id"), F.lit(field).alias("field"),
        "old_value", "new_value", "reason")


def signup_audit(users: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return users.select(
        F.col("id").alias("actor_user_id"), F.col("name").alias("actor_name"), F.lit("signup").alias("action"),
        F.lit("user").alias("target_type"), F.col("id").cast("string").alias("target_id"),
        nothing.alias("field"), nothing.alias("old_value"), F.lit("role=Reporter").alias("new_value"),
        nothing.alias("reason"))


def is_seed(source: Column) -> Column:
    return source.isin(*SEED_SOURCES)
