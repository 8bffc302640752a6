"""Reporting over submitted reports, users and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.operators.ordering import grouped_previous
from narrascope.schemas import (
    NO_RULE, REPORT_STATUSES, ROLES, SEED_SOURCES, UNDER_REVIEW, USER_STATUSES,
)

LISTED_USER_COLUMNS = ("id", "name", "email", "role", "site", "status", "created_at")
TILES = 12


def _yes(sif: str = "sif_potential") -> Column:
    return F.col(sif) == "Yes"


def _density(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_even(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def exclude_seed(reports: DataFrame) -> DataFrame:
    """Reports submitted by people; rows without a source are left out, as in SQL."""
    return reports.filter(~F.col("source").isin(*SEED_SOURCES))


def filter_reports(reports: DataFrame, site: str | None = None, activity: str | None = None,
                   sif_potential: str | None = None, life_saving_rule: str | None = None,
                   reporter_id: int | None = None) -> DataFrame:
    """All given predicates at once; an empty or missing one does not filter."""
    wanted = {"site": site, "activity": activity, "sif_potential": sif_potential,
              "life_saving_rule": life_saving_rule}
    result = exclude_seed(reports)
    for name, value in wanted.items():
        if value:
            result = result.filter(F.col(name) == value)
    if reporter_id is not None:
        result = result.filter(F.col("reporter_id") == reporter_id)
    return result


def inbox_order(critical_first: bool = True) -> list[Column]:
    newest = F.desc("id")
    if not critical_first:
        return [newest]
    return [F.desc("critical"), F.desc(F.col("status") != "Closed"), newest]


def scope_by_role(reports: DataFrame, role: str, user_id: int) -> DataFrame:
    """Reporters see their own rows; the other roles see all."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    return filter_reports(reports, reporter_id=user_id if role == "Reporter" else None)


def inbox_page(reports: DataFrame, page: int = 1, per_page: int = 25, critical_first: bool = True) -> DataFrame:
    """One page of the inbox, each row with the total and the number of pages.

    Offset paging keeps offset + limit rows per task; use `inbox_after` deep
    in a large inbox.
    """
    total = reports.agg(F.count(F.lit(1))).scalar()
    rows = reports.orderBy(*inbox_order(critical_first)).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumns({
        "total": total, "pages": F.floor((total + per_page - 1) / F.lit(per_page)).cast("bigint")})


def inbox_after(reports: DataFrame, critical: int, is_open: bool, last_id: int, per_page: int = 25) -> DataFrame:
    """The page after a known row: a filter and a top-k, whatever the depth. The filter compares columns
    with values, so a store clustered by them skips what lies before."""
    closed = F.col("status") == "Closed"
    earlier = F.col("id") < last_id
    later_here = closed | (~closed & earlier) if is_open else closed & earlier
    later = (F.col("critical") < critical) | ((F.col("critical") == critical) & later_here)
    return reports.filter(later).orderBy(*inbox_order()).limit(per_page)


def dashboard_totals(reports: DataFrame) -> DataFrame:
    """Totals of the dashboard in one pass; NEEDS_REVIEW is also shown on its own."""
    totals = exclude_seed(reports).agg(
        F.count(F.lit(1)).alias("total_reports"), F.count_if(_yes()).alias("sif_yes"),
        F.count_if(F.col("sif_potential") == "NEEDS_REVIEW").alias("sif_needs_review"),
        F.count_if((F.col("critical") == 1) & (F.col("status") != "Closed")).alias("critical_open"))
    return totals.withColumns({
        "sif_no": F.col("total_reports") - F.col("sif_yes"),
        "sif_density": _density(F.col("sif_yes"), F.col("total_reports"))})


def shown_status(status: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("Submitted"))


def by_status(reports: DataFrame) -> DataFrame:
    return exclude_seed(reports).groupBy(shown_status(F.col("status")).alias("status")).agg(
        F.count(F.lit(1)).alias("cnt"))


def by_rule(reports: DataFrame) -> DataFrame:
    return (exclude_seed(reports).filter(_yes()).groupBy("life_saving_rule")
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "life_saving_rule"))


def density_by(reports: DataFrame, key: str) -> DataFrame:
    """Total, Yes count and density per site, activity or other key."""
    return (exclude_seed(reports).groupBy(key)
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(_yes()).alias("sif_count"))
            .withColumn("density", _density(F.col("sif_count"), F.col("total")))
            .orderBy(F.desc("sif_count"), key))


def precursor_counts(reports: DataFrame) -> DataFrame:
    """(site, activity, rule) combinations of Yes reports with a real rule."""
    real = ~F.col("life_saving_rule").isin(*NO_RULE)
    return (exclude_seed(reports).filter(_yes() & real)
            .groupBy("site", "activity", "life_saving_rule").agg(F.count(F.lit(1)).alias("cnt")))


def top_precursors(reports: DataFrame, at_least: int = 2, top: int = 5) -> DataFrame:
    """The recurring combinations; ties are broken by the key, so results repeat."""
    return (precursor_counts(reports).filter(F.col("cnt") >= at_least)
            .orderBy(F.desc("cnt"), "site", "activity", "life_saving_rule").limit(top))


def reporter_stats(reports: DataFrame) -> DataFrame:
    """Own-report counts of every reporter at once."""
    return reports.groupBy("reporter_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(shown_status(F.col("status")).isin(*UNDER_REVIEW)).alias("under_review"),
        F.count_if(F.col("status") == "Action Assigned").alias("action_in_progress"),
        F.count_if(F.col("status") == "Closed").alias("closed"))


def my_stats(reports: DataFrame, reporter_id: int) -> DataFrame:
    return reporter_stats(reports.filter(F.col("reporter_id") == reporter_id))


def queue_kpis(reports: DataFrame) -> DataFrame:
    status = shown_status(F.col("status"))
    return exclude_seed(reports).agg(
        F.count_if(status == "Submitted").alias("new_reports"),
        F.count_if(status.isin("Submitted", "Reviewed")).alias("awaiting_review"),
        F.count_if((F.col("critical") == 1) & (F.col("status") != "Closed")).alias("critical_open"))


def recurrence_table(reports: DataFrame, counted: Column | None = None) -> DataFrame:
    """Rows per (site, activity, rule) and the largest such count.

    By default only synthetic rows are counted; pass another predicate to
    count real history.
    """
    counted = F.col("source") == "synthetic" if counted is None else counted
    counts = reports.filter(counted).groupBy("site", "activity", "life_saving_rule").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("max_n", counts.agg(F.max("n")).scalar())


def my_recent(reports: DataFrame, reporter_id: int, top: int = 5) -> DataFrame:
    return reports.filter(F.col("reporter_id") == reporter_id).orderBy(F.desc("id")).limit(top)


def recent_per_reporter(reports: DataFrame, top: int = 5) -> DataFrame:
    """The newest rows of every reporter.

    The rank filter becomes a group limit before the shuffle, so a reporter
    sends at most `top` rows per task.
    """
    newest = W.partitionBy("reporter_id").orderBy(F.desc("id"))
    return reports.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= top)


def audit_filter(audit: DataFrame, target_type: str | None = None, target_id: str | None = None) -> DataFrame:
    if target_type:
        audit = audit.filter(F.col("target_type") == target_type)
    if target_id:
        audit = audit.filter(F.col("target_id") == str(target_id))
    return audit


def audit_latest(audit: DataFrame, target_type: str | None = None, target_id: str | None = None,
                 top: int = 100) -> DataFrame:
    return audit_filter(audit, target_type, target_id).orderBy(F.desc("id")).limit(top)


def status_history(audit: DataFrame, value: str = "new_value") -> DataFrame:
    """Old and new value of every change, in order within its target."""
    return grouped_previous(audit, ["target_type", "target_id"], "id", value, "old_value")


def filter_options(reports: DataFrame) -> DataFrame:
    """Distinct non-blank sites, activities and rules in one scan."""
    names = ["site", "activity", "life_saving_rule"]
    return (exclude_seed(reports).select(names).unpivot([], names, "option", "value")
            .filter(F.col("value") != "").distinct().orderBy("option", "value"))


def site_tiles(reports: DataFrame, top: int = TILES) -> DataFrame:
    """The sites with most reports and their size relative to the largest."""
    rows = (density_by(reports.filter(F.col("site") != ""), "site")
            .orderBy(F.desc("total"), "site").limit(top))
    # at most `top` rows reach this window
    largest = F.greatest(F.max("total").over(W.partitionBy()), F.lit(1))
    return rows.withColumn("relative_size", round_even(F.col("total") / largest, 6))


def list_users(users: DataFrame) -> DataFrame:
    """Users, newest first, without credential columns."""
    return users.select(*LISTED_USER_COLUMNS).orderBy(F.desc("created_at"), F.desc("id"))


def validate_users(users: DataFrame) -> DataFrame:
    """Every user with the first broken domain rule, or null."""
    problem = (F.when(F.col("name").isNull(), "name is null")
               .when(F.col("email").isNull(), "email is null")
               .when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role")
               .when(~F.coalesce(F.col("status").isin(*USER_STATUSES), F.lit(False)), "unknown status"))
    return users.withColumn("problem", problem)


def validate_reports(reports: DataFrame) -> DataFrame:
    """Every report with the first broken domain rule, or null."""
    problem = (F.when(F.col("report_id").isNull(), "report_id is null")
               .when(~F.coalesce(F.col("status").isin(*REPORT_STATUSES), F.lit(False)), "unknown status"))
    return reports.withColumn("problem", problem)


def bulk_summary(scored: DataFrame) -> DataFrame:
    counts = scored.agg(F.count(F.lit(1)).alias("total_processed"), F.count_if(_yes()).alias("sif_flagged"))
    return counts.withColumn("non_sif", F.col("total_processed") - F.col("sif_flagged"))
