"""Reporting, tables and the audit log."""

from pyspark.sql import functions as F

from bindings.evaluate import REPORT_RANKED, SCORED_SQL, stored_recurrence
from bindings.registry import query
from bindings.views import Tables, report_id
from narrascope.functions.contracts import precursor_severity
from narrascope.operators import reporting as R
from narrascope.operators import tables as T
from narrascope.plans.dashboard import dashboard_cube
from narrascope.plans.scoring import Recurrence, bulk_upload, submission_defaults, upload_summary
from narrascope.session import new_scratch, written

LIVE = "source NOT IN ('real_ihm_stefanini', 'synthetic')"
REPORTER = 7
V = ("reports",)


# --- dashboard ----------------------------------------------------------------

@query("dashboard_totals", f"""
SELECT total_reports, sif_yes, sif_needs_review, critical_open, total_reports - sif_yes AS sif_no,
       CASE WHEN total_reports > 0 THEN round_even(100.0::DOUBLE * sif_yes / total_reports, 1) ELSE 0.0 END AS sif_density
FROM (SELECT count(*) AS total_reports, count(*) FILTER (WHERE sif_potential = 'Yes') AS sif_yes,
             count(*) FILTER (WHERE sif_potential = 'NEEDS_REVIEW') AS sif_needs_review,
             count(*) FILTER (WHERE critical = 1 AND status <> 'Closed') AS critical_open
      FROM reports WHERE {LIVE})""", V)
def _(t: Tables):
    return R.dashboard_totals(t.reports)


@query("by_status", f"""
SELECT coalesce(nullif(status, ''), 'Submitted') AS status, count(*) AS cnt
FROM reports WHERE {LIVE} GROUP BY 1""", V)
def _(t):
    return R.by_status(t.reports)


@query("by_rule", f"""
SELECT life_saving_rule, count(*) AS cnt FROM reports
WHERE sif_potential = 'Yes' AND {LIVE} GROUP BY 1""", V)
def _(t):
    return R.by_rule(t.reports)


def _density_sql(key: str) -> str:
    return f"""
SELECT {key}, total, sif_count, round_even(100.0::DOUBLE * sif_count / total, 1) AS density
FROM (SELECT {key}, count(*) AS total, count(*) FILTER (WHERE sif_potential = 'Yes') AS sif_count
      FROM reports WHERE {LIVE} GROUP BY 1)"""


@query("by_site", _density_sql("site"), V)
def _(t):
    return R.density_by(t.reports, "site")


@query("by_activity", _density_sql("activity"), V)
def _(t):
    return R.density_by(t.reports, "activity")


PRECURSORS = f"""
SELECT site, activity, life_saving_rule, count(*) AS cnt FROM reports
WHERE sif_potential = 'Yes' AND life_saving_rule NOT IN ('Unmapped', 'None', 'N/A', '') AND {LIVE}
GROUP BY 1, 2, 3"""


@query("top_precursors", f"""
{PRECURSORS} HAVING count(*) >= 2 ORDER BY cnt DESC, site, activity, life_saving_rule LIMIT 5""", V)
def _(t):
    return R.top_precursors(t.reports)


@query("precursor_severity", f"""
SELECT *, CASE WHEN cnt >= 10 THEN 'High' WHEN cnt >= 5 THEN 'Medium' ELSE 'Low' END AS severity
FROM ({PRECURSORS})""", V)
def _(t):
    return R.precursor_counts(t.reports).withColumn("severity", precursor_severity(F.col("cnt")))


@query("dashboard_cube", f"""
WITH live AS (SELECT *, coalesce(nullif(status, ''), 'Submitted') AS shown FROM reports WHERE {LIVE}),
long AS (SELECT 'all' AS tile, CAST(NULL AS VARCHAR) AS value, * FROM live
  UNION ALL SELECT 'status', shown, * FROM live UNION ALL SELECT 'life_saving_rule', life_saving_rule, * FROM live
  UNION ALL SELECT 'site', site, * FROM live UNION ALL SELECT 'activity', activity, * FROM live)
SELECT tile, value, count(*) AS total, count(*) FILTER (WHERE sif_potential = 'Yes') AS sif_count,
       count(*) FILTER (WHERE critical = 1 AND status <> 'Closed') AS critical_open
FROM long GROUP BY 1, 2""", V)
def _(t):
    return dashboard_cube(t.reports)


STATS = """
SELECT reporter_id, count(*) AS total,
       count(*) FILTER (WHERE coalesce(nullif(status, ''), 'Submitted') IN ('Submitted', 'Reviewed', 'Investigation')) AS under_review,
       count(*) FILTER (WHERE status = 'Action Assigned') AS action_in_progress,
       count(*) FILTER (WHERE status = 'Closed') AS closed
FROM reports"""


@query("my_stats", f"{STATS} WHERE reporter_id = {REPORTER} GROUP BY 1", V)
def _(t):
    return R.my_stats(t.reports, REPORTER)


@query("reporter_stats", f"{STATS} GROUP BY 1", V)
def _(t):
    return R.reporter_stats(t.reports)


@query("queue_kpis", f"""
SELECT count(*) FILTER (WHERE s = 'Submitted') AS new_reports,
       count(*) FILTER (WHERE s IN ('Submitted', 'Reviewed')) AS awaiting_review,
       count(*) FILTER (WHERE critical = 1 AND status <> 'Closed') AS critical_open
FROM (SELECT *, coalesce(nullif(status, ''), 'Submitted') AS s FROM reports WHERE {LIVE})""", V)
def _(t):
    return R.queue_kpis(t.reports)


@query("recurrence_table", """
SELECT *, max(n) OVER () AS max_n FROM (
  SELECT site, activity, life_saving_rule, count(*) AS n FROM reports WHERE source = 'synthetic' GROUP BY 1, 2, 3)""", V)
def _(t):
    return R.recurrence_table(t.reports)


@query("site_tiles", f"""
SELECT site, total, sif_count, density,
       round_even(total / CAST(greatest(max(total) OVER (), 1) AS DOUBLE), 6) AS relative_size
FROM (SELECT * FROM ({_density_sql("site").replace(LIVE, LIVE + " AND site <> ''")}) ORDER BY total DESC, site LIMIT 12)""", V)
def _(t):
    return R.site_tiles(t.reports)


# --- filters, pages, listings -------------------------------------------------

@query("exclude_seed", f"SELECT id, source FROM reports WHERE {LIVE}", V)
def _(t):
    return R.exclude_seed(t.reports).select("id", "source")


@query("filter_reports", f"""
SELECT id, site, activity, sif_potential FROM reports
WHERE {LIVE} AND site = 'NATION_3' AND sif_potential = 'Yes' AND life_saving_rule = 'Hot Work'""", V)
def _(t):
    return R.filter_reports(t.reports, site="NATION_3", activity="", sif_potential="Yes",
                            life_saving_rule="Hot Work").select("id", "site", "activity", "sif_potential")


@query("scope_by_role", f"""
SELECT 'Reporter' AS role, id FROM reports WHERE {LIVE} AND reporter_id = {REPORTER}
UNION ALL SELECT 'HSE', id FROM reports WHERE {LIVE}""", V)
def _(t):
    own = R.scope_by_role(t.reports, "Reporter", REPORTER).select(F.lit("Reporter").alias("role"), "id")
    return own.unionByName(R.scope_by_role(t.reports, "HSE", REPORTER).select(F.lit("HSE").alias("role"), "id"))


PAGE_COLUMNS = ("id", "report_id", "status", "critical", "total", "pages")


@query("inbox_page", f"""
SELECT id, report_id, status, critical, total, CAST(floor((total + 24) / 25) AS BIGINT) AS pages
FROM (SELECT *, count(*) OVER () AS total FROM reports WHERE {LIVE})
ORDER BY critical DESC, (status <> 'Closed') DESC, id DESC LIMIT 25 OFFSET 50""", V)
def _(t):
    return R.inbox_page(R.exclude_seed(t.reports), page=3).select(*PAGE_COLUMNS)


@query("inbox_after", f"""
SELECT id, critical, status FROM reports WHERE {LIVE}
  AND (critical < 1 OR (critical = 1 AND (CAST(status <> 'Closed' AS INT) < 1
       OR (CAST(status <> 'Closed' AS INT) = 1 AND id < 9000))))
ORDER BY critical DESC, (status <> 'Closed') DESC, id DESC LIMIT 25""", V)
def _(t):
    return R.inbox_after(R.exclude_seed(t.reports), critical=1, is_open=True, last_id=9000).select(
        "id", "critical", "status")


@query("my_recent", f"""
SELECT report_id, status, ts, id FROM reports WHERE reporter_id = {REPORTER} ORDER BY id DESC LIMIT 5""", V)
def _(t):
    return R.my_recent(t.reports, REPORTER).select("report_id", "status", "ts", "id")


@query("recent_per_reporter", """
SELECT reporter_id, id, rn FROM (
  SELECT reporter_id, id, row_number() OVER (PARTITION BY reporter_id ORDER BY id DESC) AS rn FROM reports)
WHERE rn <= 5""", V)
def _(t):
    return R.recent_per_reporter(t.reports).select("reporter_id", "id", "rn")


@query("filter_options", f"""
SELECT DISTINCT option, value FROM (
  SELECT 'site' AS option, site AS value FROM reports WHERE {LIVE}
  UNION ALL SELECT 'activity', activity FROM reports WHERE {LIVE}
  UNION ALL SELECT 'life_saving_rule', life_saving_rule FROM reports WHERE {LIVE}) WHERE value <> ''""", V)
def _(t):
    return R.filter_options(t.reports)


@query("audit_filter", """
SELECT id, action, target_type, target_id FROM audit_log WHERE target_type = 'report' AND target_id = '42'""",
       ("audit_log",))
def _(t):
    return R.audit_filter(t.audit_log, "report", "42").select("id", "action", "target_type", "target_id")


@query("audit_latest", """
SELECT id, action, target_id, created_at FROM audit_log WHERE target_type = 'user' ORDER BY id DESC LIMIT 100""",
       ("audit_log",))
def _(t):
    return R.audit_latest(t.audit_log, "user").select("id", "action", "target_id", "created_at")


@query("status_history", """
SELECT id, target_type, target_id, new_value,
       lag(new_value) OVER (PARTITION BY target_type, target_id ORDER BY id) AS old_value FROM audit_log""",
       ("audit_log",))
def _(t):
    return R.status_history(t.audit_log).select("id", "target_type", "target_id", "new_value", "old_value")


USERS = """SELECT c_custkey AS id, c_name AS name, concat(lower(replace(c_name, '#', '.')), '@example.org') AS email,
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Reporter' WHEN 1 THEN 'Supervisor' WHEN 2 THEN 'HSE'
       WHEN 3 THEN 'Admin' ELSE 'Guest' END AS role,
  c_mktsegment AS site, CASE WHEN c_custkey % 11 = 0 THEN 'gone' WHEN c_custkey % 3 = 0 THEN 'disabled' ELSE 'active' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INT)) AS created_at FROM customer"""


def users(t: Tables):
    key = F.col("c_custkey")
    role = F.array(*[F.lit(r) for r in ("Reporter", "Supervisor", "HSE", "Admin", "Guest")])
    return t.customer.select(
        key.alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
        role[(key % 5).cast("int")].alias("role"), F.col("c_mktsegment").alias("site"),
        F.when(key % 11 == 0, "gone").when(key % 3 == 0, "disabled").otherwise("active").alias("status"),
        F.timestamp_add("DAY", (key % 300).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        F.lit("hash").alias("password_hash"))


@query("list_users", f"SELECT * FROM ({USERS})")
def _(t):
    return R.list_users(users(t))


@query("validate_domains", f"""
SELECT 'user' AS kind, CAST(id AS VARCHAR) AS key,
       CASE WHEN role NOT IN ('Reporter', 'Supervisor', 'HSE', 'Admin') THEN 'unknown role'
            WHEN status NOT IN ('active', 'disabled') THEN 'unknown status' END AS problem
FROM ({USERS})
UNION ALL
SELECT 'report', report_id, CASE WHEN raw IS NULL OR raw NOT IN
  ('Submitted', 'Reviewed', 'Investigation', 'Action Assigned', 'Closed') THEN 'unknown status' END
FROM (SELECT r.report_id, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'Open' ELSE r.status END AS raw
      FROM reports r JOIN orders ON o_orderkey = r.id)""", V)
def _(t):
    broken = t.reports.withColumn("status", F.when(F.col("status") == "Investigation", None)
                                  .when(F.col("status") == "Submitted", "Open").otherwise(F.col("status")))
    people = R.validate_users(users(t)).select(
        F.lit("user").alias("kind"), F.col("id").cast("string").alias("key"), "problem")
    return people.unionByName(R.validate_reports(broken).select(
        F.lit("report").alias("kind"), F.col("report_id").alias("key"), "problem"))


# --- keyed tables -------------------------------------------------------------

STORED = ("report_id", "site", "status", "risk_score", "source")
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
SUBMITTED = f"""
SELECT CASE WHEN l_returnflag = 'R' THEN concat('NEW-', CAST(l_partkey AS VARCHAR))
            ELSE concat('RPT-', lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 8) AS INT), '0')) END AS report_id,
       concat('line ', l_linestatus, CAST(l_linenumber AS VARCHAR)) AS site, 'Reviewed' AS status,
       CAST(floor(l_quantity) AS INT) AS risk_score, concat('feed ', l_returnflag, CAST(l_suppkey AS VARCHAR)) AS source,
       {", ".join(LINE_ORDER)}
FROM lineitem"""


def stored(t: Tables):
    return t.reports.select(*STORED)


def submitted(t: Tables):
    """Line items as submissions: updates of known reports and new ones, with repeats."""
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("NEW-"), F.col("l_partkey").cast("string")))
        .otherwise(report_id(F.col("l_orderkey"))).alias("report_id"),
        F.concat(F.lit("line "), F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("site"),
        F.lit("Reviewed").alias("status"), F.floor("l_quantity").cast("int").alias("risk_score"),
        F.concat(F.lit("feed "), F.col("l_returnflag"), F.col("l_suppkey").cast("string")).alias("source"),
        F.struct(*LINE_ORDER).alias("submitted_order"))


def _pick(side: str) -> str:
    order = ", ".join(f"{c} {'DESC' if side == 'last' else 'ASC'}" for c in LINE_ORDER)
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {order}) AS rn "
            f"FROM ({SUBMITTED})) WHERE rn = 1)")


@query("upsert_reports", f"""
SELECT coalesce(o.report_id, n.report_id) AS report_id,
       CASE WHEN n.report_id IS NOT NULL THEN n.site ELSE o.site END AS site,
       CASE WHEN n.report_id IS NOT NULL THEN n.status ELSE o.status END AS status,
       CASE WHEN n.report_id IS NOT NULL THEN n.risk_score ELSE o.risk_score END AS risk_score,
       CASE WHEN o.report_id IS NOT NULL THEN o.source ELSE f.source END AS source
FROM reports o FULL OUTER JOIN {_pick("last")} n ON o.report_id = n.report_id
LEFT JOIN {_pick("first")} f ON f.report_id = n.report_id""", V)
def _(t):
    return T.upsert(stored(t), submitted(t), "report_id", "submitted_order")


@query("insert_ignore", f"""
SELECT {", ".join(STORED)} FROM reports
UNION ALL SELECT {", ".join("n." + c for c in STORED)} FROM {_pick("first")} n
WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.report_id = n.report_id)""", V)
def _(t):
    return T.insert_ignore(stored(t), submitted(t), "report_id", "submitted_order")


@query("latest_per_key", f"SELECT report_id, site, status, risk_score, source FROM {_pick('last')}")
def _(t):
    return T.latest_per_key(submitted(t), "report_id", "submitted_order").select(*STORED)


@query("seed_reports", """
SELECT *, CASE WHEN sif_potential = 'Yes' AND risk_level = 'High' THEN 1 ELSE 0 END AS critical FROM (
  SELECT report_id, concat('report of ', activity) AS report_text, strftime(ts, '%Y-%m-%d') AS date, site, activity,
         'Incident' AS report_type, source, sif_potential, life_saving_rule,
         CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
         'Closed' AS status FROM reports)""", V)
def _(t):
    level = (F.when(F.col("risk_score") >= 70, "HIGH").when(F.col("risk_score") >= 40, "medium")
             .when(F.col("risk_score") >= 20, "Low").otherwise("none"))
    seed = t.reports.withColumns({
        "report_text": F.concat(F.lit("report of "), F.col("activity")), "report_type": F.lit("Incident"),
        "date": F.date_format("ts", "yyyy-MM-dd"), "risk_level": level})
    return T.seed_reports(seed)


@query("append_audit", f"""
SELECT 'AI Engine' AS actor_name, 'critical_flag_raised' AS action, 'report' AS target_type, report_id AS target_id,
       CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old_value,
       concat('sif_potential=Yes risk_score=', CAST(risk_score AS VARCHAR)) AS new_value,
       'Auto-flagged for immediate Reviewer alert' AS reason
FROM reports WHERE critical = 1
UNION ALL SELECT name, 'signup', 'user', CAST(id AS VARCHAR), NULL, NULL, 'role=Reporter', NULL FROM ({USERS})
UNION ALL SELECT concat('user ', CAST(actor_user_id AS VARCHAR)), 'status_change', 'report', target_id, 'status',
  lag(new_value) OVER (PARTITION BY target_type, target_id ORDER BY id), new_value, ''
FROM audit_log""", ("reports", "audit_log"))
def _(t):
    """Three kinds of audit rows appended to one log and read back."""
    path = new_scratch(t.spark, "audit")
    history = R.status_history(t.audit_log).withColumns({
        "actor_name": F.concat(F.lit("user "), F.col("actor_user_id").cast("string")), "reason": F.lit("")})
    parts = [T.critical_audit(t.reports), T.signup_audit(users(t)),
             T.change_audit(history, "status_change", "report", "status")]
    for part in parts:
        part.write.mode("append").parquet(path)
    return t.spark.read.schema(parts[0].schema).parquet(path).drop("actor_user_id")


@query("bulk_summary", """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE sif_potential = 'Yes') AS sif_flagged,
       count(*) FILTER (WHERE sif_potential <> 'Yes') AS non_sif FROM reports""", V)
def _(t):
    return R.bulk_summary(t.reports)


@query("bulk_upload", """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE p >= 0.70) AS sif_flagged,
       count(*) FILTER (WHERE p < 0.70) AS non_sif
FROM orders JOIN report_p ON id = o_orderkey WHERE o_orderstatus <> 'P'""", ("report_p",))
def _(t):
    """Reports under investigation are uploaded with a blank text and so are skipped."""
    text = F.when(F.col("status") == "Investigation", "  \t").otherwise(F.concat(F.lit("at "), F.col("site")))
    return upload_summary(t.scored_reports.withColumn("report_text", text).drop("activity"),
                          written(R.recurrence_table(t.reports), "recurrence"))


# uploads of known reports (two thirds) and of new ones, some of them twice; blank texts are skipped
UPLOAD_ID = "CASE WHEN o.id % 3 = 0 THEN concat('UP-', CAST(o.id % 50000 AS VARCHAR)) ELSE o.report_id END"
STORED_REPORT = ("report_id", "report_text", "site", "activity", "sif_potential", "life_saving_rule", "confidence", "risk_score",
                 "rule_confidence", "risk_level", "top_phrases", "analyzed_at", "status", "critical", "source", "reporter_id", "report_type")


@query("bulk_upload_table", f"""
WITH {REPORT_RANKED}, {SCORED_SQL},
up AS (SELECT {UPLOAD_ID} AS report_id, o.id, concat('at ', o.site) AS report_text, o.site, o.activity, s.sif_potential, s.life_saving_rule,
    s.confidence, s.risk_score, s.rule_confidence, s.risk_level, CAST(NULL AS VARCHAR) AS top_phrases, CAST(NULL AS VARCHAR) AS analyzed_at,
    'Submitted' AS status, s.critical, 'bulk_upload' AS source, o.reporter_id, 'Bulk' AS report_type
  FROM reports o JOIN scored_rows s USING (id) WHERE o.status <> 'Investigation'),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY id DESC) AS rn FROM up) WHERE rn = 1),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY id) AS rn FROM up) WHERE rn = 1),
old AS (SELECT report_id, 'stored' AS report_text, site, activity, 'No' AS sif_potential, 'N/A' AS life_saving_rule, 0.5::DOUBLE AS confidence,
  1 AS risk_score, 0.5::DOUBLE AS rule_confidence, 'Low' AS risk_level, '[]' AS top_phrases, strftime(ts, '%Y-%m-%d') AS analyzed_at, status,
  0 AS critical, source, reporter_id, 'Manual' AS report_type FROM reports WHERE id % 2 = 0)
SELECT coalesce(o.report_id, n.report_id) AS report_id, {", ".join(
    f"CASE WHEN n.report_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in STORED_REPORT[1:14])},
  {", ".join(f"CASE WHEN o.report_id IS NOT NULL THEN o.{c} ELSE f.{c} END AS {c}" for c in STORED_REPORT[14:])}
FROM old o FULL OUTER JOIN lst n ON o.report_id = n.report_id LEFT JOIN fst f ON f.report_id = n.report_id""",
       ("reports", "report_p", "report_classes"))
def _(t):
    stored_rows = t.reports.filter("id % 2 = 0").select(
        "report_id", F.lit("stored").alias("report_text"), "site", "activity", F.lit("No").alias("sif_potential"),
        F.lit("N/A").alias("life_saving_rule"), F.lit(0.5).alias("confidence"), F.lit(1).alias("risk_score"), F.lit(0.5).alias("rule_confidence"),
        F.lit("Low").alias("risk_level"), F.lit("[]").alias("top_phrases"), F.date_format("ts", "yyyy-MM-dd").alias("analyzed_at"), "status",
        F.lit(0).alias("critical"), "source", "reporter_id", F.lit("Manual").alias("report_type"))
    uploaded = t.scored_reports.withColumns({
        "report_text": F.when(F.col("status") == "Investigation", "  ").otherwise(F.concat(F.lit("at "), F.col("site"))),
        "report_id": F.when(F.col("id") % 3 == 0, F.concat(F.lit("UP-"), (F.col("id") % 50_000).cast("string"))).otherwise(F.col("report_id"))})
    table, _summary = bulk_upload(stored_rows, uploaded, F.col("ts"), "id", Recurrence.of(stored_recurrence(t)))
    return table.select(*STORED_REPORT)


@query("submission_defaults", """
SELECT id, CASE WHEN status = 'Closed' THEN concat('DRAFT-', strftime(ts, '%Y%m%d%H%M%S'), '000000-', CAST(id AS VARCHAR)) ELSE report_id END AS report_id,
       strftime(ts, '%Y-%m-%d') AS date, CASE WHEN sif_potential = 'No' THEN 'Unknown' ELSE site END AS site,
       'Manual' AS report_type, CASE WHEN risk_score > 50 THEN risk_score ELSE 0 END AS risk_score,
       CASE WHEN risk_score > 50 THEN concat('[{"phrase":"', activity, '","weight":0.5}]') ELSE '[]' END AS top_phrases,
       CASE WHEN risk_score > 50 THEN concat('["score ', CAST(risk_score AS VARCHAR), '","', site, '"]') END AS sif_reasons,
       CASE WHEN risk_score > 50 THEN '{"low":0.35,"high":0.7}' END AS sif_decision_thresholds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS analyzed_at,
       'Unknown' AS activity, 'api' AS source, 'No' AS sif_potential, 'N/A' AS life_saving_rule, 'Low' AS risk_level, 'Submitted' AS status,
       0.0::DOUBLE AS confidence, 0.0::DOUBLE AS rule_confidence
FROM reports""", V)
def _(t):
    high = F.col("risk_score") > 50
    phrases = F.array(F.struct(F.col("activity").alias("phrase"), F.lit(0.5).alias("weight")))
    reasons = F.array(F.concat(F.lit("score "), F.col("risk_score").cast("string")), F.col("site"))
    thresholds = F.create_map(F.lit("low"), F.lit(0.35), F.lit("high"), F.lit(0.7))
    nothing = {name: F.lit(None).cast(kind) for name, kind in {
        "activity": "string", "source": "string", "sif_potential": "string", "life_saving_rule": "string", "risk_level": "string",
        "status": "string", "confidence": "double", "rule_confidence": "double"}.items()}
    partial = t.reports.select(
        "id", F.when(F.col("status") == "Closed", "").otherwise(F.col("report_id")).alias("report_id"),
        F.lit(None).cast("string").alias("date"), F.when(F.col("sif_potential") != "No", F.col("site")).alias("site"),
        F.lit(None).cast("string").alias("report_type"), F.when(high, F.col("risk_score")).alias("risk_score"),
        F.when(high, phrases).alias("top_phrases"), F.when(high, reasons).alias("sif_reasons"),
        F.when(high, thresholds).alias("sif_decision_thresholds"), *[value.alias(name) for name, value in nothing.items()], "ts")
    done = submission_defaults(partial, F.col("ts"), "id")
    return done.withColumn("analyzed_at", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss")).drop("ts")
