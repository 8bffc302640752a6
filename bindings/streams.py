"""Streams over folders of report files made from the orders, compared with batch results."""

from pyspark.sql import functions as F

from bindings.evaluate import REPORT_RANKED, SCORED_COLUMNS, SCORED_SQL, flat, stored_recurrence
from bindings.registry import query
from bindings.reports import LIVE
from bindings.views import Tables
from narrascope.operators.skew import part_count
from narrascope.operators.store import KeyedStore
from narrascope.plans.scoring import Recurrence, score_reports
from narrascope.schemas import UPSERT_COLUMNS
from narrascope.session import new_scratch
from narrascope.streaming import jobs

SCORED_VIEWS = ("reports", "report_p", "report_classes")


FILES, BUCKETS = 4, 8  # of small tables
STREAM_BYTES = 2 << 20  # of the stored tables, for each file of a stream and each bucket of its store


def _folder(df, t: Tables, label: str, partitions: int = FILES) -> str:
    path = new_scratch(t.spark, label)
    df.repartition(partitions).write.parquet(path)
    return path


def _sizes(df, batches: int) -> tuple[int, int, int]:
    """Files of a stream, how many a batch reads, and buckets of its store: both grow with the tables, the number of batches does not."""
    files = part_count(df, FILES, STREAM_BYTES)
    return files, -(-files // batches), max(files, BUCKETS)


REPLACED = tuple(name for name in UPSERT_COLUMNS if name not in ("report_text", "top_phrases", "analyzed_at"))
KEPT = ("source", "reporter_id", *[name for name in SCORED_COLUMNS if name not in REPLACED])


def _triage(t: Tables) -> KeyedStore:
    """Two thirds of the reports are stored already, as someone entered them; then all are submitted to the stream."""
    spark, source = t.spark, t.scored_reports
    recurrence = Recurrence.of(stored_recurrence(t))

    def score(batch):
        return score_reports(batch, recurrence).withColumns({
            "report_text": F.concat(F.lit("at "), F.col("site")), "top_phrases": F.lit("[]"), "analyzed_at": F.date_format("ts", "yyyy-MM-dd")})

    files, files_a_batch, buckets = _sizes(source, batches=2)
    schema = score(source).drop("p", "class_probs", "recurrence").schema
    store = KeyedStore(spark, new_scratch(spark, "reports"), schema, "report_id", buckets=buckets)
    entered = source.filter("id % 3 <> 0").select("report_id", "id", F.lit("entered by hand").alias("report_text"), F.lit("old").alias("status"),
                                                 F.lit("stored").alias("source"), F.lit(0).cast("bigint").alias("reporter_id"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in entered.columns}
    store.merge(entered.withColumns(missing), "id", "entered", 0)
    stream = jobs.stream_folder(spark, _folder(source, t, "reports-in", files), source.schema, files_per_trigger=files_a_batch)
    jobs.triage(stream, score, store, new_scratch(spark, "checkpoint")).awaitTermination()
    return store


@query("stream_triage", f"""
WITH {REPORT_RANKED}, {SCORED_SQL}
SELECT r.report_id, r.id, r.site, r.activity, r.status, concat('at ', r.site) AS report_text, '[]' AS top_phrases,
  strftime(r.ts, '%Y-%m-%d') AS analyzed_at, {", ".join("s." + c for c in SCORED_COLUMNS if c in REPLACED)},
  CASE WHEN r.id % 3 <> 0 THEN 'stored' ELSE r.source END AS source, CASE WHEN r.id % 3 <> 0 THEN 0 ELSE r.reporter_id END AS reporter_id,
  {", ".join(f"CASE WHEN r.id % 3 = 0 THEN s.{c} END AS {c}" for c in KEPT[2:])}
FROM reports r JOIN scored_rows s USING (id)""", SCORED_VIEWS)
def _(t):
    """The report table after the stream: 13 columns of a stored report are replaced, the others stay."""
    return flat(_triage(t).current()).select(
        "report_id", "id", "site", "activity", "status", "report_text", "top_phrases", "analyzed_at",
        *[c for c in SCORED_COLUMNS if c in REPLACED], *KEPT)


@query("stream_triage_audit", f"""
WITH {REPORT_RANKED}, {SCORED_SQL}
SELECT CAST(NULL AS BIGINT) AS actor_user_id, 'AI Engine' AS actor_name, 'critical_flag_raised' AS action, 'report' AS target_type,
  r.report_id AS target_id, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old_value,
  concat('sif_potential=Yes risk_score=', CAST(s.risk_score AS VARCHAR)) AS new_value, 'Auto-flagged for immediate Reviewer alert' AS reason
FROM reports r JOIN scored_rows s USING (id) WHERE s.critical = 1""", SCORED_VIEWS)
def _(t):
    return jobs.triage_audit(_triage(t))


def _versions(t: Tables):
    """Two versions of every report: as submitted, then as it stands now."""
    now = t.reports.withColumn("version", F.col("id") * 2 + 1)
    first = t.reports.withColumns({"version": F.col("id") * 2, "status": F.lit(""), "life_saving_rule": F.lit("N/A")})
    return first.unionByName(now)


@query("stream_dashboard", f"""
SELECT tile, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'status' AS tile, coalesce(nullif(status, ''), 'Submitted') AS value, 1 AS n FROM reports WHERE {LIVE}
  UNION ALL SELECT 'site', site, 1 FROM reports WHERE {LIVE} UNION ALL SELECT 'life_saving_rule', life_saving_rule, 1 FROM reports WHERE {LIVE}) GROUP BY 1, 2""", ("reports",))
def _(t):
    source = _versions(t)
    files, files_a_batch, buckets = _sizes(source, batches=4)
    stream = jobs.stream_folder(t.spark, _folder(source, t, "versions-in", files), source.schema, files_per_trigger=files_a_batch)
    store = KeyedStore(t.spark, new_scratch(t.spark, "dashboard"), source.select(*jobs.DASHBOARD_FIELDS).schema, "report_id", buckets=buckets,
                       replaced=None, newest="version")
    jobs.dashboard(stream, store, new_scratch(t.spark, "checkpoint")).awaitTermination()
    return jobs.live_counts(store)


def _lifecycle(t: Tables, **how) -> str:
    source = t.audit_log
    stream = jobs.stream_folder(t.spark, _folder(source, t, "audit-in"), source.schema, files_per_trigger=2)
    log = new_scratch(t.spark, "lifecycle-log")
    jobs.lifecycle(stream, log, new_scratch(t.spark, "checkpoint"), **how).awaitTermination()
    return log


@query("stream_lifecycle", """
SELECT target_type, target_id, max_by(new_value, id) AS status, max(id) AS last_id, count(*) AS changes FROM audit_log GROUP BY 1, 2""", ("audit_log",))
def _(t):
    return jobs.current_status(t.spark, _lifecycle(t))
