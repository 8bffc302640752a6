"""Streams equal their batch counterparts, also when a batch is replayed."""

import collections
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narrascope.operators.store import KeyedStore
from narrascope.session import list_names, new_scratch, shared_dir
from narrascope.streaming import jobs


as_struct = StructType.fromDDL
EVENTS = "id long, target_type string, target_id string, new_value string, created_at timestamp"


def run_lifecycle(spark, batches, **how):
    """The log after one micro-batch per list of (id, target, status, day)."""
    source, log, checkpoint = new_scratch(spark, "in"), new_scratch(spark, "log"), new_scratch(spark, "cp")
    for batch in batches:
        rows = [(i, "report", target, value, datetime(2024, 1, 1) + timedelta(days=day)) for i, target, value, day in batch]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_folder(spark, source, as_struct(EVENTS))
        jobs.lifecycle(stream, log, checkpoint, **how).awaitTermination()
    return log


def test_lifecycle_over_several_batches(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.5 else str(rng.randrange(9)), rng.choice(["Reviewed", "Closed"]), 0) for i in range(300)]
    rng.shuffle(rows)  # ids come in any order
    log = run_lifecycle(spark, [rows[:100], rows[100:200], rows[200:]])
    expected = {}
    for i, target, value, _ in sorted(rows):
        expected[target] = (value, i, expected.get(target, (0, 0, 0))[2] + 1)
    got = {r["target_id"]: (r["status"], r["last_id"], r["changes"]) for r in jobs.current_status(spark, log).collect()}
    assert got == expected


def test_lifecycle_expires_and_reopens(spark):
    first = [(1, "a", "Closed", 0), (2, "b", "Reviewed", 0), (3, "c", "Closed", 0)]
    # the next batches move event time on: a and c expire, d is only there for its time
    log = run_lifecycle(spark, [first, [(4, "d", "Reviewed", 40)], [(5, "d", "Reviewed", 41)], [(6, "a", "Reviewed", 42), (0, "b", "Closed", 1)]], kept_days=30)
    got = {r["target_id"]: (r["status"], r["changes"]) for r in jobs.current_status(spark, log).collect()}
    assert got == {"a": ("Reviewed", 1), "b": ("Reviewed", 1), "d": ("Reviewed", 2)} or got == {
        "a": ("Reviewed", 1), "b": ("Reviewed", 2), "d": ("Reviewed", 2)}
    expired = spark.read.parquet(log).filter("kind = 'expired'")
    assert sorted(r["target_id"] for r in expired.collect()) == ["a", "c"]


def test_lifecycle_rules_reject(spark):
    rules = {"Submitted": ["Reviewed"], "Reviewed": ["Closed", "Submitted"], "Closed": []}
    log = run_lifecycle(spark, [[(1, "a", "Submitted", 0), (2, "a", "Closed", 0), (3, "a", "Reviewed", 0)], [(4, "a", "Closed", 1), (5, "a", "Reviewed", 2)]], rules=rules)
    assert [(r["status"], r["changes"]) for r in jobs.current_status(spark, log).collect()] == [("Closed", 3)]
    assert sorted((r["last_id"], r["reason"]) for r in jobs.rejected_changes(spark, log).collect()) == [(2, "Submitted -> Closed"), (5, "Closed -> Reviewed")]


REPORTS = "report_id string, id long, site string, risk_score int, critical int, source string"


def versions(spark, n=60):
    """Submissions of 20 reports, three of each, in rising order."""
    return spark.createDataFrame([(f"R{i % 20}", i, f"site {i}", 90 if i % 10 == 0 else 10, int(i % 10 == 0), f"feed {i}") for i in range(n)], REPORTS)


def triaged(spark, store, source, checkpoint, score=lambda batch: batch):
    stream = jobs.stream_folder(spark, source, as_struct(REPORTS), files_per_trigger=1)
    jobs.triage(stream, score, store, checkpoint).awaitTermination()


def expected_table(rows):
    last, first = {}, {}
    for row in sorted(rows, key=lambda r: r.id):
        last[row.report_id] = row
        first.setdefault(row.report_id, row)
    return {k: (last[k].site, last[k].risk_score, first[k].id, first[k].source) for k in last}


def table_of(store):
    return {r.report_id: (r.site, r.risk_score, r.id, r.source) for r in store.current().collect()}


def ordered_folder(df, spark, parts):
    """Files whose ids rise from file to file, each older than the next."""
    path = new_scratch(spark, "in")
    for k in range(parts):
        df.filter((F.col("id") >= 60 * k // parts) & (F.col("id") < 60 * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # a stream takes older files first
    return path


def test_triage_table_survives_replay_and_crash(spark, monkeypatch):
    df = versions(spark)
    source = ordered_folder(df, spark, 3)
    store = KeyedStore(spark, new_scratch(spark, "reports"), as_struct(REPORTS), "report_id", buckets=4)
    checkpoint = new_scratch(spark, "cp")
    commit, calls = KeyedStore._commit, []

    def fails(self, value):
        calls.append(value.version)
        if len(calls) == 2:  # rows and audit of the second batch are written, its commit is not
            raise RuntimeError("lost")
        commit(self, value)

    monkeypatch.setattr(KeyedStore, "_commit", fails)
    with pytest.raises(StreamingQueryException):
        triaged(spark, store, source, checkpoint)
    assert table_of(store) == expected_table(df.filter("id < 20").collect())
    assert jobs.triage_audit(store).count() == 2
    triaged(spark, store, source, checkpoint)  # the second batch runs again, then the third
    assert table_of(store) == expected_table(df.collect()) and len(table_of(store)) == 20
    assert sorted(r.target_id for r in jobs.triage_audit(store).collect()) == sorted(f"R{i % 20}" for i in range(0, 60, 10))
    version = store.last_commit().version
    assert not store.merge(df, "id", checkpoint, 2)  # a batch that is committed changes nothing
    assert store.last_commit().version == version
    assert store.vacuum() > 0 and table_of(store) == expected_table(df.collect())
    assert jobs.triage_audit(store).count() == 6


def test_triage_caches_no_wide_rows(spark, monkeypatch):
    """Scored rows and a batch's rows by key lie in written tables, gone after the batch; keys repeat in it, types allow no nulls or are missing."""
    from pyspark.sql.classic.dataframe import DataFrame

    def fails(*args, **how):
        raise AssertionError("cached")

    def score(batch):
        return batch.withColumns({"limits": F.create_map(F.lit("low"), F.lit(0.5)), "note": F.lit(None)})

    df, checkpoint = versions(spark), new_scratch(spark, "cp")
    schema = StructType([*score(df).drop("note").schema, *as_struct("note string")])
    store = KeyedStore(spark, new_scratch(spark, "reports"), schema, "report_id", buckets=4)
    source = new_scratch(spark, "in")
    df.coalesce(1).write.parquet(source)
    before = set(list_names(spark, shared_dir(spark)))
    monkeypatch.setattr(DataFrame, "persist", fails)
    monkeypatch.setattr(DataFrame, "cache", fails)
    triaged(spark, store, source, checkpoint, score)
    assert table_of(store) == expected_table(df.collect())
    assert {(r.limits["low"], r.note) for r in store.current().collect()} == {(0.5, None)}
    assert jobs.triage_audit(store).count() == 6
    left = set(list_names(spark, shared_dir(spark))) - before
    assert not [name for name in left if name.startswith(("scored-", "fresh-"))]


def test_batches_rewrite_their_buckets_only(spark):
    store = KeyedStore(spark, new_scratch(spark, "reports"), as_struct(REPORTS), "report_id", buckets=16)
    store.merge(versions(spark), "id", "a", 0)
    before = store.last_commit()
    assert len(before.buckets) > 8 and set(before.buckets.values()) == {0}
    one = spark.createDataFrame([("R3", 99, "new site", 1, 0, "x"), (None, 100, "no key", 1, 0, "x")], REPORTS)
    store.merge(one, "id", "a", 1)
    after = store.last_commit()
    assert sum(v == 1 for v in after.buckets.values()) == 1 and len(table_of(store)) == 20
    assert table_of(store)["R3"] == ("new site", 1, 3, "feed 3")
    store.merge(one.limit(0), "id", "a", 2)
    assert store.last_commit().buckets == after.buckets and len(table_of(store)) == 20


def test_tiles_by_retraction(spark):
    schema = as_struct("report_id string, version long, source string, status string, site string, life_saving_rule string")
    rng = random.Random(5)
    rows = [(f"R{rng.randrange(12)}", v, rng.choice(["api", "synthetic", "api"]), rng.choice(["", "Closed", None]), rng.choice("xyz"), "rule") for v in range(80)]
    rng.shuffle(rows)  # older versions may come later
    store = KeyedStore(spark, new_scratch(spark, "tiles"), schema, "report_id", buckets=4, replaced=None, newest="version")
    source, checkpoint = new_scratch(spark, "in"), new_scratch(spark, "cp")
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(source)
    jobs.dashboard(jobs.stream_folder(spark, source, schema, files_per_trigger=1), store, checkpoint).awaitTermination()
    latest = {}
    for row in sorted(rows, key=lambda r: r[1]):
        latest[row[0]] = row
    expected = collections.Counter()
    for _, _, feed, status, site, rule in latest.values():
        if feed != "synthetic":
            expected.update([("status", status or "Submitted"), ("site", site), ("life_saving_rule", rule)])
    assert {(r.tile, r.value): r.n for r in jobs.live_counts(store).collect()} == dict(expected)
    assert store.last_commit().version == 3  # four batches
    store.vacuum(latest_only=(jobs.LIVE_COUNTS,))
    assert {(r.tile, r.value): r.n for r in jobs.live_counts(store).collect()} == dict(expected)


def test_compacted_log_keeps_latest(spark):
    log, folded = new_scratch(spark, "log"), new_scratch(spark, "folded")
    spark.createDataFrame([("a", 1, "old"), ("b", 1, "b1")], "k string, v int, s string").write.parquet(f"{log}/batch_id=0")
    spark.createDataFrame([("a", 2, "new")], "k string, v int, s string").write.parquet(f"{log}/batch_id=1")
    jobs.compact(spark, log, folded, "k", "v")
    assert {(r["k"], r["s"]) for r in jobs.current(spark, folded, "k", "v").collect()} == {("a", "new"), ("b", "b1")}


def test_stream_files_and_buckets_grow_with_the_tables(spark, monkeypatch):
    """More files and buckets for larger tables, in as many batches, with the same rows."""
    import __spark_entry__ as entry
    from bindings import streams
    from bindings.views import Tables
    from check_oracle import compare, duck

    folder = "/root/testdata/sf0.001"
    reports = Tables(spark, folder).scored_reports
    assert streams._sizes(reports, batches=2) == (4, 2, 8)
    monkeypatch.setattr(streams, "STREAM_BYTES", 5_000)
    files, a_batch, buckets = streams._sizes(reports, batches=2)
    assert files > 8 and buckets == files and -(-files // a_batch) == 2
    con = duck(folder)
    for name in ("stream_triage_audit", "stream_dashboard"):
        ok, note = compare(spark, con, name, folder, entry.queries(), entry.oracle_sql())
        assert ok, note
