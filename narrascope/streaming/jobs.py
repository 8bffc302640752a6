"""Streams over submitted reports and status changes.

Reports go into a stored table by key, of which a micro-batch rewrites the buckets it touches; audit rows and
tile counts are committed with them, and a replayed batch changes nothing. Status changes are kept by a stateful
processor, whose output is an append-only log with one folder per micro-batch, written in overwrite mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, NullType, StringType, StructField, StructType

from narrascope.operators.reporting import shown_status
from narrascope.operators.store import KeyedStore
from narrascope.operators.tables import critical_audit, latest_per_key
from narrascope.schemas import SEED_SOURCES
from narrascope.session import discard, written

BATCH = "batch_id"
AUDIT, LIVE_COUNTS = "audit", "live_counts"
CRITICAL_AUDIT = StructType([StructField("actor_user_id", LongType()), *[StructField(name, StringType()) for name in (
    "actor_name", "action", "target_type", "target_id", "field", "old_value", "new_value", "reason")]])
TILE_COUNTS = StructType([StructField("tile", StringType()), StructField("value", StringType()), StructField("n", LongType())])
TILES = ("status", "site", "life_saving_rule")
DASHBOARD_FIELDS = ("report_id", "version", "source", *TILES)
CHANGED, REJECTED, EXPIRED = "changed", "rejected", "expired"
CLOSED = "Closed"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_folder(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New report files of a folder, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def _start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None],
           mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run over what is there and stop, or keep running with a micro-batch `every` interval."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**trigger).foreachBatch(write).start())


def triage(stream: DataFrame, score: Callable[[DataFrame], DataFrame], store: KeyedStore, checkpoint: str,
           order: str = "id", every: str | None = None) -> StreamingQuery:
    """Score reports on arrival and upsert them into the report table, with an audit row for each critical one.

    Report rows and audit rows of a micro-batch become visible together. The scored rows are written once, since both read them.
    """
    types = {f.name: f.dataType for f in store.schema}

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch)
        # an empty column has a type only in the store
        untyped = {f.name: F.col(f.name).cast(types.get(f.name, StringType())) for f in scored.schema if isinstance(f.dataType, NullType)}
        scored = written(scored.withColumns(untyped) if untyped else scored, "scored")
        try:
            store.merge(scored, order, checkpoint, batch_id, beside={AUDIT: critical_audit(scored)})
        finally:
            discard(scored)

    return _start(stream, checkpoint, write, every=every)


def triage_audit(store: KeyedStore) -> DataFrame:
    """The audit rows of all committed batches."""
    return store.side(AUDIT, CRITICAL_AUDIT)


def current(spark: SparkSession, log: str, key: str, order: str) -> DataFrame:
    """Latest version of every key in a change log; later batches win ties."""
    versions = spark.read.parquet(log)
    ordered = versions.withColumn("_order", F.struct(order, BATCH))
    return latest_per_key(ordered, key, "_order").drop("_order", BATCH)


def tile_values(report: str, sign: int) -> Column:
    """What a report (a struct column) adds to the tiles, or takes from them: array<struct<tile, value, n>>."""
    at = F.col(report)
    shown = at.isNotNull() & ~at["source"].isin(*SEED_SOURCES)
    entries = [F.struct(F.lit(name).alias("tile"), (shown_status(at[name]) if name == "status" else at[name]).alias("value"),
                        F.lit(sign).cast("bigint").alias("n")) for name in TILES]
    return F.when(shown, F.array(*entries)).otherwise(F.array().cast("array<struct<tile:string,value:string,n:bigint>>"))


def retractions(changes: DataFrame) -> DataFrame:
    """(tile, value, n): a changed report takes back what its old state counted and counts its new one."""
    entries = F.concat(tile_values("old", -1), tile_values("new", 1))
    return changes.select(F.inline(entries)).groupBy("tile", "value").agg(F.sum("n").alias("n"))


def dashboard(stream: DataFrame, store: KeyedStore, checkpoint: str, order: str = "version",
              every: str | None = None) -> StreamingQuery:
    """Keep the tiles of the dashboard up to date from the changes of every micro-batch.

    `store` holds the fields that the tiles count (DASHBOARD_FIELDS), by their newest version. A batch reads the buckets of
    its own keys and the last counts, whatever the history; the counts have one row per value.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        before = store.side(LIVE_COUNTS, TILE_COUNTS, latest=True)

        def counts(changes: DataFrame) -> dict[str, DataFrame]:
            added = before.union(retractions(changes)).groupBy("tile", "value").agg(F.sum("n").alias("n"))
            return {LIVE_COUNTS: added.filter("n <> 0").coalesce(1)}

        store.merge(batch.select(*DASHBOARD_FIELDS), order, checkpoint, batch_id, counts)

    return _start(stream, checkpoint, write, every=every)


def live_counts(store: KeyedStore) -> DataFrame:
    """Counts by status, site and rule as of the last committed batch: (tile, value, n)."""
    return store.side(LIVE_COUNTS, TILE_COUNTS, latest=True)


class Lifecycle(StatefulProcessor):
    """One target's state: its status, the event that set it, when, and how many events were taken.

    Events are taken in whatever order they come: one with a smaller id than the last counts but does not change the status. With
    rules, an event whose status may not follow the present one is rejected. A closed target is forgotten `kept_days` of event
    time after it was closed; an event that comes later starts it anew.
    """

    STATE = "status string, last_id bigint, at timestamp, changes bigint"

    def __init__(self, rules: dict[str, list[str]] | None, kept_days: int | None):
        self.rules, self.kept_days = rules, kept_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("target", self.STATE)

    def _sent(self, key: tuple, kind: str, **values) -> dict:
        return {"target_type": key[0], "target_id": key[1], "kind": kind, "status": None, "last_id": None, "changes": None, "reason": None, **values}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        status, last_id, at, changes = now if now else (None, -1, None, 0)
        taken, sent = False, []
        for frame in rows:
            for id_, value, when in frame.sort_values("id")[["id", "new_value", "created_at"]].itertuples(index=False):
                if id_ < last_id:  # late: an event that is already outdated
                    changes, taken = changes + 1, True
                    continue
                if self.rules is not None and status is not None and value not in self.rules.get(status, ()):
                    sent.append(self._sent(key, REJECTED, status=value, last_id=int(id_), reason=f"{status} -> {value}"))
                    continue
                status, last_id, at, changes, taken = value, int(id_), when, changes + 1, True
            if len(sent) >= 1000:
                yield pd.DataFrame(sent)
                sent = []
        if taken:
            self.state.update((status, last_id, at, changes))
            if self.kept_days is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if status == CLOSED:
                    self.handle.registerTimer(int(at.timestamp() * 1000) + self.kept_days * 86_400_000)
            sent.append(self._sent(key, CHANGED, status=status, last_id=last_id, changes=changes))
        if sent:
            yield pd.DataFrame(sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, last_id, _, changes = self.state.get()
            self.state.clear()
            yield pd.DataFrame([self._sent(key, EXPIRED, status=status, last_id=last_id, changes=changes)])

    def close(self) -> None:
        pass


LIFECYCLE = "target_type string, target_id string, kind string, status string, last_id bigint, changes bigint, reason string"


def lifecycle(stream: DataFrame, log: str, checkpoint: str, rules: dict[str, list[str]] | None = None,
              kept_days: int | None = None, late: str = "0 seconds", every: str | None = None) -> StreamingQuery:
    """Status changes of targets, per event batch, in a log: changed, rejected (with `rules`) and expired (with `kept_days`).

    The state lies in RocksDB, one value per target. `late` is how far event times may lag behind before timers see them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = kept_days is not None
    if timed:
        stream = stream.withWatermark("created_at", late)
    events = stream.select("target_type", "target_id", "id", "new_value", "created_at")
    states = events.groupBy("target_type", "target_id").transformWithStateInPandas(
        Lifecycle(rules, kept_days), LIFECYCLE, "update" if not timed else "append", "EventTime" if timed else "none")
    return _start(states, checkpoint, lambda batch, n: _write_batch(batch, log, n), "append" if timed else "update", every)


def current_status(spark: SparkSession, log: str) -> DataFrame:
    """The latest state of every target that has not expired since: (target_type, target_id, status, last_id, changes)."""
    versions = spark.read.schema(StructType.fromDDL(f"{LIFECYCLE}, {BATCH} bigint")).parquet(log).filter(F.col("kind") != REJECTED)
    last = versions.groupBy("target_type", "target_id").agg(
        F.max_by(F.struct("kind", "status", "last_id", "changes"), BATCH).alias("s"))
    return last.filter(F.col("s.kind") == CHANGED).select("target_type", "target_id", "s.status", "s.last_id", "s.changes")


def rejected_changes(spark: SparkSession, log: str) -> DataFrame:
    """Events that the transition rules refused: (target_type, target_id, status, last_id, reason)."""
    versions = spark.read.schema(StructType.fromDDL(f"{LIFECYCLE}, {BATCH} bigint")).parquet(log)
    return versions.filter(F.col("kind") == REJECTED).select("target_type", "target_id", "status", "last_id", "reason")


def compact(spark: SparkSession, log: str, into: str, key: str, order: str) -> None:
    """Fold a change log into a new one that holds each key's latest version as batch -1."""
    current(spark, log, key, order).write.parquet(f"{into}/{BATCH}=-1")
