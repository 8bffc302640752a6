"""The source manifest: provenance rows that drive ingestion."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.quality import drop_empty
from narrascope.schemas import MANIFEST_COLUMNS, NOT_EVALUATED
from narrascope.session import local_table
from narrascope.sources.mapping import Mapper, Provenance, union_sources

SUMMARY = "dataset string, skipped boolean, reason string"


def build_manifest(spark: SparkSession, entries: list[Mapping[str, str]],
                   sources: Mapping[str, DataFrame]) -> DataFrame:
    """One provenance row per source; row counts come from the sources themselves."""
    rows = local_table(
        spark, [tuple(entry.get(name) for name in MANIFEST_COLUMNS) for entry in entries],
        ", ".join(f"{name} string" for name in MANIFEST_COLUMNS))
    counted = None
    for name, source in sources.items():
        part = source.agg(F.count(F.lit(1)).cast("string").alias("_n")).select(
            F.lit(name).alias("dataset_name"), "_n")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return rows
    return rows.join(F.broadcast(counted), "dataset_name", "left").withColumn(
        "row_count", F.coalesce("_n", "row_count")).select(*MANIFEST_COLUMNS)


@dataclass
class Ingested:
    """The mapped rows (None without any usable source) and the per-source summary."""

    master: DataFrame | None
    summary: DataFrame


def ingest(spark: SparkSession, manifest: DataFrame, readers: Mapping[str, Callable[[], DataFrame | None]],
           mappers: Mapping[str, Mapper], ingestion_date: str,
           keep_empty: bool | frozenset[str] = False) -> Ingested:
    """Walk the manifest and map every usable source; others are listed with the reason.

    The manifest is a table of sources, so its loop builds a plan and moves no
    data. A reader returns None when its file is missing. Rows without a narrative
    are dropped, except for all sources (`keep_empty` true) or those it names.
    """
    parts, read_counts, notes = [], [], []
    for row in manifest.toLocalIterator():
        name, narrative = row["dataset_name"].strip(), (row["narrative_text_column"] or "").strip()
        frame, reason = None, None
        if narrative.upper() == NOT_EVALUATED:
            reason = "N/A narrative column (reference file)"
        elif name not in mappers:
            reason = "No mapper registered"
        else:
            frame = readers[name]() if name in readers else None
            if frame is None:
                reason = "File not found"
            elif narrative not in frame.columns:
                reason = f"Narrative column '{narrative}' not found"
        notes.append((name, reason is not None, reason or ""))
        if frame is not None:
            read_counts.append(frame.agg(F.count(F.lit(1)).alias("rows_read")).select(
                F.lit(name).alias("dataset"), "rows_read"))
        if reason is None:
            kept = frame if keep_empty is True or (keep_empty and name in keep_empty) else drop_empty(frame, narrative)
            provenance = Provenance(name, row["source_organization"], row["source_url"], row["source_type_value"])
            parts.append(mappers[name](kept, provenance, ingestion_date))

    summary = local_table(spark, notes, SUMMARY)
    master = union_sources(parts) if parts else None
    if master is None:
        counts = summary.select("dataset", F.lit(0).cast("bigint").alias("rows_read"),
                                F.lit(0).cast("bigint").alias("rows_written"))
        return Ingested(None, counts.join(summary, "dataset"))
    written = master.groupBy(F.col("source_dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("rows_written"))
    reads = read_counts[0]
    for part in read_counts[1:]:
        reads = reads.unionByName(part)
    full = summary.join(reads, "dataset", "left").join(written, "dataset", "left").na.fill(
        0, ["rows_read", "rows_written"])
    return Ingested(master, full.select("dataset", "rows_read", "rows_written", "skipped", "reason"))
