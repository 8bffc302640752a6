"""The corpus build: master rows to flagged, extracted and split tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.operators.duplicates import assert_unique, flag_quality
from narrascope.operators.evidence import Vocabulary, extract_evidence
from narrascope.operators.splits import group_split
from narrascope.schemas import MASTER_COLUMNS
from narrascope.sources.files import write_splits, write_table


@dataclass(frozen=True)
class CorpusPaths:
    flagged: str
    extracted: str
    splits: str


def check_columns(df: DataFrame) -> DataFrame:
    if tuple(df.columns) != MASTER_COLUMNS:
        raise ValueError(f"expected the {len(MASTER_COLUMNS)} master columns, found {df.columns}")
    return df


def build_corpus(master: DataFrame, vocabulary: Vocabulary, paths: CorpusPaths, labelled: str,
                 seed: int = 42) -> DataFrame:
    """Write the three tables and return the split rows of the labelled source.

    Each stage is written once because the next one reads it several times.
    """
    spark = master.sparkSession
    write_table(flag_quality(assert_unique(check_columns(master), "record_id")), paths.flagged)
    flagged = spark.read.parquet(paths.flagged)
    write_table(extract_evidence(flagged, vocabulary), paths.extracted)
    extracted = spark.read.parquet(paths.extracted)
    usable = extracted.filter((F.col("source_dataset") == labelled) & ~F.col("is_empty_or_malformed"))
    write_splits(group_split(usable, seed=seed), paths.splits)
    return spark.read.parquet(paths.splits)
