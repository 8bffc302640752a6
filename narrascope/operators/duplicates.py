"""Exact duplicate narratives after normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.text import has_pii, is_malformed, normalize_text
from narrascope.operators.ordering import dense_index
from narrascope.operators.skew import hot_only, left_lookup, lookup_join, small
from narrascope.session import written


def _key(dataset: str, text: str) -> Column:
    """A 128-bit key of dataset and normalised text; shuffles move the key, not the text."""
    return F.md5(F.concat_ws("||", dataset, F.coalesce(normalize_text(F.col(text)), F.lit(""))))


def _numbered(df: DataFrame, keyed: DataFrame, dataset: str, text: str) -> DataFrame:
    """(key, n, group_id) of the groups with several members, 1..N in key order.

    Only these groups are numbered, so the global order touches one row per group. Their texts are read again
    by key, one per group, whatever the row ids are.
    """
    multi = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dup-counts")
    norm = F.coalesce(normalize_text(F.col(text)), F.lit(""))
    texts = lookup_join(df.select(_key(dataset, text).alias("key"), F.concat_ws("||", dataset, norm).alias("order_key")),
                        multi, ["key"], F.xxhash64("key")).filter(F.col("n").isNotNull())
    named = texts.groupBy("key").agg(F.min("order_key").alias("order_key"), F.min("n").alias("n"))
    indexed = dense_index(named, [F.col("order_key")], "group_id", "dup-order")
    return written(indexed.select("key", "n", "group_id"), "dup-groups")


def _attach(rows: DataFrame, numbered: DataFrame, total: Column, row_id: str) -> DataFrame:
    """Rows with their group id: no shuffle within the broadcast limit, skew-safe beyond it."""
    groups = numbered.select("key", "group_id")
    if small(groups):
        joined = rows.join(F.broadcast(groups), "key", "left")
    else:
        joined = left_lookup(rows, groups, ["key"], F.col(row_id), hot=hot_only(numbered, total).select("key"))
    return joined.withColumn("is_duplicate_group_id", F.coalesce("group_id", F.lit(0).cast("bigint"))).drop("key", "group_id")


def _keys(df: DataFrame, dataset: str, text: str, row_id: str) -> DataFrame:
    """Narrow written table of row ids and keys: texts are normalised once."""
    return written(df.select(
        F.col(row_id).alias("row_id"), F.col(dataset).alias("dataset"), _key(dataset, text).alias("key")), "dup-keys")


def duplicate_groups(df: DataFrame, dataset: str = "source_dataset", text: str = "narrative_text",
                     row_id: str = "record_id") -> DataFrame:
    """(row id, dataset, group id): 0 for single rows, 1..N for groups in key order."""
    keyed = _keys(df, dataset, text, row_id)
    numbered = _numbered(df, keyed, dataset, text)
    grouped = _attach(keyed, numbered, keyed.agg(F.count(F.lit(1))).scalar(), "row_id")
    return grouped.select(F.col("row_id").alias(row_id), F.col("dataset").alias(dataset), "is_duplicate_group_id")


def flag_quality(df: DataFrame, dataset: str = "source_dataset", text: str = "narrative_text",
                 row_id: str = "record_id") -> DataFrame:
    """The input with duplicate group id, malformed flag and PII flag; text untouched.

    While the groups with several members fit the broadcast limit, the wide
    rows are not shuffled at all.
    """
    keyed = _keys(df, dataset, text, row_id)
    numbered = _numbered(df, keyed, dataset, text)
    total = keyed.agg(F.count(F.lit(1))).scalar()
    flagged = _attach(df.withColumn("key", _key(dataset, text)), numbered, total, row_id)
    return (flagged.withColumn("is_empty_or_malformed", is_malformed(F.col(text)))
            .withColumn("has_possible_pii", has_pii(F.col(text))))


def duplicate_summary(groups: DataFrame, dataset: str = "source_dataset",
                      group: str = "is_duplicate_group_id") -> DataFrame:
    """Duplicate rows and distinct groups, per source and over all (source null)."""
    return (groups.filter(F.col(group) > 0)
            .groupBy(dataset, group).agg(F.count(F.lit(1)).alias("n"))
            .rollup(dataset)
            .agg(F.sum("n").alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups")))


def size_histogram(df: DataFrame, key: Column) -> DataFrame:
    """Number of groups by group size, with the rows they cover."""
    sizes = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(
        F.count(F.lit(1)).alias("groups"),
        (F.count(F.lit(1)) * F.col("group_size")).alias("covered_rows"))


def label_conflicts(df: DataFrame, key: Column, label: str, source: str) -> DataFrame:
    """Duplicate groups that disagree on the label or span several sources.

    Minimum and maximum tell whether a group has more than one value; no set of
    values per group is built. The 128-bit hash of the key is shuffled, not the text.
    """
    grouped = df.groupBy(F.md5(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(label) != F.max(label)).alias("mixed_label"),
        (F.min(source) != F.max(source)).alias("mixed_source"))
    return grouped.filter("n > 1").agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("covered_rows"),
        F.count_if("mixed_label").alias("label_conflicts"),
        F.count_if("mixed_source").alias("cross_source_groups"))


def assert_unique(df: DataFrame, key: str, show: int = 10) -> DataFrame:
    """The input, or an error that names repeated keys."""
    offenders = repeated_keys(df, key).take(show)
    if offenders:
        raise ValueError(f"repeated {key}: " + ", ".join(str(row[key]) for row in offenders))
    return df


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
