"""Corpus audit: counts, shares, lengths, missingness, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.functions.text import (
    NULL_WORDS, domain_relevant, is_malformed, strip, word_count,
)
from narrascope.operators.ordering import running_totals
from narrascope.schemas import UNKNOWN

# fixed values: spellings of "flag not set"
UNSET = ("", "0", "no")
REAL_FLAGS = ("is_synthetic",)


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, round_even(100.0 * part / whole, digits))


def drop_empty(df: DataFrame, text: str) -> DataFrame:
    """Rows with a non-blank narrative."""
    return df.filter(F.coalesce(strip(F.col(text)), F.lit("")) != "")


def empty_report(df: DataFrame, dataset: str, text: str) -> DataFrame:
    """Rows read, kept and dropped as empty, per dataset."""
    blank = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    return df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(~blank).alias("rows_kept"),
        F.count_if(blank).alias("rows_dropped"))


def stacked_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) for several columns in one grouping.

    Rows are combined per task before the shuffle, so a value held by a third
    of the rows sends one row per task.
    """
    texts = df.select(*[F.col(name).cast("string").alias(name) for name in columns])
    return texts.unpivot([], columns, "column_name", "value").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency and share of every value of the listed columns."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return stacked_counts(df, columns).withColumn("pct", _pct(F.col("n"), total))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties go by value."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(k).withColumn("pct", _pct(F.col("n"), total)))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column and the most frequent one with its share."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = stacked_counts(df, columns).filter("value is not null")
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.max(F.struct("n", "value")).alias("top")).select(
        "column_name", "distinct_values", F.col("top.value").alias("top_value"),
        F.col("top.n").alias("top_n"), _pct(F.col("top.n"), total).alias("top_pct"))


def length_stats(df: DataFrame, group: str, text: str) -> DataFrame:
    """Word-count statistics per group, malformed narratives left out.

    The exact median keeps one counter per distinct length, which is bounded
    by the longest narrative, not by the number of rows.
    """
    words = word_count(F.col(text))
    good = ~is_malformed(F.col(text))
    return (df.select(group, words.alias("w"), good.alias("ok")).groupBy(group).agg(
        F.count_if("ok").alias("rows_used"), F.count_if(~F.col("ok")).alias("rows_excluded"),
        round_even(F.avg(F.when(F.col("ok"), F.col("w"))), 1).alias("mean_words"),
        F.median(F.when(F.col("ok"), F.col("w"))).alias("median_words"),
        F.min(F.when(F.col("ok"), F.col("w"))).alias("min_words"),
        F.max(F.when(F.col("ok"), F.col("w"))).alias("max_words")))


def composition(df: DataFrame, dataset: str = "source_dataset", domain: str = "industry_domain",
                synthetic: str = "is_synthetic") -> DataFrame:
    """Rows per dataset and domain with dataset and grand totals.

    The base counts are grouped once; the totals are sums of that small table.
    """
    base = df.groupBy(dataset, domain, synthetic).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    rolled = base.withColumn("_relevant", domain_relevant(F.col(domain))).rollup(dataset, domain).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col(synthetic), F.col("n")).otherwise(0)).alias("synthetic_rows"),
        F.sum(F.when(~F.col(synthetic), F.col("n")).otherwise(0)).alias("real_rows"),
        F.sum(F.when(F.col("_relevant"), F.col("n")).otherwise(0)).alias("relevant_rows"))
    return rolled.withColumn("pct_of_total", _pct(F.col("n_rows"), whole))


def real_contribution(df: DataFrame, dataset: str = "source_dataset",
                      synthetic: str = "is_synthetic") -> DataFrame:
    """Real rows per source and their share of all real rows."""
    total = df.agg(F.count_if(~F.col(synthetic))).scalar()
    counts = df.groupBy(dataset).agg(F.count_if(~F.col(synthetic)).alias("real_rows"))
    return counts.withColumn("pct_of_real", _pct(F.col("real_rows"), total))


def severity_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where a flag is set to anything but blank, 0 or no.

    A set flag is evidence of severity; an unset one is no evidence of its
    absence, so nothing here yields a "No" label.
    """
    def is_set(name: str) -> Column:
        return ~F.coalesce(F.lower(strip(F.col(name).cast("string"))).isin(*UNSET), F.lit(True))

    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_set(n)).alias(n) for n in columns])
    return counts.unpivot(["total"], columns, "flag", "positive").withColumn(
        "pct", _pct(F.col("positive"), F.col("total")))


def nonzero_stats(df: DataFrame, column: str) -> DataFrame:
    """Parsed, positive and zero counts with statistics of the positive whole numbers.

    The median is exact: rows are counted per number, and running totals over
    the numbers find the one or two in the middle, so no task holds them all.
    """
    text = strip(F.col(column).cast("string"))
    parsed = F.when(text.rlike(r"\A[+-]?[0-9]{1,18}\z"), text.try_cast("bigint"))
    positive = F.when(parsed > 0, parsed)
    stats = df.agg(
        F.count(parsed).alias("parsed"), F.count(positive).alias("positive"),
        F.count_if(parsed == 0).alias("zeros"), round_even(F.avg(positive), 2).alias("mean_nonzero"),
        F.min(positive).alias("min_nonzero"), F.max(positive).alias("max_nonzero"))
    counts = df.select(positive.alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(counts, [F.col("_v")], {"_upto": "_n"}, "numbers")
    rows = upto.agg(F.max("_upto")).scalar()
    middle = [F.min(F.when(F.col("_upto") >= F.floor((rows + odd) / 2), F.col("_v"))) for odd in (1, 2)]
    median = upto.agg(*[m.cast("double").alias(n) for m, n in zip(middle, ("_low", "_high"))]).select(
        ((F.col("_low") + F.col("_high")) / 2).alias("median"))
    return stats.withColumn("median_nonzero", median.scalar())


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Two-way counts; the column values are fixed, so no extra pass finds them."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0, values)


def label_leakage(df: DataFrame, column: str, label: str) -> DataFrame:
    """Values of a column whose rows all carry one label."""
    grouped = df.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("only_label"), F.max(label).alias("_other"))
    return grouped.filter(F.col("only_label") == F.col("_other")).drop("_other")


def missingness(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = (UNKNOWN,)) -> DataFrame:
    """Null, blank and sentinel counts of every column, in one pass."""
    def counts(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.struct(
            F.lit(name).alias("column_name"), F.count_if(text.isNull()).alias("nulls"),
            F.count_if(F.lower(strip(text)).isin(*NULL_WORDS)).alias("blanks"),
            F.count_if(strip(text).isin(*sentinels)).alias("sentinels"))

    return df.agg(F.array(*[counts(name) for name in columns]).alias("c")).select(F.inline("c"))


def year_histogram(df: DataFrame, source: str, date: str) -> DataFrame:
    """Rows per source and year; dates that do not parse fall under a null year."""
    year = F.year(F.try_to_date(F.substring(F.col(date).cast("string"), 1, 10), "yyyy-MM-dd"))
    return df.groupBy(source, year.alias("year")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class reaches this window
    whole = W.partitionBy()
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.withColumn("weight", round_even(weight, 6))


def top_classes(long: DataFrame, row_id: str, rule: str = "rule", p: str = "p", top: int = 2) -> DataFrame:
    """The top classes per row from the long form; the rank filter limits before the shuffle."""
    best = W.partitionBy(row_id).orderBy(F.desc(p), F.desc(rule))
    return long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def label_join(narratives: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Narratives with their label, UNKNOWN without one; `labels` has unique keys."""
    return narratives.join(labels.select(key, label), key, "left").na.fill(UNKNOWN, [label])
