"""Leakage-free train / validation / test splits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.operators.skew import lookup_join, small
from narrascope.schemas import SPLIT_SHARE
from narrascope.session import written

# hex digits of the order hash that name a block: 16^4 blocks of near equal size
PREFIX = 4


def order_hash(unit: Column, seed: int) -> Column:
    """A seeded, reproducible order of units."""
    return F.md5(F.concat_ws("|", unit, F.lit(str(seed))))


def _cutoffs(units: DataFrame, keys: list[str], weight: str, target: Column, tie: str) -> DataFrame:
    """Per key, the place (`hash`, `tie`) of the last unit taken while the running weight is below `target`.

    Units are taken along the order hash and weigh at least one; `target` may use
    `_size`, the key's whole weight. Hashes are uniform, so their first digits cut the
    units into even blocks; only the block in which the target is reached is ordered.
    """
    cut = units.select(*keys, "hash", tie, weight, F.substring("hash", 1, PREFIX).alias("_block"))
    totals = cut.groupBy(*keys, "_block").agg(F.sum(weight).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sized = totals.select(
        *keys, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
        F.sum("_t").over(W.partitionBy(*keys)).alias("_size"))
    # one row per key
    reached = written(sized.withColumn("_target", target).filter(F.col("_before") < F.col("_target")).groupBy(*keys).agg(
        F.max(F.struct("_block", "_before", "_target")).alias("_last")).select(
        *[F.col(key).alias(f"_k_{key}") for key in keys], "_last"), "split-blocks")
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys], F.col("_block") == F.col("_last._block"))
    held = cut.join(F.broadcast(reached) if small(reached) else reached, same)
    inside = W.partitionBy(*keys).orderBy("hash", tie).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("_last._before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return held.withColumn("_ahead", ahead).filter(F.col("_ahead") < F.col("_last._target")).groupBy(*keys).agg(
        F.max(F.struct("hash", tie)).alias("_cut"))


def _placed(candidate: Column, cuts: DataFrame) -> Column:
    """The split of a unit by its own hash and the two cut-off places."""
    place = F.struct(F.col("hash").alias("hash"), F.col("unit").alias("unit"))

    def upto(name: str) -> Column:
        return F.coalesce(place <= cuts.select(name).scalar(), F.lit(False))

    return (F.when(candidate & upto("test"), "test")
            .when(upto("validation"), "validation").otherwise("train"))


def _units(df: DataFrame, group: str, row_id: str, synthetic: str, seed: int) -> DataFrame:
    """One stored row per duplicate group or single record; `mixed` if its rows differ in being candidates."""
    candidate = _candidate(group, row_id, synthetic)
    return written(df.groupBy(split_unit(group, row_id).alias("unit")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(candidate).alias("candidate"),
        (F.min(candidate) != F.max(candidate)).alias("mixed"),
    ).withColumn("hash", order_hash(F.col("unit"), seed)), "split-units")


def _candidate(group: str, row_id: str, synthetic: str) -> Column:
    """Whether a row may be in test: real, single and with an id."""
    return F.coalesce((F.col(group) == 0) & ~F.col(synthetic) & F.col(row_id).isNotNull(), F.lit(False))


def _two_cuts(units: DataFrame, share: float) -> DataFrame:
    """One stored row: the places of the last test candidate and of the last validation unit."""
    target = F.bround(units.agg(F.sum("rows")).scalar() * F.lit(share)).cast("bigint")
    pool = units.filter("candidate").withColumn("_one", F.lit(1).cast("bigint"))
    test = written(_cutoffs(pool, [], "_one", target, "unit").select(F.col("_cut").alias("test")), "split-test")
    place = F.struct("hash", "unit")
    tested = F.coalesce(F.col("candidate") & (place <= test.scalar()), F.lit(False))
    validation = _cutoffs(units.filter(~tested), [], "rows", target, "unit").select(F.col("_cut").alias("validation"))
    return written(validation.withColumn("test", test.scalar()), "split-cuts")


def split_units(df: DataFrame, group: str = "is_duplicate_group_id", row_id: str = "record_id",
                synthetic: str = "is_synthetic", seed: int = 42,
                share: float = SPLIT_SHARE) -> DataFrame:
    """(unit, rows, split): the split of every duplicate group or single record.

    Test takes real single records up to the target (the whole pool if it is
    smaller); validation then takes units until it has reached the target; the
    rest is train.
    """
    units = _units(df, group, row_id, synthetic, seed)
    cuts = _two_cuts(units, share)
    return units.select("unit", "rows", _placed(F.col("candidate"), cuts).alias("split"))


def split_unit(group: str, row_id: str) -> Column:
    return F.when(F.col(group) != 0, F.concat(F.lit("g"), F.col(group).cast("string"))).otherwise(
        F.concat(F.lit("r"), F.col(row_id).cast("string")))


def group_split(df: DataFrame, group: str = "is_duplicate_group_id", row_id: str = "record_id",
                synthetic: str = "is_synthetic", seed: int = 42,
                share: float = SPLIT_SHARE) -> DataFrame:
    """The input with `unit` and `split` columns; members of a duplicate group stay together.

    Along the hash order a row's split follows from its own unit, its flag and two
    cut-off places, so rows are not shuffled. Only where rows that repeat a record id
    differ in their flag is the flag looked up. Rows without an id are one unit, never
    in test.
    """
    units = _units(df, group, row_id, synthetic, seed)
    cuts = _two_cuts(units, share)
    mixed = units.filter("mixed").select("unit", "mixed")
    keyed = df.withColumn("unit", split_unit(group, row_id))
    keyed = lookup_join(keyed, mixed, ["unit"], F.xxhash64(row_id)).withColumn("hash", order_hash(F.col("unit"), seed))
    candidate = F.coalesce("mixed", _candidate(group, row_id, synthetic))
    return keyed.withColumn("split", _placed(candidate, cuts)).select(*df.columns, "unit", "split")


def stratified_split(df: DataFrame, label: str, row_id: str, test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Seeded split with the same test share in every label.

    One cut-off place per label is found from blocks of the hash order; a label with
    a third of all rows is shared out over them, and rows are not shuffled.
    """
    digest = order_hash(F.col(row_id).cast("string"), seed)
    narrow = df.select(F.col(label).alias("_label"), F.col(row_id).alias("_id"), digest.alias("hash"),
                       F.lit(1).cast("bigint").alias("_one"))
    target = F.bround(F.col("_size") * F.lit(test_share))
    cuts = written(_cutoffs(narrow, ["_label"], "_one", target, "_id"), "label-cuts")
    placed = df.join(F.broadcast(cuts) if small(cuts) else cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    is_test = F.struct(digest.alias("hash"), F.col(row_id).alias("_id")) <= F.col("_cut")
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).select(*df.columns, "split")


def split_overlap(df: DataFrame, unit: str = "unit", split: str = "split") -> DataFrame:
    """Units shared by each pair of splits: one grouping instead of three intersections."""
    def has(name: str) -> Column:
        return F.max(F.col(split) == name)

    seen = df.groupBy(unit).agg(
        has("train").alias("tr"), has("validation").alias("va"), has("test").alias("te"))
    return seen.agg(
        F.count_if(F.expr("tr and va")).alias("train_validation"),
        F.count_if(F.expr("tr and te")).alias("train_test"),
        F.count_if(F.expr("va and te")).alias("validation_test"))


def split_report(df: DataFrame, label: str = "sif_potential", synthetic: str = "is_synthetic",
                 split: str = "split") -> DataFrame:
    """Size, share, label and synthetic mix of every split."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == "Yes").alias("yes_rows"),
        F.count_if(F.col(label) == "No").alias("no_rows"),
        F.count_if(F.col(synthetic)).alias("synthetic_rows"),
        F.count_if(~F.col(synthetic)).alias("real_rows"),
    ).withColumn("pct", round_even(F.col("rows") * 100.0 / total, 1))


def split_checks(df: DataFrame, expected: Column, group: str = "is_duplicate_group_id",
                 synthetic: str = "is_synthetic", unit: str = "unit", split: str = "split") -> DataFrame:
    """Named integrity checks with their counts and verdicts."""
    test = F.col(split) == "test"
    per_unit = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.min(split) != F.max(split)).alias("shared"),
        F.count_if(test & F.col(synthetic)).alias("synthetic_test"),
        F.count_if(test & (F.col(group) != 0)).alias("duplicate_test"))
    counts = per_unit.agg(
        (F.coalesce(F.sum("rows"), F.lit(0)) - expected).alias("missing_rows"),
        F.count_if("shared").alias("shared_units"),
        F.coalesce(F.sum("synthetic_test"), F.lit(0)).alias("synthetic_in_test"),
        F.coalesce(F.sum("duplicate_test"), F.lit(0)).alias("duplicates_in_test"))
    long = counts.unpivot([], ["missing_rows", "shared_units", "synthetic_in_test", "duplicates_in_test"],
                          "check_name", "violations")
    return long.withColumn("passed", F.col("violations") == 0)
