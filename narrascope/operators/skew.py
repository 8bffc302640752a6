"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A key is hot when it holds more than 1/HOT_KEYS of the rows, so there are fewer
# than HOT_KEYS hot keys whatever the data: their lookup rows may be broadcast.
HOT_KEYS = 10_000
# keys below this many rows are never worth special treatment
HOT_FLOOR = 100_000
# largest lookup, in rows and in bytes, that is broadcast without a proven bound on its growth
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# a plan whose own estimate is below this is taken as small: even 32 times as much may be broadcast
TRUSTED_BYTES = 4 << 20
# stored bytes that one task of a growing operation (as the words of texts) is dealt, and the most such tasks
PART_BYTES, MOST_PARTS = 8 << 20, 20_000
UNKNOWN_BYTES = 1 << 60  # what the planner takes for rows whose size it does not know


def hot_only(counts: DataFrame, total: Column, rows: str = "n") -> DataFrame:
    """The hot keys of a table of row counts per key."""
    return counts.filter(
        (F.col(rows) > HOT_FLOOR) & (F.col(rows) * F.lit(HOT_KEYS) > total)
    )


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return hot_only(counts, total).select(*keys)


def left_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column,
                hot: DataFrame | None = None) -> DataFrame:
    """Left join to a table with unique keys; hot keys do not meet in one task.

    Lookup rows of hot keys are broadcast. The rows they serve, and rows with a
    null key, get a salt from `spread`, a column that differs between rows, so
    the shuffle for the other keys scatters them instead of sending them to one
    reducer.
    """
    if hot is None:
        hot = hot_keys(rows, keys)
    values = [name for name in lookup.columns if name not in keys]
    hot_rows = lookup.join(F.broadcast(hot.select(*keys)), keys, "left_semi").select(
        *keys, *[F.col(name).alias(f"_hot_{name}") for name in values], F.lit(True).alias("_is_hot"))
    keyless = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in keys])
    tagged = rows.join(F.broadcast(hot_rows), keys, "left").withColumn(
        "_salt", F.when(F.col("_is_hot") | keyless, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    joined = tagged.join(lookup.withColumn("_salt", F.lit(0).cast("bigint")), keys + ["_salt"], "left")
    own = [name for name in rows.columns]
    return joined.select(
        *own,
        *[F.when(F.col("_is_hot"), F.col(f"_hot_{name}")).otherwise(F.col(name)).alias(name)
          for name in values])


def small(lookup: DataFrame, limit: int | None = None) -> bool:
    """Whether a lookup has at most `limit` rows and fits a broadcast in bytes.

    The plan's own estimate answers for small stored tables without a job; other
    lookups are measured in one distributed pass that adds up rows and bytes.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    # a row takes at least 8 bytes, so few bytes also mean few rows
    if _estimated_bytes(lookup) <= min(8 * limit, TRUSTED_BYTES):
        return True
    size = lookup.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(lookup)), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= limit and size["bytes"] <= BROADCAST_BYTES


def _estimated_bytes(df: DataFrame) -> int:
    """Size of the result by the optimizer's statistics (of joins and groupings an upper estimate)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts by their length, nested values by their JSON text, numbers as 8."""
    def width(field) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.octet_length(value)
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            return F.octet_length(F.to_json(F.struct(value)))
        return F.lit(8)

    return reduce(lambda a, b: a + b, [F.coalesce(width(f), F.lit(0)).cast("bigint") for f in df.schema], F.lit(16).cast("bigint"))


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column,
                limit: int | None = None) -> DataFrame:
    """Left join to a unique-key lookup: broadcast within a checked size, skew-safe beyond it.

    The check reads the lookup, so pass a stored table if it is costly to compute.
    """
    if small(lookup, limit):
        return rows.join(F.broadcast(lookup), keys, "left")
    return left_lookup(rows, lookup, keys, spread)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, repartitioned for heavy work per row.

    Small files arrive as one or a few tasks; large tables have more splits
    than cores and are returned unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def part_count(df: DataFrame, least: int, part_bytes: int = PART_BYTES) -> int:
    """Parts of about `part_bytes` of the files that `df` reads, at least `least`; rows of unknown size count as the shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size >= UNKNOWN_BYTES for size in sizes):
        least = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(max(sum(size for size in sizes if size < UNKNOWN_BYTES) // part_bytes, least), MOST_PARTS)


def in_parts(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key into parts, so that what a task makes of its rows fits its memory whatever the size of the table."""
    return df.repartition(part_count(df, df.sparkSession.sparkContext.defaultParallelism), key)
