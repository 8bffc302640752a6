"""Row numbers, running totals and neighbours without one-task windows.

A window over a whole table, or over one hot key, ends in a single task. Here
the rows are cut into blocks along the order first; windows run inside blocks
and small per-block tables carry the totals from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.operators.skew import lookup_join, small
from narrascope.session import written

# Order columns are unique integers, so a block of this width holds at most this many rows.
BLOCK_WIDTH = 1_000_000
FEW_BLOCKS = 10_000  # up to so many block counts one window numbers them


def grouped_row_number(df: DataFrame, keys: list[str], order: str, name: str,
                       width: int = BLOCK_WIDTH) -> DataFrame:
    """1-based position of each row within its key, along a unique integer column.

    Equal to row_number() over (partition by keys order by order), without gathering a key in one task or
    sorting the rows themselves. The order is cut into blocks. In a block without gaps a row's place follows from its
    number; of blocks with gaps only (key, number) is ranked. Far apart numbers make as many blocks as
    rows, so the blocks' own totals run over a range partitioning, minus what lies before the key's first block.
    """
    cut = F.floor(F.col(order) / F.lit(width)).alias("_cut")
    narrow = df.select(*keys, order, cut)
    names = [*keys, "_cut"]
    counts = written(narrow.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")), "block-counts")
    dense = (F.col("_high") - F.col("_low") + 1 == F.col("_n")).alias("_dense")
    # null keys are equal inside a struct
    block, row_key = F.struct(*names).alias("_block"), F.struct(*keys, order).alias("_row")
    if small(counts, FEW_BLOCKS):
        earlier = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select(block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), "_low", dense)
    else:
        upto = written(running_totals(counts, [F.col(n) for n in names], {"_upto": "_n"}, "blocks").select(
            *names, (F.col("_upto") - F.col("_n")).alias("_before"), "_low", dense), "block-totals")
        group = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("_group")
        firsts = upto.groupBy(*keys).agg(F.min("_before").alias("_first"))
        offsets = written(lookup_join(upto.withColumn("_group", group), firsts.select(group, "_first"), ["_group"], F.col("_low")).select(
            block, (F.col("_before") - F.col("_first")).alias("_before"), "_low", "_dense"), "block-offsets")
    gaps = offsets.filter(~F.col("_dense")).select("_block", F.lit(True).alias("_ranked"))
    placed = lookup_join(df.withColumn("_cut", cut).withColumn("_block", block), offsets, ["_block"], F.col(order))
    if gaps.isEmpty():
        local = F.col(order) - F.col("_low") + 1
    else:
        some = lookup_join(narrow.withColumn("_block", block), gaps, ["_block"], F.col(order)).filter("_ranked")
        ranks = written(some.select(row_key, F.row_number().over(W.partitionBy(*names).orderBy(order)).alias("_local")), "ranks")
        placed = lookup_join(placed.withColumn("_row", row_key), ranks, ["_row"], F.col(order))
        local = F.when(F.col("_dense"), F.col(order) - F.col("_low") + 1).otherwise(F.col("_local"))
    return placed.select(*df.columns, (F.col("_before") + local).cast("bigint").alias(name))


def keyed_row_number(df: DataFrame, keys: list[str], order: str, name: str, hot: DataFrame) -> DataFrame:
    """As `grouped_row_number` for many keys of few rows: rows meet by key and are ranked there.

    `hot` are the keys of so many rows that they must not meet in one task; these are numbered over blocks.
    """
    meet = F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, meet)
    # null keys are equal inside a struct; hot keys are few, since each holds a floor of rows
    key = F.struct(*keys).alias("_key")
    tagged = df.withColumn("_key", key).join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), "_key", "left")
    cold, rest = tagged.filter(F.col("_hot").isNull()).select(*df.columns), tagged.filter("_hot").select(*df.columns)
    return cold.withColumn(name, meet).unionByName(grouped_row_number(rest, keys, order, name))


def grouped_previous(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The value of the preceding row of the same key (null for the first).

    Equal to lag(value) over (partition by keys order by order). Rows are cut by range along (keys, order), so the
    preceding row is the one before in the same cut or the last one of the cut before; a key
    of any size and numbers of any distance spread over the cuts.
    """
    along = [F.col(k) for k in keys] + [F.col(order)]
    cut = _range_blocks(df, along, "previous")
    here = F.struct(F.struct(*keys).alias("key"), F.col(value).alias("v"))
    # one row per cut, so this window and broadcast are bounded by the number of partitions
    last = cut.groupBy("_block").agg(F.max_by(here, F.struct(*along)).alias("_tail"))
    carried = last.select("_block", F.lag("_tail").over(W.orderBy("_block")).alias("_earlier"))
    local = cut.withColumn("_ahead", F.lag(here).over(W.partitionBy("_block").orderBy(*along)))
    before = F.coalesce("_ahead", "_earlier")
    return (local.join(F.broadcast(carried), "_block")
            .withColumn(name, F.when(before["key"] == F.struct(*keys), before["v"]))
            .select(*df.columns, name))


def _range_blocks(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Rows range-partitioned along the order, each with its block number.

    The result is a written table: block numbers come from sampled bounds, and
    a recomputed partition must not fall under other bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(
        df.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id()), label)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str],
                   label: str = "running") -> DataFrame:
    """Inclusive running sums of columns along a global order of distinct keys.

    `sums` maps new column names to summed columns. The per-block totals number
    one row per partition, so their own window and broadcast are bounded.
    """
    cut = _range_blocks(df, order, label)
    totals = cut.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_block", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    return local.join(F.broadcast(offsets), "_block").select(
        *df.columns, *[(F.col(f"_t_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])


def dense_index(df: DataFrame, order: list[Column], name: str, label: str = "index") -> DataFrame:
    """1-based index of distinct keys along a global order of any type."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, order, {name: "_one"}, label).drop("_one")
