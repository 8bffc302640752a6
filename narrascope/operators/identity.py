"""Record ids that depend on the order of rows in their source.

Files have an order, DataFrames do not: every function takes the position
column explicitly and never guesses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.ordering import grouped_row_number, keyed_row_number, running_totals
from narrascope.operators.skew import BROADCAST_ROWS, HOT_FLOOR, lookup_join
from narrascope.session import written


def dedupe_ids(df: DataFrame, dataset: str, record: str, position: str, out: str) -> DataFrame:
    """The n-th repeat of an id within its dataset gets `_dupN`; the first is unchanged.

    Ids are counted once. Where few rows repeat an id, only positions of repeated ids are numbered, and the rows look up
    those after the first; beyond a broadcast such a join would move all rows anyway, so the rows meet by id instead, once.
    """
    keys, key = [dataset, record], F.struct(dataset, record).alias("_key")
    repeated = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated")
    later, hot = repeated.agg(F.sum(F.col("_n") - 1)).first()[0] or 0, repeated.filter(F.col("_n") > HOT_FLOOR).select(*keys)
    if later <= BROADCAST_ROWS:
        some = lookup_join(df.select(*keys, position, key), repeated.select(key, F.lit(True).alias("_many")), ["_key"],
                           F.col(position)).filter("_many").select(*keys, position)
        after = written(keyed_row_number(some, keys, position, "_nth", hot).filter("_nth > 1").select(position, "_nth"), "later")
        numbered = lookup_join(df, after, [position], F.col(position))
    else:
        numbered = keyed_row_number(df, keys, position, "_nth", hot)
    named = F.concat(F.col(record), F.lit("_dup"), (F.col("_nth") - 1).cast("string"))
    return numbered.withColumn(out, F.when(F.col("_nth") > 1, named).otherwise(F.col(record))).select(*df.columns, out)


def row_index_ids(df: DataFrame, dataset: str, position: str, out: str) -> DataFrame:
    """0-based index of the row within its dataset, as text."""
    numbered = grouped_row_number(df, [dataset], position, "_nth")
    return numbered.withColumn(out, (F.col("_nth") - 1).cast("string")).drop("_nth")


def fallback_ids(df: DataFrame, record: Column, position: str, out: str, prefix: str = "phmsa_") -> DataFrame:
    """Rows without an id get the prefix and their 0-based index among all rows."""
    numbered = grouped_row_number(df, [], position, "_nth")
    made = F.concat(F.lit(prefix), (F.col("_nth") - 1).cast("string"))
    return numbered.withColumn(out, F.coalesce(record, made)).drop("_nth")


def sequential_ids(df: DataFrame, block: str, position: str, out: str, prefix: str = "OIL-",
                   digits: int = 5) -> DataFrame:
    """Running numbers over concatenated blocks, in block and source order.

    Rows are counted per block once; a block's numbers start after the rows of
    the blocks before it. The number of blocks is the number of inputs.
    """
    numbered = grouped_row_number(df, [block], position, "_nth")
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("_size"))
    starts = running_totals(sizes, [F.col(block)], {"_upto": "_size"}, "blocks").select(
        block, (F.col("_upto") - F.col("_size")).alias("_start"))
    number = (F.col("_start") + F.col("_nth")).cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(digits)), F.lit("0"))
    return (lookup_join(numbered, starts, [block], F.xxhash64(position))
            .withColumn(out, F.concat(F.lit(prefix), padded)).drop("_nth", "_start"))
