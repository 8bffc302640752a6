"""Shuffling a table into shards by a two-pass external shuffle.

Pass 1 scatters the records with a seeded hash into buckets that fit into memory.
Pass 2 puts each bucket into a fixed order, permutes it by a Fisher-Yates shuffle
seeded with the bucket, and writes its records: the position in the whole
shuffled table is the bucket's offset plus the place inside it. Consecutive
positions go to the shards in turn, so the shards' row counts differ by at most one
and slots have no gaps.

Rows that agree in everything share a hash. If they are many, their place in the
input joins the hash, so even one repeated row that makes up a third of the table
spreads over all buckets.

Defined cases: a null text has no bytes and the crc32 of an empty text; null ids
are records like others; rows that repeat are all kept; column names are free, since a row is carried as one struct; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from narrascope.llm.common import written
from narrascope.operators.ordering import running_totals

SEED = 97
SHARDS = 24
BUCKET_ROWS = 100_000
BUCKET_BYTES = 64 << 20
OVERHEAD = 8  # bytes of a record besides its text


def bucket_count(rows: int, size: int) -> int:
    """Buckets that are half full on average, so that chance does not carry one beyond its bound."""
    return max(1, -(-2 * rows // BUCKET_ROWS), -(-2 * size // BUCKET_BYTES))


def permuted(table: pa.Table, before: int, shards: int, seed: int) -> pa.Table:
    """A bucket's records with shard and slot, dealt by a seeded Fisher-Yates shuffle of a fixed order, in the order of both."""
    table = table.sort_by([("hash", "ascending"), ("spread", "ascending")])
    place = np.arange(table.num_rows)
    np.random.Generator(np.random.PCG64([seed, table.column("bucket")[0].as_py()])).shuffle(place)
    position = before + place
    dealt = pa.table({"record": table.column("record"), "shard": pa.array((position % shards).astype(np.int32)),
                      "slot": pa.array(position // shards)})
    return dealt.take(pa.array(np.lexsort((position // shards, position % shards))))


def shuffled(records: DataFrame, size: Column, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(record, shard, slot): one random order of the table, dealt to the shards; record holds all columns of a row.

    `size` is a record's bytes in memory; map columns are not supported. The records are read several
    times and must be the same each time: a table, or what `written` returns.
    """
    plain = records.select(F.struct("*").alias("record"), size.cast("bigint").alias("bytes"))
    keyed = plain.select("record", "bytes", F.xxhash64(F.lit(seed), "record").alias("hash"),
                         F.monotonically_increasing_id().alias("spread"))
    # at most 8 * rows / BUCKET_ROWS hashes are that frequent
    hot = written(keyed.groupBy("hash").count().filter(F.col("count") > BUCKET_ROWS // 8)
                  .select("hash", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():  # their buckets follow from the place in the input, which must not change
        keyed = written(keyed, "records")
    rows, volume = keyed.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    buckets = bucket_count(rows, volume or 0)
    dealt = F.when(F.col("hot"), F.xxhash64(F.lit(seed), "hash", "spread")).otherwise(F.col("hash"))
    bucket = F.pmod(F.shiftright(dealt, 8), F.lit(buckets)).cast("bigint").alias("bucket")
    scattered = keyed.join(F.broadcast(hot), "hash", "left").select("record", "hash", "spread", bucket)
    counts = written(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), "buckets")
    before = written(running_totals(counts, [F.col("bucket")], {"upto": "rows"}, "bucket-totals").select(
        "bucket", (F.col("upto") - F.col("rows")).alias("before")), "offsets")
    result = StructType([StructField("record", plain.schema["record"].dataType), StructField("shard", IntegerType()),
                         StructField("slot", LongType())])
    # a bucket's offset meets its records in the group; there is one of each
    return scattered.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(
        lambda table, offset: permuted(table, offset.column("before")[0].as_py(), shards, seed), result)


def write_shards(records: DataFrame, size: Column, path: str, **how) -> DataFrame:
    """Write the shuffled records under `path`, one folder per shard, in slot order inside its files; returns the table.

    Texts are shuffled once: a bucket's places are one stretch of the whole order, so every task writes its own buckets' records.
    """
    dealt = shuffled(records, size, **how)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    stored = StructType([*[f for f in dealt.schema if f.name != "shard"], dealt.schema["shard"]])
    return records.sparkSession.read.schema(stored).parquet(path)


def record_bytes(text_col: str = "text") -> Column:
    """Bytes of a record: its text plus the overhead."""
    return (F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + OVERHEAD).cast("bigint")
