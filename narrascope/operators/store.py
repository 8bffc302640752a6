"""A table kept by key in buckets, of which a batch rewrites only those that it touches.

Rows lie in `rows/store_bucket=<hash of the key>/store_version=<commit>`; tables written beside them (audit rows, counts)
in `<name>/store_version=<commit>`. A commit is one small file that names the version of every bucket. It is renamed
into place after all tables of a batch are written, so readers see a batch whole or not at all: what a crashed
batch left is not named by any commit, and the batch run again overwrites it. A batch is known by its run
and number; one that is committed already changes nothing.

A bucket is what one task rewrites; choose their number so that it fits. Rows of a batch are combined by key before they
meet the table, so a key that makes up much of a batch arrives as one row. They are written to the shared folder and not
cached: a cached partition of wide rows is held, and served to other executors, as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType

from narrascope.operators.tables import keyed
from narrascope.session import discard, list_names, read_text, remove_path, write_text, written
from narrascope.schemas import UPSERT_COLUMNS

COMMITS, ROWS, VERSION, BUCKET = "commits", "rows", "store_version", "store_bucket"
# tables to write beside the rows, from the changes (old, new) of a batch
Sides = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass(frozen=True)
class Commit:
    """The version of every bucket, the last batch of every run, and the tables beside the rows."""

    version: int = -1
    buckets: dict[str, int] = field(default_factory=dict)
    runs: dict[str, int] = field(default_factory=dict)
    sides: list[str] = field(default_factory=list)


def nullable(kind: DataType) -> DataType:
    """A type as files give it back: with nulls allowed at every level."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType), True)
    return MapType(nullable(kind.keyType), nullable(kind.valueType), True) if isinstance(kind, MapType) else kind


class KeyedStore:
    """A stored table with one row per key; `replaced` columns are taken from new rows, the others stay as first written.

    With `newest`, a column of the table, a new row counts only if it is not older than the stored one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64,
                 replaced: tuple[str, ...] | None = UPSERT_COLUMNS, newest: str | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), nullable(schema), key
        self.buckets, self.newest = buckets, newest
        names = [f.name for f in schema if f.name != key]
        self.replaced = names if replaced is None else [name for name in names if name in replaced]

    def last_commit(self) -> Commit:
        names = list_names(self.spark, f"{self.path}/{COMMITS}")
        versions = [int(name[:-5]) for name in names if name.endswith(".json")]
        if not versions:
            return Commit()
        return Commit(**json.loads(read_text(self.spark, f"{self.path}/{COMMITS}/{max(versions):012d}.json")))

    def _commit(self, commit: Commit) -> None:
        write_text(self.spark, f"{self.path}/{COMMITS}/{commit.version:012d}.json", json.dumps(asdict(commit)))

    def _read(self, buckets: dict[str, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[
            f"{self.path}/{ROWS}/{BUCKET}={bucket}/{VERSION}={version}" for bucket, version in sorted(buckets.items())])

    def current(self) -> DataFrame:
        """The table as of the last commit."""
        return self._read(self.last_commit().buckets)

    def side(self, name: str, schema: StructType, latest: bool = False) -> DataFrame:
        """A table beside the rows: all committed versions, or the latest one."""
        commit = self.last_commit()
        if name not in commit.sides:
            return self.spark.createDataFrame([], schema)
        if latest:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{VERSION}={commit.version}")
        table = self.spark.read.schema(StructType([*schema.fields, StructField(VERSION, LongType())])).parquet(f"{self.path}/{name}")
        return table.filter(F.col(VERSION) <= commit.version).drop(VERSION)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _combined(self, rows: DataFrame, order: str) -> DataFrame:
        """(bucket, key, first, last) of the rows of a batch, which count as successive by `order`; `first` is null for a key's only row."""
        row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        ranked = keyed(rows, self.key).select(self.key, row.alias("row"), F.struct(
            *([F.col(self.newest)] if self.newest else []), order).alias("place"))
        return ranked.groupBy(self.key).agg(
            F.min_by("row", "place").alias("first"), F.max_by("row", "place").alias("last"), F.count(F.lit(1)).alias("n")).select(
            self._bucket(), self.key, F.when(F.col("n") > 1, F.col("first")).alias("first"), "last")

    def _merged(self, old: DataFrame, fresh: DataFrame) -> DataFrame:
        """(bucket, key, old, new, takes): rows of the touched buckets before and after the batch, and whether it changed them."""
        row = F.struct(*self.schema.names)
        none = F.lit(None).cast(self.schema)
        both = old.select(self._bucket(), self.key, row.alias("old"), none.alias("first"), none.alias("last")).union(
            fresh.select(BUCKET, self.key, none.alias("old"), "first", "last"))
        # keys are unique on either side, so a bucket's rows meet once; the grouping keeps this partitioning
        met = both.repartition(BUCKET).groupBy(BUCKET, self.key).agg(
            F.max_by("old", F.col("old").isNotNull()).alias("old"), F.max_by("first", F.col("first").isNotNull()).alias("first"),
            F.max_by("last", F.col("last").isNotNull()).alias("last"))

        def value(name: str) -> Column:
            if name == self.key:
                return F.col(self.key)
            kept = F.when(F.col("old").isNotNull(), F.col("old")[name]).otherwise(F.coalesce("first", "last")[name])
            return F.when(F.col("takes"), F.col("last")[name]).otherwise(kept) if name in self.replaced else kept

        takes = F.col("last").isNotNull()
        if self.newest:
            takes &= F.col("old").isNull() | F.coalesce(F.col("old")[self.newest] <= F.col("last")[self.newest], F.lit(True))
        decided = met.withColumn("takes", takes)
        return decided.select(BUCKET, self.key, "old", F.struct(*[value(f.name).alias(f.name) for f in self.schema]).alias("new"), "takes")

    def merge(self, rows: DataFrame, order: str, run: str, number: int, sides: Sides | None = None,
              beside: dict[str, DataFrame] | None = None) -> bool:
        """Upsert a batch and write the tables beside it, those of `sides` and `beside`; whether it was new."""
        commit = self.last_commit()
        if commit.runs.get(run, -1) >= number:
            return False
        version = commit.version + 1
        fresh = written(self._combined(rows, order), "fresh")
        merged = None
        try:
            touched = {str(row[0]) for row in fresh.select(BUCKET).distinct().collect()}  # at most the number of buckets
            before = {bucket: v for bucket, v in commit.buckets.items() if bucket in touched}
            merged = self._merged(self._read(before), fresh)
            if sides is not None:
                merged = merged.persist()
            if touched:
                (merged.select(BUCKET, F.lit(version).alias(VERSION), "new.*").write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(f"{self.path}/{ROWS}"))
            tables = dict(beside or {}) | (sides(merged.filter("takes").select("old", "new")) if sides is not None else {})
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{self.path}/{name}/{VERSION}={version}")
        finally:
            if sides is not None and merged is not None:
                merged.unpersist()
            discard(fresh)
        self._commit(Commit(version, commit.buckets | dict.fromkeys(touched, version), commit.runs | {run: number},
                            sorted({*commit.sides, *tables})))
        return True

    def vacuum(self, latest_only: tuple[str, ...] = ()) -> int:
        """Remove bucket versions, commits and tables of which only the latest counts, that the last commit does not name.

        Run it when no reader is at work on an older commit; returns how many folders went.
        """
        commit, gone = self.last_commit(), 0
        keep = {f"{BUCKET}={bucket}/{VERSION}={version}" for bucket, version in commit.buckets.items()}
        keep |= {f"{VERSION}={commit.version}"}
        old = []
        for bucket in list_names(self.spark, f"{self.path}/{ROWS}"):
            if bucket.startswith(BUCKET):
                old += [f"{ROWS}/{bucket}/{v}" for v in list_names(self.spark, f"{self.path}/{ROWS}/{bucket}")
                        if v.startswith(VERSION) and f"{bucket}/{v}" not in keep]
        for name in latest_only:
            old += [f"{name}/{v}" for v in list_names(self.spark, f"{self.path}/{name}") if v.startswith(VERSION) and v not in keep]
        old += [f"{COMMITS}/{c}" for c in list_names(self.spark, f"{self.path}/{COMMITS}") if c != f"{commit.version:012d}.json"]
        for name in old:
            remove_path(self.spark, f"{self.path}/{name}")
            gone += 1
        return gone
