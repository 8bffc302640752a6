"""Small helpers that the operators of this package share.

Word rule of all operators: a word is a run of `[^\\x20\\x09-\\x0D]`, which is what
`bytes.split()` returns for UTF-8 text, and `bytes.lower()` changes A-Z only.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.session import written  # noqa: F401  (re-exported to the operators)

WORD = r"[^\x20\x09-\x0D]+"
ROWS_AT_ONCE = 500  # rows with whole texts in an Arrow batch
BYTES_AT_ONCE = 4 << 20  # bytes of an Arrow batch after which no further row is put into it
TEXTS_AT_ONCE = 256  # texts of a batch that are Python values at a time
SPLIT_AT_ONCE = 1 << 20  # bytes of texts that are cut into words at a time; a word as a Python value takes about nine times its bytes
BIT_ROWS = 1 << 19  # most rows of a bit table, 64 bits each; this bounds what is broadcast
LARGEST_KEYS = 1 << 23  # keys up to which a bit table is used
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower` alone would change other letters too.

    A text without multi-byte characters takes the fast built-in path.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a batch as UTF-8 bytes, some at a time; null counts as empty."""
    column = batch.column(name)
    for start in range(0, len(column), TEXTS_AT_ONCE):
        for value in column.slice(start, TEXTS_AT_ONCE).cast(pa.binary()).to_pylist():
            yield value or b""


def parts_of_bytes(values: Iterable[bytes], rows: int = TEXTS_AT_ONCE, size: int = SPLIT_AT_ONCE) -> Iterator[list[bytes]]:
    """Consecutive values in lists of at most `rows`, closed once they hold `size` bytes."""
    part, held = [], 0
    for value in values:
        part.append(value)
        held += len(value)
        if len(part) >= rows or held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand ROWS_AT_ONCE rows or about BYTES_AT_ONCE at a time to Python: a batch of whole texts is held several times, in
    the JVM and in the worker, and tables in the order of their sizes have batches of long texts only. Never raises a setting."""
    for key, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Give freed memory back at the end of a task, since its worker serves the next stage beside a grown heap of the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a batch function over a table; `make` builds its state once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        del step
        release_memory()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def without(docs: DataFrame, keys: dict[str, Column], losers: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose keys are not among the losers; of rows that repeat a key in `repeated`, one stays.

    Both tables hold the columns named in `keys`, null-safe. A bit table of their keys leaves nearly all other rows
    where they are read; only rows that may be in them are written and joined, whose large side Spark may split. No
    wide row is gathered by key, except that repeated rows meet after a partial pick in their own task.
    """
    names = list(keys)
    code = F.xxhash64(*names)
    wrapped = docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in keys.items()])
    decided = losers.select(*names).union(repeated.select(*names))
    marked = marked_in(wrapped.withColumn("_code", code), "_code", key_filter(decided.select(code.alias("_code")), "_code", "decided"), "_maybe")
    some = written(marked.filter("_maybe").drop("_code", "_maybe"), "maybe")

    def matched(other: DataFrame, how: str) -> DataFrame:
        other = other.select(*[F.col(n).alias(f"_o_{n}") for n in names])
        same = [some[n].eqNullSafe(other[f"_o_{n}"]) for n in names]
        return some.join(other, same, how)

    main = marked.filter(~F.col("_maybe")).select("_row.*").union(matched(decided, "left_anti").select("_row.*"))
    again = matched(repeated, "left_semi").dropDuplicates(names).select("_row.*")
    return main.union(again)


@dataclass(frozen=True)
class KeyFilter:
    """What is known of a set of 64-bit keys without moving the rows that may hold them: a bit table, or the keys themselves."""

    keys: DataFrame
    bits: DataFrame | None
    rows: int

    def word(self, key: Column) -> Column:
        return F.shiftright(key, 6).bitwiseAND(F.lit(self.rows - 1))

    def held(self, name: str) -> Column:
        """Whether the key's bit is set, beside a row of the bit table (null without one)."""
        return F.expr(f"(bits & shiftleft(1L, cast({name} & 63L as int))) <> 0")


def key_filter(keys: DataFrame, name: str, label: str = "bits") -> KeyFilter:
    """A filter of a column of 64-bit keys, sized by their number: 16 bits or more a key while the table
    has at most BIT_ROWS rows. Beyond LARGEST_KEYS keys a bit table would let most rows through, so there is none."""
    found = written(keys.select(name).filter(F.col(name).isNotNull()).distinct(), f"{label}-keys")
    count = found.count()
    if count > LARGEST_KEYS:
        return KeyFilter(found, None, 0)
    rows = min(BIT_ROWS, 1 << max(10, (count // 4).bit_length()))
    table = KeyFilter(found, None, rows)
    bits = found.groupBy(table.word(F.col(name)).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63L as int))")).alias("bits"))
    return KeyFilter(found, written(bits, label), rows)


def maybe_in(rows: DataFrame, name: str, keys: KeyFilter) -> DataFrame:
    """Rows whose key may be in the set; no row that is in it is lost, and beyond LARGEST_KEYS none else is left."""
    if keys.bits is None:
        return rows.join(keys.keys.select(F.col(keys.keys.columns[0]).alias(name)), name, "left_semi")
    return rows.join(F.broadcast(keys.bits), (keys.word(F.col(name)) == F.col("word")) & keys.held(name), "left_semi")


def marked_in(rows: DataFrame, name: str, keys: KeyFilter, mark: str) -> DataFrame:
    """All rows with a mark: whether the key may be in the set (always, without a bit table). Rows are not moved."""
    if keys.bits is None:
        return rows.withColumn(mark, F.lit(True))
    beside = rows.join(F.broadcast(keys.bits), keys.word(F.col(name)) == F.col("word"), "left")
    return beside.withColumn(mark, F.coalesce(keys.held(name), F.lit(False))).drop("word", "bits")
