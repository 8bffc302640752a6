"""CSV readers that tolerate mixed encodings and drifting headers, and sinks."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.operators.ordering import grouped_row_number
from narrascope.operators.skew import lookup_join
from narrascope.schemas import strings
from narrascope.session import local_table, written

FALLBACK_ENCODING = "ISO-8859-1"
FILE = "_file"
POSITION = "_position"
SPLIT = "split"
SURPLUS = "_surplus"  # first field beyond the header
# a row's number within its task is the low part of its increasing id
IN_TASK = (1 << 33) - 1


def file_name() -> Column:
    """The path of a row's file; the metadata column holds it URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path whose brackets, braces, stars and question marks are not read as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def file_profile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header, is_utf8) of every text file, in one splittable scan.

    Lines are tested as raw bytes, so file size is not limited by memory; the
    header is the first line of the first split.
    """
    lines = spark.read.text(paths).select(
        file_name().alias(FILE),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        "value")
    return lines.groupBy(FILE).agg(
        F.min_by(F.col("value").cast("binary"), "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"))


def _columns(header: bytes, is_utf8: bool, fallback: str) -> tuple[str, ...]:
    line = bytes(header).decode("utf-8" if is_utf8 else fallback)
    names = next(csv.reader(io.StringIO(line.lstrip("\ufeff").rstrip("\r"))), [])
    return tuple(name.strip() for name in names)


def _read_group(spark: SparkSession, files: list[str], names: tuple[str, ...], encoding: str,
                multiline: bool) -> DataFrame:
    """Lines of files with one header; SURPLUS is set on lines with more fields than it has."""
    rows = (spark.read.schema(strings(*names, SURPLUS)).options(
        header=True, enforceSchema=True, escape='"', mode="PERMISSIVE", encoding=encoding,
        multiLine=multiline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv([literal_path(file) for file in files]))
    return rows.select(
        "*", file_name().alias(FILE), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK)).alias("_at"))


def _records(lines: DataFrame) -> DataFrame:
    """(FILE, POSITION, record): lines of POSITION folded to records, since a field in quotes may hold line breaks.

    A line with an odd number of quotes opens or closes such a field, in turn within its file. Only these lines are
    numbered, narrow; the lines between an opening and its closing one are looked up by their number and joined.
    Other lines are records as they are and stay where they are read while the others fit a broadcast. A quote that
    is never closed ends with its line.
    """
    odd = lines.filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    toggles = grouped_row_number(written(odd.select(FILE, POSITION), "quotes"), [FILE], POSITION, "_nth")
    spans = toggles.groupBy(FILE, F.floor((F.col("_nth") + 1) / 2).alias("_k")).agg(
        F.min(POSITION).alias("_from"), F.max(POSITION).alias("_to")).filter("_from < _to")
    inner = written(spans.select("_from", F.explode(F.sequence("_from", "_to")).alias(POSITION)), "spans")
    placed = lookup_join(lines, inner, [POSITION], F.col(POSITION))
    folded = placed.filter(F.col("_from").isNotNull()).groupBy(FILE, "_from").agg(
        F.sort_array(F.collect_list(F.struct(POSITION, "value"))).alias("_lines"))
    return placed.filter(F.col("_from").isNull()).select(FILE, POSITION, F.col("value").alias("record")).union(
        folded.select(FILE, F.col("_from").alias(POSITION), F.array_join(F.col("_lines.value"), "\n").alias("record")))


def _read_split(spark: SparkSession, files: list[str], names: tuple[str, ...], encoding: str) -> DataFrame:
    """As `_read_group` for fields with line breaks, with every file read in many tasks; POSITION is the line's number."""
    text = F.decode(F.col("value").cast("binary"), encoding).alias("value")
    lines = spark.read.text([literal_path(file) for file in files]).select(
        text, file_name().alias(FILE), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK)).alias("_at"))
    records = _records(_numbered(lines).select(FILE, POSITION, "value"))
    heads = records.groupBy(FILE).agg(F.min(POSITION).alias("_head"))  # a row per file
    rows = lookup_join(records, heads, [FILE], F.col(POSITION)).filter((F.col(POSITION) > F.col("_head")) & (F.trim("record") != ""))
    schema = strings(*names, SURPLUS)
    parsed = rows.select(F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema), {
        "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("_row"), FILE, POSITION)
    return parsed.select("_row.*", FILE, POSITION)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a dense 0-based position in the order of file name, block and line.

    A block is read by one task from its first line to its last, so a row's number in
    its block is its number in the task less that of the block's first row. Only
    (file, block, count) is gathered; rows are neither sorted nor shuffled while the
    blocks fit a broadcast.
    """
    blocks = written(rows.groupBy(FILE, "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "file-blocks")
    # one row per file, then one per block of a file
    per_file = blocks.groupBy(FILE).agg(F.sum("_n").alias("_rows"))
    before = W.orderBy(FILE).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(FILE).orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    files = per_file.select(FILE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_files"))
    offsets = blocks.join(files, FILE).select(
        FILE, "_start", (F.col("_files") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) - F.col("_first")).alias("_offset"))
    placed = lookup_join(rows, written(offsets, "file-offsets"), [FILE, "_start"], F.col("_at"))
    return placed.withColumn(POSITION, F.col("_offset") + F.col("_at")).drop("_offset")


def _rows(parts: list[DataFrame], position: bool) -> DataFrame:
    """The kept lines of all groups of files."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    if position:
        result = _numbered(result)
    return result.filter(F.col(SURPLUS).isNull()).drop(SURPLUS, "_start", "_at")


def _groups(spark: SparkSession, paths: list[str], fallback: str) -> dict[tuple, list[str]]:
    """Files by (header, encoding): one row per file reaches the driver, as in any file listing."""
    groups: dict[tuple, list[str]] = {}
    for row in file_profile(spark, paths).toLocalIterator():
        names = _columns(row["header"], row["is_utf8"], fallback)
        groups.setdefault((names, "UTF-8" if row["is_utf8"] else fallback), []).append(row[FILE])
    return groups


def read_csv_robust(spark: SparkSession, paths: list[str], fallback: str = FALLBACK_ENCODING,
                    multiline: bool | str = True, position: bool = False) -> DataFrame:
    """CSV files with a header, each read in UTF-8 or the fallback encoding.

    Columns are strings; files may differ in columns. A line with fewer fields than
    the header has nulls in the others; a line with a value beyond the header is
    skipped (`surplus_lines` counts them). `position` adds the line's place among all
    lines, in the order of file names, which the source mappers number rows by.
    `multiline` True reads a file in one task; "split" reads files with line breaks inside
    fields in many tasks (all files of a header and encoding are numbered together); False is for files without such fields.
    """
    groups = sorted(_groups(spark, paths, fallback).items())
    if not groups:
        raise FileNotFoundError(", ".join(paths))
    if multiline == SPLIT:
        parts = [_read_split(spark, files, names, encoding) for (names, encoding), files in groups]
        return _split_rows(parts, position)
    return _rows([_read_group(spark, files, names, encoding, multiline)
                  for (names, encoding), files in groups], position)


def _split_rows(parts: list[DataFrame], position: bool) -> DataFrame:
    """The kept records of all groups of files; positions are dense over file names and lines."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    kept = result.filter(F.col(SURPLUS).isNull()).drop(SURPLUS)
    if not position:
        return kept.drop(POSITION)
    if len(parts) > 1:  # lines were numbered by group, so files come first
        files = kept.select(FILE, POSITION).groupBy(FILE).agg(F.max(POSITION).alias("_last"))
        base = files.select(FILE, F.coalesce(F.sum(F.col("_last") + 1).over(W.orderBy(FILE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        kept = lookup_join(kept, written(base, "file-bases"), [FILE], F.col(POSITION)).withColumn(POSITION, F.col("_base") + F.col(POSITION)).drop("_base")
    numbered = grouped_row_number(kept, [], POSITION, "_dense")
    return numbered.withColumn(POSITION, F.col("_dense") - 1).drop("_dense")


def surplus_lines(spark: SparkSession, paths: list[str], fallback: str = FALLBACK_ENCODING,
                  multiline: bool = True) -> DataFrame:
    """(file, lines): lines that the readers skip because a value lies beyond the header."""
    counted = local_table(spark, [], "file string, lines bigint")
    for (names, encoding), files in sorted(_groups(spark, paths, fallback).items()):
        part = _read_group(spark, files, names, encoding, multiline).filter(F.col(SURPLUS).isNotNull())
        counted = counted.unionByName(part.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("lines")))
    return counted


def scan_drifting_dir(spark: SparkSession, paths: list[str], required: list[str],
                      fallback: str = FALLBACK_ENCODING, multiline: bool = True,
                      position: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the files that have all required columns, and a report of the others.

    Short and over-long lines and `position` are as in `read_csv_robust`.
    """
    parts, lacking = [], []
    for (names, encoding), files in sorted(_groups(spark, paths, fallback).items()):
        missing = [name for name in required if name not in names]
        if missing:
            lacking += [(file, missing) for file in files]
        else:
            parts.append(_read_group(spark, files, names, encoding, multiline))
    report = local_table(spark, lacking, "file string, missing array<string>")
    return _rows(parts, position) if parts else None, report


def write_csv(df: DataFrame, path: str, quote_all: bool = True, mode: str = "error") -> None:
    """CSV sink, all fields quoted or only where needed."""
    df.write.mode(mode).options(
        header=True, quoteAll=quote_all, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet sink: the default store."""
    df.write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """One folder per split with all columns; readers prune to the split they need."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_clustered(df: DataFrame, path: str, by: list[str], lookups: dict[str, int] | None = None, files: int | None = None,
                    group_bytes: int = 32 << 20, mode: str = "error") -> None:
    """Parquet store for filtered reads: rows in ranges of `by`, sorted in every file, so that a filter on its first
    columns reads few files and row groups. `lookups` names columns that are looked up by single values, with about how
    many different ones a file holds; they get Bloom filters. The number of files defaults to the shuffle partitions.
    """
    writer = (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by).write.mode(mode)
    writer = writer.option("parquet.block.size", group_bytes)
    for name, values in (lookups or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", str(values))
    writer.parquet(path)
