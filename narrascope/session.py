"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
# temporary folder per local application, used only where no shared folder is named
_LOCAL: dict[str, str] = {}


def build_session(app: str = "narrascope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    Shuffle partition counts are left to the cluster; AQE coalesces small ones
    and splits skewed ones, so a high initial number is safe.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, since executors cannot see the driver's disk.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="narrascope-")
        atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)  # goes with the process that made it
    return _LOCAL[application]


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or deleted."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df, label: str):
    """Write `df` to the shared folder and read it back.

    Used where a result is read more than once or where row numbering must not
    change if an executor is lost and its partitions are computed again.
    """
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables) -> None:
    """Remove tables that `written` made and that no later result reads."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(where)] if files.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it, so that readers see all of it or nothing."""
    files_of = spark._jvm.org.apache.hadoop.fs.Path
    where, part = files_of(path), files_of(f"{path}.{uuid.uuid4().hex}.part")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if not files.rename(part, where):
        files.delete(part, False)
        raise FileExistsError(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str):
    """A small fixed table as a local relation: no Python job reads it later."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table([pa.array(list(values), to_arrow_type(field.dataType)) for values, field in zip(columns, fields)],
                     names=fields.names)
    return spark.createDataFrame(table, fields)
