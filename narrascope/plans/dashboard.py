"""All dashboard tiles from one pass over the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.reporting import exclude_seed, shown_status

TILES = ("status", "life_saving_rule", "site", "activity")


def dashboard_cube(reports: DataFrame) -> DataFrame:
    """Counts for every tile in one scan: (tile, value, total, sif_count, critical_open).

    The rows are first combined over all tile columns, so the grouping sets
    multiply that summary and not the reports.
    """
    def counted(value: Column, name: str) -> Column:
        return F.sum(value).alias(name)

    one = F.lit(1)
    base = (exclude_seed(reports).withColumn("status", shown_status(F.col("status")))
            .groupBy(*TILES).agg(
                F.count(one).alias("total"), F.count_if(F.col("sif_potential") == "Yes").alias("sif_count"),
                F.count_if((F.col("critical") == 1) & (F.col("status") != "Closed")).alias("critical_open")))
    entries = F.array(F.struct(F.lit("all").alias("tile"), F.lit(None).cast("string").alias("value")), *[
        F.struct(F.lit(name).alias("tile"), F.col(name).alias("value")) for name in TILES])
    long = base.select(F.explode(entries).alias("e"), "total", "sif_count", "critical_open")
    return long.groupBy("e.tile", "e.value").agg(
        counted(F.col("total"), "total"), counted(F.col("sif_count"), "sif_count"),
        counted(F.col("critical_open"), "critical_open"))
