"""Positions within a workspace, for tables that come without an ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.session import store


def with_ordinals(listing: DataFrame) -> DataFrame:
    """Adds ``ordinal``: 1, 2, 3 … by path within each workspace.

    A window over the workspace would sort a whole workspace in one task. Here the
    listing is range-partitioned over (workspace, path), numbered inside each range,
    and shifted by the row counts of the ranges before it, of which there are only as
    many as partitions. The ranges are written out first, because they come from a
    sample and both uses must see the same ones. Give it a listing without contents.
    """
    ranged = listing.repartitionByRange("workspace", "path").withColumn("_range", F.spark_partition_id())
    ranged = store(ranged, "ranges")
    inside = Window.partitionBy("workspace", "_range").orderBy("path")
    before = (
        Window.partitionBy("workspace").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        ranged.groupBy("workspace", "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col("workspace").alias("_of"),
            F.col("_range").alias("_in"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        )
    )
    # A missing workspace is one of its own, so the names are compared null-safely.
    return (
        ranged.withColumn("_at", F.row_number().over(inside))
        .join(shifts, F.col("workspace").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
        .withColumn("ordinal", (F.col("_at") + F.col("_shift")).cast("bigint"))
        .drop("_at", "_shift", "_range", "_of", "_in")
    )
