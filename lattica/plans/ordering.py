"""Global ordinals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.scratch import cut


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ord", base: int = 0) -> DataFrame:
    """Adds ``name`` = base, base + 1, ... in the given total order.

    Rows are range-partitioned; each range numbers its own rows and adds the counts of the
    ranges before it, of which there is one row per range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_local", local).join(offsets, "_range")
    return numbered.withColumn(name, (F.col("_offset") + F.col("_local") - 1 + base).cast("long")).drop("_range", "_offset", "_local")
