"""Running totals over a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, store


def running_totals(df: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """For each entry of ``values``, column to column, add the second: the sum of the first over
    the rows before a row, within ``by``, by ``order``.

    Rows are range-partitioned and stored with their partition's number; one sum a
    partition (and key of ``by``) gives each partition its offset, and a window inside the
    partition does the rest. No task sees more than one range. A key of ``by`` with a third
    of all rows spreads over a third of the ranges. Rows equal in all of ``order`` count
    one after another in any order. Nulls sort first; null values count 0; an empty input
    gives an empty result.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    ranged = store(df.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()), "range")
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"_sum_{out}") for v, out in values.items()])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{out}").over(ahead), F.lit(0)).alias(f"_offset_{out}") for out in values.values()])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = {out: F.col(f"_offset_{out}") + F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside), F.lit(0)) for v, out in values.items()}
    return ranged.join(offsets, [*by, "_range"]).withColumns(total).drop("_range", *[f"_offset_{out}" for out in values.values()])


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "before") -> DataFrame:
    """``running_totals`` of one column."""
    return running_totals(df, by, order, {value: out})
