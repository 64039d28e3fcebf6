"""Numbers and sums along an order, with no task that holds a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.lineage import cut


def running_sums(df: DataFrame, values: Mapping[str, Column], order: Sequence[Column | str], within: Sequence[str] = ()) -> DataFrame:
    """`df` with the sum of each of `values`, by its name, over the rows up to each one in the given order, its own included; within each group of `within`.

    Rows are dealt to ranges of the order, each range is summed in its own task, and the sums of
    the ranges before it are added. The ranges are cut first: they come from a sample, and ranges
    found twice could differ.
    """
    ranged = cut(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *within).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in enumerate(values.values())))
    ahead = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_range"), *(F.col(w).alias(f"_{w}") for w in within), *(F.coalesce(F.sum(f"_sum_{k}").over(ahead), F.lit(0)).alias(f"_before_{k}") for k in range(len(values))))
    met = F.col("_part") == F.col("_range")
    for w in within:
        met = met & F.col(w).eqNullSafe(F.col(f"_{w}"))
    own = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(before, met).select(*df.columns, *((F.col(f"_before_{k}") + F.sum(v).over(own)).alias(name) for k, (name, v) in enumerate(values.items())))


def running_sum(df: DataFrame, value: Column | str, order: Sequence[Column | str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """`running_sums` of one value."""
    return running_sums(df, {name: F.col(value) if isinstance(value, str) else value}, order, within)


def row_numbers(df: DataFrame, order: Sequence[Column | str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """`df` with its rows' numbers 0, 1, ... in the given order, within each group of `within`."""
    return running_sum(df, F.lit(1), order, name, within).withColumn(name, (F.col(name) - 1).cast("long"))
