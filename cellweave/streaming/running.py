"""Sums that grow as batches of cells arrive, in place of loops over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_gene_sums(entries: DataFrame) -> DataFrame:
    """(gene, total, squares, entries) of a stream of matrix entries (cell, gene, v), for the complete or update mode.

    Whole cells must arrive together only if they are filtered or normalised before.
    """
    return entries.groupBy("gene").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.count_if(F.col("v") > 0).alias("entries"))


def moments(sums: DataFrame, n_cells: int) -> DataFrame:
    """The moments that `gene_moments` gives for a whole table, from running sums."""
    return sums.withColumns({"mean": F.col("total") / n_cells, "mean_sq": F.col("squares") / n_cells})
