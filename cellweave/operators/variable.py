"""Highly variable genes, by dispersion within bins of the mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.columns import MAD_SCALE, bin_of, ratio
from cellweave.functions.lineage import cut
from cellweave.operators.normalize import gene_moments

#: Percentiles of the means that bound the bins.
PERCENTILES = [p / 100 for p in range(10, 101, 5)]


def normalised_dispersion(moments: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """(gene, mean, dispersion, bin, norm): how far a gene's dispersion is from its bin's median, in scaled MADs; infinite if these are zero and it differs, null if it does not."""
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    variance = (F.col("mean_sq") - mean * mean) * (float(n_genes) / max(1, n_cells - 1))
    spread = cut(moments.select("gene", mean.alias("mean"), (variance / mean).alias("dispersion")))
    edges = spread.agg(F.percentile("mean", F.array(*(F.lit(p) for p in PERCENTILES))).alias("e")).first()["e"] or []
    of_bin = Window.partitionBy("bin")
    binned = spread.withColumn("bin", bin_of(F.col("mean"), edges) if edges else F.lit(0))
    binned = binned.withColumn("median", F.median("dispersion").over(of_bin))
    binned = binned.withColumn("mad", F.median(F.abs(F.col("dispersion") - F.col("median"))).over(of_bin) / MAD_SCALE)
    apart = F.col("dispersion") - F.col("median")
    norm = F.coalesce(ratio(apart, F.col("mad")), F.when(apart > 0, float("inf")).when(apart < 0, float("-inf")))
    return binned.select("gene", "mean", "dispersion", "bin", norm.alias("norm"))


def highly_variable(counts: DataFrame, genes: DataFrame, n_cells: int, n_genes: int, n_top: int | None = None) -> DataFrame:
    """(gene, mean, dispersion, bin, norm, selected): the n_top most dispersed genes (a tenth of all by default), ties included."""
    return highly_variable_of(gene_moments(counts, n_cells), genes, n_cells, n_genes, n_top)


def highly_variable_of(sums: DataFrame, genes: DataFrame, n_cells: int, n_genes: int, n_top: int | None = None) -> DataFrame:
    """`highly_variable` from the genes' moments (gene, mean, mean_sq); a gene without any has zeros."""
    moments = genes.select("gene").join(sums, "gene", "left").na.fill(0.0, ["mean", "mean_sq"])
    found = cut(normalised_dispersion(moments, n_cells, n_genes))
    n_top = max(1, n_top if n_top is not None else n_genes // 10)
    last = found.where("norm is not null").orderBy(F.desc("norm")).select("norm").limit(n_top).agg(F.min("norm")).first()[0]
    chosen = F.coalesce("norm", F.lit(0.0)) >= (last if last is not None else float("inf"))
    return found.withColumn("selected", chosen)
