"""Row normalisation, logarithms, tf-idf, z-scores and covariate regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import clip


def row_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("v").alias("total"))


def normalize_total(counts: DataFrame, target_sum: float) -> DataFrame:
    """Scale each cell's values to add up to int(target_sum); cells with a sum of 0 or less stay."""
    scale = F.when(F.col("total") > 0, int(target_sum) / F.col("total")).otherwise(1.0)
    return counts.join(row_sums(counts), "cell").select("cell", "gene", (F.col("v") * scale).alias("v"))


def log1p(counts: DataFrame) -> DataFrame:
    return counts.withColumn("v", F.log1p("v"))


def _tf_idf(counts: DataFrame, n_cells: int, row_weight) -> DataFrame:
    found = counts.groupBy("gene").agg(F.count_if(F.col("v") > 0).alias("found"))
    idf = F.log1p(F.lit(float(n_cells)) / F.col("found"))
    return counts.join(row_sums(counts), "cell").join(found.where("found > 0"), "gene").select("cell", "gene", (F.col("v") * row_weight * idf).alias("v"))


def tf_idf(counts: DataFrame, n_cells: int) -> DataFrame:
    """v / row sum * log(1 + cells / cells with the gene)."""
    return _tf_idf(counts, n_cells, F.lit(1.0) / F.col("total"))


def log_tf_idf(counts: DataFrame, n_cells: int, pseudocount: float = 1e5) -> DataFrame:
    """v * log(1 + pseudocount / row sum) * log(1 + cells / cells with the gene)."""
    return _tf_idf(counts, n_cells, F.log1p(F.lit(float(pseudocount)) / F.col("total")))


def gene_moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """(gene, total, squares, mean, mean_sq, entries) over all cells, zeros included, in one pass."""
    sums = counts.groupBy("gene").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.count_if(F.col("v") > 0).alias("entries"))
    return sums.withColumns({"mean": F.col("total") / n_cells, "mean_sq": F.col("squares") / n_cells})


def scale_parameters(counts: DataFrame, genes: DataFrame, n_cells: int, ddof: int = 0) -> DataFrame:
    """(gene, mean, std) of all `genes`; a gene that does not vary has std 1, so that it scales to 0."""
    m = genes.select("gene").join(gene_moments(counts, n_cells), "gene", "left").na.fill(0.0, ["squares", "mean"])
    variance = F.greatest(F.lit(0.0), F.col("squares") - n_cells * F.col("mean") * F.col("mean")) / max(1, n_cells - ddof)
    std = F.sqrt(variance)
    return m.select("gene", "mean", F.when(std > 1e-12, std).otherwise(1.0).alias("std"))


def scale_rows(dense: DataFrame, parameters: DataFrame, max_value: float = 10.0, zscore: bool = True) -> DataFrame:
    """z-score dense rows (cell, gene, v) by gene and hold them within +-max_value; only the latter without `zscore`."""
    if not zscore:
        return dense.withColumn("v", clip(F.col("v"), -max_value, max_value))
    z = (F.col("v") - F.col("mean")) / F.col("std")
    return dense.join(parameters, "gene").select("cell", "gene", clip(z, -max_value, max_value).alias("v"))


def scale_stored(counts: DataFrame, genes: DataFrame, n_cells: int, max_value: float = 10.0, ddof: int = 0, zscore: bool = True) -> tuple[DataFrame, DataFrame]:
    """What `scale_rows` makes of the dense matrix, at the size of the sparse one: the stored entries (cell, gene, v), and (gene, absent) for each gene's absent ones."""
    parameters = scale_parameters(counts, genes, n_cells, ddof) if zscore else genes.select("gene", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
    absent = clip(-F.col("mean") / F.col("std"), -max_value, max_value)
    return scale_rows(counts, parameters, max_value), parameters.select("gene", absent.alias("absent"))


def scaled_summary(stored: DataFrame, absent: DataFrame, n_cells: int) -> DataFrame:
    """(gene, low, high, total, squares) over all cells, from both tables of `scale_stored`."""
    v = F.col("v")
    of_stored = stored.groupBy("gene").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))
    rows = absent.join(of_stored, "gene", "left").na.fill(0, ["n", "total", "squares"])
    rest = n_cells - F.col("n")
    empty = F.when(rest > 0, F.col("absent"))
    total, squares = F.col("total") + rest * F.col("absent"), F.col("squares") + rest * F.col("absent") * F.col("absent")
    return rows.select("gene", F.least("low", empty).alias("low"), F.greatest("high", empty).alias("high"), total.alias("total"), squares.alias("squares"))


def covariates(counts: DataFrame, cells: DataFrame, flagged: DataFrame) -> DataFrame:
    """(cell, n_counts, percent) for every cell: its sum, and the part of it from the `flagged` genes (gene); 0 for empty cells."""
    marked = counts.join(flagged.select("gene", F.lit(True).alias("flag")), "gene", "left")
    sums = marked.groupBy("cell").agg(F.sum("v").alias("n_counts"), F.sum(F.when(F.col("flag"), F.col("v")).otherwise(0.0)).alias("part"))
    percent = F.when(F.col("n_counts") != 0, F.col("part") / F.col("n_counts")).otherwise(0.0)
    return cells.select("cell").join(sums, "cell", "left").select("cell", F.coalesce("n_counts", F.lit(0.0)).alias("n_counts"), percent.alias("percent"))


def regression_coefficients(counts: DataFrame, genes: DataFrame, covariate_rows: DataFrame) -> DataFrame:
    """(gene, b0, b1, b2, squares, explained): each gene's least-squares fit on 1, n_counts and percent over all cells.

    The normal equations need six sums over the cells, the same for all genes, and three sums
    over each gene's stored entries; the matrix is never densified. Collinear covariates get the
    fit of least norm.
    """
    x, p = F.col("n_counts"), F.col("percent")
    g = covariate_rows.agg(F.count("*"), F.sum(x), F.sum(p), F.sum(x * x), F.sum(x * p), F.sum(p * p)).first()
    n, sx, sp, sxx, sxp, spp = (float(v or 0) for v in g)
    inverse = np.linalg.pinv(np.array([[n, sx, sp], [sx, sxx, sxp], [sp, sxp, spp]]))
    v = F.col("v")
    sums = counts.join(covariate_rows, "cell").groupBy("gene").agg(F.sum(v).alias("y0"), F.sum(v * x).alias("y1"), F.sum(v * p).alias("y2"), F.sum(v * v).alias("squares"))
    full = genes.select("gene").join(sums, "gene", "left").na.fill(0.0)
    y = [F.col(f"y{k}") for k in range(3)]
    b = [sum((float(inverse[k, j]) * y[j] for j in range(1, 3)), float(inverse[k, 0]) * y[0]) for k in range(3)]
    fitted = full.select("gene", "squares", *y, *(b[k].alias(f"b{k}") for k in range(3)))
    return fitted.select("gene", "b0", "b1", "b2", "squares", (F.col("b0") * y[0] + F.col("b1") * y[1] + F.col("b2") * y[2]).alias("explained"))


def residuals(counts: DataFrame, cells: DataFrame, genes: DataFrame, covariate_rows: DataFrame) -> DataFrame:
    """(cell, gene, v): what the covariates do not explain, for every cell and every one of the chosen genes."""
    from cellweave.operators.filters import densify

    fit = regression_coefficients(counts.join(genes.select("gene"), "gene", "left_semi"), genes, covariate_rows).select("gene", "b0", "b1", "b2")
    rows = densify(counts, cells, genes).join(covariate_rows, "cell").join(fit, "gene")
    return rows.select("cell", "gene", (F.col("v") - F.col("b0") - F.col("b1") * F.col("n_counts") - F.col("b2") * F.col("percent")).alias("v"))


def residual_sums(counts: DataFrame, genes: DataFrame, covariate_rows: DataFrame) -> DataFrame:
    """(cell, total, squares): sums over all genes of each cell's `residuals`, from its stored entries alone.

    What the covariates explain of all genes together needs the sums of the coefficients and of
    their products, nine numbers in all, since it is linear in a cell's covariates.
    """
    counts = counts.join(genes.select("gene"), "gene", "left_semi")
    fit = regression_coefficients(counts, genes, covariate_rows).select("gene", "b0", "b1", "b2")
    names, pairs = ["b0", "b1", "b2"], [(j, k) for j in range(3) for k in range(j, 3)]
    sums = fit.agg(*(F.sum(b) for b in names), *(F.sum(F.col(names[j]) * F.col(names[k])) for j, k in pairs)).first()
    x = [F.lit(1.0), F.col("n_counts"), F.col("percent")]
    add = lambda terms: reduce(lambda a, b: a + b, terms)
    level = add(float(sums[k] or 0) * x[k] for k in range(3))
    explained = add(float(sums[3 + i] or 0) * (1 if j == k else 2) * x[j] * x[k] for i, (j, k) in enumerate(pairs))
    v = F.col("v")
    own = counts.join(fit, "gene").groupBy("cell").agg(F.sum(v).alias("y"), F.sum(v * v).alias("yy"), *(F.sum(v * F.col(b)).alias(f"y_{b}") for b in names))
    rows = covariate_rows.join(own, "cell", "left").na.fill(0.0)
    both = add(F.col(f"y_{b}") * x[k] for k, b in enumerate(names))
    return rows.select("cell", (F.col("y") - level).alias("total"), (F.col("yy") - 2 * both + explained).alias("squares"))
