"""The whole analyses: RNA counts, peak counts, and interval coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.lineage import cut, stored
from cellweave.model import Dataset
from cellweave.operators import community, descent, filters, graph, intervals, layout, normalize, reduce, variable


def preprocess(data: Dataset, markers: list[str], min_genes: int = 200, max_genes: int = 6000, min_cells: int = 1, target_sum: float = 1e4, n_top: int | None = None, gene_rule: str = "entries") -> Dataset:
    """Filter cells and genes, normalise, take logarithms, keep markers' values, and choose the variable genes.

    `results` gets `markers` (a column for each) and `variable`; the counts are those of the
    chosen genes. The counts and those of the cells that fit are stored, as each is read several times.
    """
    fit = filters.filter_cells(data.having(counts=stored(data.counts)), min_genes, max_genes)
    kept = filters.filter_genes(fit.having(counts=stored(fit.counts)), min_cells, by=gene_rule)
    logged = stored(normalize.log1p(normalize.normalize_total(kept.counts, target_sum)))
    cells, genes = cut(kept.cells), cut(kept.genes)
    n_cells, n_genes = cells.count(), genes.count()
    values = filters.marker_expression(logged, cells, filters.marker_ids(genes, markers)) if markers else cells.select("cell")
    found = variable.highly_variable(logged, genes, n_cells, n_genes, n_top)
    chosen = found.where("selected").select("gene")
    return filters.subset_genes(data.having(cells=cells, genes=genes, counts=logged), chosen).having(results={"markers": values, "variable": found})


def regress_and_scale(data: Dataset, prefix: str, max_value: float = 10.0, zscore: bool = True) -> DataFrame:
    """Dense rows (cell, gene, v) of the chosen genes without what depth and the prefix genes' share explain, scaled and clipped."""
    flagged = filters.with_prefix(data.genes, prefix)
    covariates = cut(normalize.covariates(data.counts, data.cells, flagged))
    rest = normalize.residuals(data.counts, data.cells, data.genes, covariates)
    if not zscore:
        return normalize.scale_rows(rest, None, max_value, zscore=False)
    n = data.cells.count()
    fit = normalize.regression_coefficients(data.counts, data.genes, covariates)
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("explained")) / max(1, n))
    parameters = fit.select("gene", F.lit(0.0).alias("mean"), F.when(std > 1e-12, std).otherwise(1.0).alias("std"))
    return normalize.scale_rows(rest, parameters, max_value)


def cluster(vectors: DataFrame, n_neighbors: int = 15, n_pcs: int = 50, resolution: float = 1.0, umap_epochs: int = 0, min_dist: float = 0.3, spread: float = 1.0) -> dict[str, DataFrame]:
    """Components, neighbour graph, Louvain and Leiden communities, and a layout if epochs are given, of (cell, vec)."""
    scores = cut(reduce.pca(vectors, n_pcs))
    edges = cut(graph.connectivities(descent.knn_descent(scores, n_neighbors)))
    nodes = scores.select("cell")
    out = {"pca": scores, "graph": edges, "louvain": community.louvain(edges, nodes, resolution), "leiden": community.leiden(edges, nodes, resolution)}
    if umap_epochs:
        out["umap"] = layout.umap(edges, layout.initial_positions(scores), umap_epochs, min_dist, spread)
    return out


def rna(data: Dataset, markers: list[str], prefix: str, k: int = 35, **settings) -> Dataset:
    """From counts to communities; see `preprocess`, `regress_and_scale` and `cluster`."""
    ready = preprocess(data, markers, **settings)
    dense = cut(regress_and_scale(ready, prefix))
    vectors = cut(reduce.dense_vectors(dense, ready.cells, ready.genes))
    found = cluster(vectors)
    found["kmeans"] = reduce.kmeans(found["pca"], k)
    return ready.having(embeddings={"pca": found["pca"]}, graph=found["graph"], results=ready.results | found)


def peaks(data: Dataset, n_top: int, n_neighbors: int = 10, pseudocount: float = 1e3) -> Dataset:
    """Peak counts to communities: log tf-idf, the most frequent peaks, components, graph."""
    n_cells = data.cells.count()
    weighed = cut(normalize.log_tf_idf(data.counts, n_cells, pseudocount))
    chosen = filters.subset_genes(data.having(counts=weighed), intervals.top_peaks(weighed, n_cells, n_top))
    found = cluster(cut(reduce.dense_vectors(chosen.counts, chosen.cells, chosen.genes)), n_neighbors)
    return chosen.having(embeddings={"pca": found["pca"]}, graph=found["graph"], results=found)


def recluster(vectors: DataFrame, cells: DataFrame, n_neighbors: int = 15, n_pcs: int = 50, resolution: float = 1.0, umap_epochs: int = 0) -> dict[str, DataFrame]:
    """`cluster` over a subset of the cells (cell)."""
    return cluster(vectors.join(cells.select("cell"), "cell", "left_semi"), n_neighbors, n_pcs, resolution, umap_epochs)
