"""Choosing cells and genes, and projecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.ordered import row_numbers
from cellweave.model import Dataset


def degrees(counts: DataFrame) -> DataFrame:
    """Stored entries of each cell (cell, degree)."""
    return counts.groupBy("cell").agg(F.count("*").alias("degree"))


def kept_cells(cells: DataFrame, counts: DataFrame, min_genes: int, max_genes: int) -> DataFrame:
    """The cells whose number of stored entries lies in [min_genes, max_genes]; cells without entries have 0."""
    return cells.join(degrees(counts), "cell", "left").where(F.coalesce("degree", F.lit(0)).between(min_genes, max_genes)).drop("degree")


def filter_cells(data: Dataset, min_genes: int, max_genes: int) -> Dataset:
    """Keep cells by their number of stored entries, both bounds included, and their entries."""
    cells = kept_cells(data.cells, data.counts, min_genes, max_genes)
    fit = degrees(data.counts).where(F.col("degree").between(min_genes, max_genes)).select("cell")
    return data.having(cells=cells, counts=data.counts.join(fit, "cell", "left_semi"))


GENE_RULES = {
    "sum": lambda least: F.sum("v") >= least,
    "sum_strict": lambda least: F.sum("v") > least,
    "entries": lambda least: F.count("*") >= least,
}


def kept_genes(counts: DataFrame, least: float, by: str = "sum") -> DataFrame:
    """Genes (gene) by the sum of their values (`sum`, or above it `sum_strict`) or by their stored `entries`."""
    return counts.groupBy("gene").agg(GENE_RULES[by](least).alias("fits")).where("fits").select("gene")


def filter_genes(data: Dataset, least: float, by: str = "sum") -> Dataset:
    kept = kept_genes(data.counts, least, by)
    return subset_genes(data, kept)


def subset_genes(data: Dataset, genes: DataFrame) -> Dataset:
    """Keep the genes of `genes` (gene)."""
    return data.having(genes=data.genes.join(genes.select("gene"), "gene", "left_semi"), counts=data.counts.join(genes.select("gene"), "gene", "left_semi"))


def subset_cells(data: Dataset, cells: DataFrame) -> Dataset:
    """Keep the cells of `cells` (cell), in the matrix and in what was derived from it."""
    keep = cells.select("cell")
    return data.having(
        cells=data.cells.join(keep, "cell", "left_semi"),
        counts=data.counts.join(keep, "cell", "left_semi"),
        embeddings={k: e.join(keep, "cell", "left_semi") for k, e in data.embeddings.items()},
    )


def select_barcodes(data: Dataset, barcodes: list[str] | DataFrame) -> Dataset:
    """Keep the cells with given barcodes: a list of them, or a table (barcode)."""
    if isinstance(barcodes, DataFrame):
        return subset_cells(data, data.cells.join(barcodes.select("barcode"), "barcode", "left_semi"))
    return subset_cells(data, data.cells.where(F.col("barcode").isin(barcodes)))


def first_cells(counts: DataFrame, n: int) -> DataFrame:
    """Entries of the cells with ids below n; the id makes the choice repeatable and reaches the scan."""
    return counts.where(F.col("cell") < n)


def reindex(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Number the rows of a dimension 0, 1, ... in the order of its key."""
    return row_numbers(df, [key], name)


def unique_names(genes: DataFrame) -> DataFrame:
    """Names with a suffix -1, -2, ... from their second occurrence on, in the order of the gene ids.

    A suffix that would give a name that is there already is passed over. Null names stay.
    """
    counted = row_numbers(genes.where("name is not null"), ["gene"], "_again", ("name",))
    parts = [F.regexp_extract("name", "^(.*)-([1-9][0-9]{0,17})$", k) for k in (1, 2)]
    taken = genes.select(parts[0].alias("_base"), parts[1].try_cast("long").alias("_suffix")).where("_suffix is not null").groupBy("_base").agg(F.array_sort(F.collect_set("_suffix")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_again"), lambda x, t: F.when(t <= x, x + 1).otherwise(x))
    name = F.when(F.col("_again") > 0, F.concat_ws("-", "name", free.cast("string"))).otherwise(F.col("name")).alias("name")
    named = counted.join(taken, F.col("name") == F.col("_base"), "left").select(*(name if c == "name" else c for c in genes.columns))
    return named.union(genes.where("name is null"))


def with_prefix(genes: DataFrame, prefix: str) -> DataFrame:
    return genes.where(F.col("name").startswith(prefix))


def densify(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """A row (cell, gene, v) for every cell and every one of the given genes, absent entries being 0.

    Each cell is paired with the genes of the (small, chosen) set; only then are entries looked up.
    """
    wanted = genes.select("gene").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    grid = cells.select("cell").join(F.broadcast(wanted)).select("cell", F.explode("genes").alias("gene"))
    return grid.join(counts, ["cell", "gene"], "left").select("cell", "gene", F.coalesce("v", F.lit(0.0)).alias("v"))


def sparsify(dense: DataFrame) -> DataFrame:
    return dense.where("v <> 0")


def transpose(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("gene").alias("cell"), F.col("cell").alias("gene"), "v")


def marker_expression(counts: DataFrame, cells: DataFrame, markers: dict[str, int]) -> DataFrame:
    """One row a cell with a column <marker>_raw for each marker (name to gene id), zeros filled."""
    wanted = counts.where(F.col("gene").isin(list(markers.values())))
    sums = wanted.groupBy("cell").agg(*(F.sum(F.when(F.col("gene") == g, F.col("v"))).alias(f"{m}_raw") for m, g in markers.items()))
    return cells.select("cell").join(sums, "cell", "left").na.fill(0.0, [f"{m}_raw" for m in markers])


def marker_ids(genes: DataFrame, names: list[str]) -> dict[str, int]:
    """The smallest gene id of each name that there is, in the order of the (short) list."""
    found = {r["name"]: r["gene"] for r in genes.where(F.col("name").isin(names)).groupBy("name").agg(F.min("gene").alias("gene")).collect()}
    return {n: found[n] for n in names if n in found}
