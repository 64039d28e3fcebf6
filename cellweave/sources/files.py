"""Reading and writing matrices, fragments and dense tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.model import CELLS, COUNTS, FRAGMENTS, GENES, Dataset
from cellweave.operators import filters
from cellweave.operators.intervals import fragment_table, region_scan


def write_matrix(data: Dataset, path: str, files: int | None = None) -> None:
    """Write a matrix as three Parquet tables; entries are clustered by cell, so that a range of cells reads few row groups."""
    counts = data.counts.repartitionByRange(files, "cell") if files else data.counts.repartitionByRange("cell")
    counts.sortWithinPartitions("cell", "gene").write.parquet(f"{path}/counts")
    data.cells.write.parquet(f"{path}/cells")
    data.genes.write.parquet(f"{path}/genes")


def read_matrix(spark: SparkSession, path: str, max_cells: int | None = None) -> Dataset:
    """Read what `write_matrix` wrote; with `max_cells` only cells with smaller ids, which the scan skips to."""
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    cells, genes = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/genes")
    if max_cells is not None:
        counts, cells = filters.first_cells(counts, max_cells), cells.where(F.col("cell") < max_cells)
    return Dataset(cells, genes, counts)


def read_with_filter(
    spark: SparkSession,
    path: str,
    min_genes_per_cell: int = 200,
    max_genes_per_cell: int = 6000,
    min_cells: float = 1,
    num_cells: int | None = None,
    post_processor: Callable[[DataFrame], DataFrame] | None = None,
) -> Dataset:
    """Read a matrix, keep cells by their entries, apply `post_processor` to the entries, and keep genes whose values then add up to more than min_cells."""
    data = filters.filter_cells(read_matrix(spark, path, num_cells), min_genes_per_cell, max_genes_per_cell)
    if post_processor is not None:
        data = data.having(counts=data.counts.transform(post_processor))
    return filters.filter_genes(data, min_cells, by="sum_strict")


def dense_to_long(dense: DataFrame, index: str) -> DataFrame:
    """(row, column, v) of the values other than 0 of a table with one index column and a column for each cell."""
    columns = [c for c in dense.columns if c != index]
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))).alias("x")
    return dense.select(F.col(index).cast("string").alias("row"), values).select("row", "x.*").where("v <> 0")


def convert_dense_csv(spark: SparkSession, input_file: str, output_path: str | None = None) -> str:
    """Turn a CSV of genes by cells (a header, and names in the first column) into a matrix of cells by genes; returns where it is."""
    output_path = output_path or f"{input_file}.sparse"
    dense = spark.read.csv(input_file, header=True)
    index = dense.columns[0]
    long = dense_to_long(dense, index)
    genes = filters.reindex(dense.select(F.col(index).cast("string").alias("name")), "name", "gene").select("gene", "name")
    cells = spark.createDataFrame([(i, c) for i, c in enumerate(x for x in dense.columns if x != index)], CELLS)
    counts = long.join(genes, F.col("row") == F.col("name")).join(F.broadcast(cells), F.col("column") == F.col("barcode")).select("cell", "gene", "v")
    write_matrix(Dataset(cells, genes, counts), output_path)
    return output_path


def read_fragments_file(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of a headerless tab-separated file, gzipped or not, dealt out again since gzip can't be split."""
    rows = spark.read.csv(path, sep="\t", schema=FRAGMENTS, header=False, comment="#")
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Only the barcode column of a fragments file; the parser skips the others."""
    return read_fragments_file(spark, path).select("cell")


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Fragments as Parquet in ranges of place, so that a region's scan reads few files and row groups."""
    fragments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.parquet(path)


def read_fragments(fragments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The fragment table of a region: without `duplicate`, with row_num and len."""
    return fragment_table(region_scan(fragments, chrom, start, end))


SCHEMAS: dict[str, T.StructType] = {"counts": COUNTS, "cells": CELLS, "genes": GENES, "fragments": FRAGMENTS}
