"""Preprocessing of entries that arrive in batches: available-now runs over a growing folder, each with its state kept by key."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.lineage import scratch_folder
from cellweave.model import COUNTS
from cellweave.operators.variable import highly_variable_of
from cellweave.streaming.running import moments, running_gene_sums


def settled(stream: DataFrame, folder: str) -> DataFrame:
    """What a streaming aggregate holds after all that is there by now; each batch writes its table, and the last one's is read.

    The state and the offsets are in `folder`, so a run that was stopped goes on where it was, and one
    started again after more files have arrived takes in these only.
    """

    def keep(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}")

    run = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    run.awaitTermination()
    spark = stream.sparkSession
    try:
        tables = spark.read.parquet(f"{folder}/table")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    last = tables.agg(F.max("batch")).first()[0]
    return tables.where(F.col("batch") == last).drop("batch") if last is not None else spark.createDataFrame([], stream.schema)


@dataclass(frozen=True)
class Arrived:
    """The cells and genes that fit after the batches so far, and the genes' moments."""

    cells: DataFrame
    genes: DataFrame
    n_cells: int
    n_genes: int
    moments: DataFrame


def preprocess_batches(spark: SparkSession, path: str, min_genes: int, max_genes: int, least: float = 1.0, target_sum: float = 1e4, files: int = 1, folder: str | None = None) -> Arrived:
    """Cells and genes filtered, and moments of the logarithms of normalised values, of entries (cell, gene, v) in files under `path`.

    A cell's entries may come in several batches of `files` files: its number of genes is a running
    count, its sum a running sum. As a cell fits or not only by all its entries, there are four
    runs over the files: cells' genes; sums of genes over the cells that fit; sums of these cells
    over the genes that fit; and the genes' moments. Each joins the stream with the tables of the
    runs before it. With the same `folder` a later call counts cells' genes in files that are new
    only; the other runs start over, as other cells may fit by then. An empty folder of files gives
    empty tables.
    """
    fresh = f"{scratch_folder(spark)}/batches-{uuid.uuid4().hex}"
    arriving = lambda: spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", files).parquet(path)
    degrees = settled(arriving().groupBy("cell").agg(F.count("*").alias("degree")), f"{folder or fresh}/cells")
    fit = degrees.where(F.col("degree").between(min_genes, max_genes)).select("cell")
    genes = settled(arriving().join(fit, "cell", "left_semi").groupBy("gene").agg(F.sum("v").alias("total")), f"{fresh}/genes").where(F.col("total") >= least).select("gene")
    totals = settled(arriving().join(fit, "cell", "left_semi").join(genes, "gene", "left_semi").groupBy("cell").agg(F.sum("v").alias("total")), f"{fresh}/totals")
    scale = F.when(F.col("total") > 0, int(target_sum) / F.col("total")).otherwise(1.0)
    logged = arriving().join(totals, "cell").join(genes, "gene", "left_semi").select("cell", "gene", F.log1p(F.col("v") * scale).alias("v"))
    sums = settled(running_gene_sums(logged), f"{fresh}/moments")
    n_cells, n_genes = totals.count(), genes.count()
    return Arrived(totals.select("cell"), genes, n_cells, n_genes, moments(sums, max(1, n_cells)))


def variable_genes(found: Arrived, n_top: int | None = None) -> DataFrame:
    """What `variable.highly_variable` gives for all entries at once."""
    return highly_variable_of(found.moments, found.genes, found.n_cells, found.n_genes, n_top)
