"""The data model: long count tables with cell and gene dimensions, and fragment tables.

A matrix is a DataFrame (cell, gene, v) of stored entries; an absent entry is zero. Cells and
genes are dimension tables, so that means, densities and empty rows use their cardinality.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("gene", T.LongType()), T.StructField("v", T.DoubleType())])
CELLS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("barcode", T.StringType())])
GENES = T.StructType([T.StructField("gene", T.LongType()), T.StructField("name", T.StringType())])
FRAGMENTS = T.StructType(
    [T.StructField("chrom", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("duplicate", T.IntegerType())]
)

#: Genes with known places for the interval queries: name, chromosome, start, end, strand.
MARKER_INTERVALS = [
    ("m1", "R", 1200, 1230, "fwd"),
    ("m2", "R", 1400, 1460, "rev"),
    ("m3", "A", 300, 310, "rev"),
    ("m4", "A", 900, 1000, "fwd"),
    ("m5", "N", 50, 60, "fwd"),
    ("m6", "N", 2000, 2100, "rev"),
]
EPOCH = "1995-01-01"


@dataclass(frozen=True)
class Dataset:
    """A matrix with its dimensions and whatever has been derived from it."""

    cells: DataFrame
    genes: DataFrame
    counts: DataFrame
    embeddings: dict[str, DataFrame] = field(default_factory=dict)
    graph: DataFrame | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)

    def having(self, **changes) -> Dataset:
        return replace(self, **changes)

    def shape(self) -> tuple[int, int]:
        """Numbers of cells and genes, from the dimension tables."""
        return self.cells.count(), self.genes.count()

    def nnz(self) -> int:
        return self.counts.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer (cell) bought of each part (gene)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("gene"), "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("cell", "gene").agg(F.sum("l_quantity").cast("double").alias("v"))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_name").alias("barcode"), F.col("c_mktsegment").alias("cluster"))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("name"))
    return Dataset(cells, genes, counts_view(spark, sf_dir))


def fragments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments (chrom, start, end, cell): order to shipping day, where shipping came later."""
    day = lambda c: F.datediff(F.to_date(c), F.lit(EPOCH)).cast("int")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"), day("o_orderdate").alias("start"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("chrom"), day("l_shipdate").alias("end"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where(F.col("end") > F.col("start")).select("chrom", "start", "end", "cell")


def marker_intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKER_INTERVALS, "gene string, chrom string, start int, end int, strand string")


def embedding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors (cell, vec, cluster) in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("cluster"))
