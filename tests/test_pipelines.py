import os

import pytest
from pyspark.sql import functions as F

from cellweave.model import Dataset, dataset
from cellweave.plans import catalog, pipelines

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_counts_to_communities(spark):
    found = pipelines.rna(dataset(spark, SF), ["red widget", "blue bolt"], "red", k=4, min_genes=20, max_genes=60)
    cells = found.cells.count()
    assert {k: v.count() for k, v in found.results.items() if k in ("markers", "pca", "louvain", "leiden", "kmeans")} == dict.fromkeys(["markers", "pca", "louvain", "leiden", "kmeans"], cells)
    assert found.results["variable"].where("selected").count() == found.genes.count()
    assert found.graph.where((F.col("weight") <= 0) | (F.col("weight") > 1) | (F.col("src") >= F.col("dst"))).count() == 0


def test_preprocess_reads_the_entries_once(spark):
    """Counts that cost work are not worked out again by each step."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    entries = spark.createDataFrame([(c, g, float(1 + c * g % 7)) for c in range(30) for g in range(c % 5, 40)], "cell long, gene long, v double")
    data = Dataset(spark.range(30).selectExpr("id AS cell", "string(id) AS barcode"), spark.range(40).selectExpr("id AS gene", "string(id) AS name"), entries.mapInArrow(watched, entries.schema))
    ready = pipelines.preprocess(data, ["3"], 20, 60, gene_rule="sum")
    assert ready.counts.count() > 0 and ready.results["variable"].count() == 40
    assert seen.value == entries.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_batches_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """`hvg_batches` writes and reads each of its two batches as several files, not as one."""
    path = str(tmp_path / "arriving")
    monkeypatch.setattr(catalog, "new_path", lambda _: path)
    asked = []
    given = catalog.batches.preprocess_batches
    monkeypatch.setattr(catalog.batches, "preprocess_batches", lambda *a: asked.append(a[6]) or given(*a))
    assert catalog.hvg_batches(spark, SF).count() > 0
    written = len([f for f in os.listdir(path) if f.endswith(".parquet")])
    assert asked == [spark.sparkContext.defaultParallelism] and asked[0] < written <= 2 * asked[0]
