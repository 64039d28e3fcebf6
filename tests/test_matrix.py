import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.ordered import row_numbers, running_sum
from cellweave.model import CELLS, COUNTS, GENES, Dataset
from cellweave.operators import filters, normalize, variable
from cellweave.plans import pipelines

MATRIX = [[2, 0, 0, 6], [0, 5, 0, 0], [1, 1, 2, 0], [0, 0, 0, 0]]


def long_rows(matrix):
    return [(i + 1, j + 1, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]


@pytest.fixture(scope="module")
def hand(spark):
    cells = spark.createDataFrame([(i, f"b{i}") for i in range(1, 5)], CELLS)
    genes = spark.createDataFrame([(1, "red a"), (2, "b"), (3, "b"), (4, "red a")], GENES)
    return Dataset(cells, genes, spark.createDataFrame(long_rows(MATRIX), COUNTS))


def table(counts, digits=6):
    return {(r.cell, r.gene): round(r.v, digits) for r in counts.collect()}


def ids(df, key):
    return sorted(r[key] for r in df.select(key).distinct().collect())


def test_filters(hand):
    assert {r.cell: r.degree for r in filters.degrees(hand.counts).collect()} == {1: 2, 2: 1, 3: 3}
    assert ids(filters.filter_cells(hand, 1, 2).cells, "cell") == [1, 2]
    assert ids(filters.filter_cells(hand, 0, 2).cells, "cell") == [1, 2, 4]
    assert ids(filters.kept_genes(hand.counts, 3), "gene") == [1, 2, 4]
    assert ids(filters.kept_genes(hand.counts, 2, "entries"), "gene") == [1, 2]
    assert ids(filters.kept_genes(hand.counts, 3, "sum_strict"), "gene") == [2, 4]
    assert ids(filters.select_barcodes(hand, ["b2", "none"]).counts, "cell") == [2]
    assert [r["name"] for r in filters.unique_names(hand.genes).orderBy("gene").collect()] == ["red a", "b", "b-1", "red a-1"]
    clash = hand.genes.sparkSession.createDataFrame(enumerate(["A", "A", "A-1", "A-3", "A", "A", "A-1", None, None, "A-01"]), "gene long, name string")
    assert [r["name"] for r in filters.unique_names(clash).orderBy("gene").collect()] == ["A", "A-2", "A-1", "A-3", "A-4", "A-5", "A-1-1", None, None, "A-01"]
    assert [(r.gene, r.position) for r in filters.reindex(hand.genes.where("gene <> 2"), "gene").orderBy("gene").collect()] == [(1, 0), (3, 1), (4, 2)]
    assert table(filters.first_cells(hand.counts, 2)) == {(1, 1): 2, (1, 4): 6}
    dense = filters.densify(hand.counts, hand.cells, hand.genes)
    assert dense.count() == 16 and table(filters.sparsify(dense)) == table(hand.counts)
    assert table(filters.transpose(hand.counts))[4, 1] == 6
    markers = filters.marker_expression(hand.counts, hand.cells, filters.marker_ids(hand.genes, ["b", "absent"]))
    assert {r.cell: r.b_raw for r in markers.collect()} == {1: 0, 2: 5, 3: 1, 4: 0}


def test_normalisation(hand):
    scaled = normalize.normalize_total(hand.counts, 10.9)
    assert table(scaled) == {(1, 1): 2.5, (1, 4): 7.5, (2, 2): 10, (3, 1): 2.5, (3, 2): 2.5, (3, 3): 5}
    assert table(normalize.log1p(scaled))[1, 4] == 2.140066
    assert table(normalize.tf_idf(hand.counts, 4)) == {(1, 1): 0.274653, (1, 4): 1.207078, (2, 2): 1.098612, (3, 1): 0.274653, (3, 2): 0.274653, (3, 3): 0.804719}
    assert table(normalize.log_tf_idf(hand.counts, 4, 1000)) == {(1, 1): 10.626397, (1, 4): 46.702173, (2, 2): 29.13138, (3, 1): 6.07033, (3, 2): 6.07033, (3, 3): 17.785747}
    zero = hand.counts.sparkSession.createDataFrame([(1, 1, 0.0), (2, 1, -1.0)], COUNTS)
    assert table(normalize.normalize_total(zero, 10)) == {(1, 1): 0, (2, 1): -1}


def test_scale_and_regress(spark):
    r = np.random.default_rng(3)
    m = r.poisson(1.2, size=(40, 7)).astype(float)
    m[:, 6] = 0
    cells = spark.createDataFrame([(i, "") for i in range(1, 41)], CELLS)
    genes = spark.createDataFrame([(j, "red" if j < 3 else "x") for j in range(1, 8)], GENES)
    counts = spark.createDataFrame(long_rows(m), COUNTS)
    dense = filters.densify(counts, cells, genes)
    for ddof in (0, 1):
        std = m.std(axis=0, ddof=ddof)
        want = np.clip((m - m.mean(axis=0)) / np.where(std > 0, std, 1), -2, 2)
        got = table(normalize.scale_rows(dense, normalize.scale_parameters(counts, genes, 40, ddof), 2.0), 9)
        assert all(math.isclose(got[i + 1, j + 1], want[i, j], abs_tol=1e-8) for i in range(40) for j in range(7))
        stored, absent = normalize.scale_stored(counts, genes, 40, 2.0, ddof)
        each = {x.gene: (x.low, x.high, x.total, x.squares) for x in normalize.scaled_summary(stored, absent, 40).collect()}
        assert all(np.allclose(each[j + 1], (want[:, j].min(), want[:, j].max(), want[:, j].sum(), (want[:, j] ** 2).sum()), atol=1e-8) for j in range(7))
    covariates = normalize.covariates(counts, cells, filters.with_prefix(genes, "red")).cache()
    n = m.sum(axis=1)
    x = np.stack([np.ones(40), n, np.divide(m[:, :2].sum(axis=1), n, out=np.zeros(40), where=n > 0)], axis=1)
    for design, rows in ((x, covariates), (x * [1, 1, 0], covariates.withColumn("percent", covariates.percent * 0))):
        want = m - design @ np.linalg.lstsq(design, m, rcond=None)[0]
        got = table(normalize.residuals(counts, cells, genes, rows), 12)
        assert all(math.isclose(got[i + 1, j + 1], want[i, j], abs_tol=1e-7) for i in range(40) for j in range(7))
        sums = {x.cell: (x.total, x.squares) for x in normalize.residual_sums(counts, genes, rows).collect()}
        assert all(np.allclose(sums[i + 1], (want[i].sum(), (want[i] ** 2).sum()), atol=1e-7) for i in range(40))


def plain_dispersion(m, n_genes):
    mean = m.mean(axis=0)
    mean[mean == 0] = 1e-12
    disp = ((m**2).mean(axis=0) - mean**2) * n_genes / (len(m) - 1) / mean
    edges = np.percentile(mean, range(10, 101, 5))
    bins = np.array([(edges < x).sum() for x in mean])
    norm = np.full(len(mean), np.nan)
    for b in set(bins):
        d = disp[bins == b]
        mad = np.median(np.abs(d - np.median(d))) / 0.6744897501960817
        with np.errstate(divide="ignore", invalid="ignore"):
            norm[bins == b] = (d - np.median(d)) / mad
    return norm


def test_variable_genes(spark):
    r = np.random.default_rng(5)
    m = r.poisson(r.gamma(1.0, 2.0, size=200), size=(60, 200)) * r.integers(1, 4, size=(60, 200)).astype(float)
    m[:, 10] = 0
    norm = plain_dispersion(m, 200)
    cut = np.sort(norm[~np.isnan(norm)])[::-1][29]
    genes = spark.createDataFrame([(j, "") for j in range(1, 201)], GENES)
    got = {x.gene: x for x in variable.highly_variable(spark.createDataFrame(long_rows(m), COUNTS), genes, 60, 200, 30).collect()}
    for j in range(200):
        assert (got[j + 1].norm is None) == np.isnan(norm[j])
        assert got[j + 1].norm is None or math.isclose(got[j + 1].norm, norm[j], rel_tol=1e-6, abs_tol=1e-6)
        assert got[j + 1].selected == (np.nan_to_num(norm[j]) >= cut)
    everything = variable.highly_variable(spark.createDataFrame(long_rows(m), COUNTS), genes, 60, 200, 10_000)
    assert everything.where("norm is not null and not selected").count() == 0


def test_preprocess_and_scaled_residuals(spark):
    r = np.random.default_rng(6)
    m = r.poisson(2.0, size=(50, 40)).astype(float)
    data = Dataset(
        spark.createDataFrame([(i, f"b{i}") for i in range(1, 51)], CELLS),
        spark.createDataFrame([(j, f"red{j}" if j % 5 == 0 else f"g{j}") for j in range(1, 41)], GENES),
        spark.createDataFrame(long_rows(m), COUNTS),
    )
    ready = pipelines.preprocess(data, ["g1", "g2"], 10, 40, 1, 1e4, 20)
    assert ready.results["markers"].columns == ["cell", "g1_raw", "g2_raw"] and ready.genes.count() >= 20
    dense = pipelines.regress_and_scale(ready, "red")
    sums = dense.groupBy("gene").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).collect()
    assert {x.n for x in sums} == {ready.cells.count()} and len(sums) == ready.genes.count()
    assert all(abs(x["mean"]) < 1e-6 for x in sums)
    empty = data.having(counts=data.counts.limit(0))
    assert filters.filter_cells(empty, 1, 5).cells.count() == 0 and normalize.normalize_total(empty.counts, 10).count() == 0


def test_numbers_and_sums_along_an_order(spark):
    r = np.random.default_rng(9)
    rows = [(None if g == 3 else f"c{g}", int(k), int(v)) for k, (g, v) in enumerate(zip(r.integers(0, 4, 3000), r.integers(0, 9, 3000), strict=True))]
    df = spark.createDataFrame(rows, "chrom string, k long, v long").repartition(7, "v")
    want, at = {}, {}
    for c, k, v in rows:
        n, s = at.get(c, (0, 0))
        want[k] = (n, s + v)
        at[c] = (n + 1, s + v)
    found = running_sum(row_numbers(df, ["k"], "n", ["chrom"]), "v", ["n"], "s", ["chrom"])
    assert {x.k: (x.n, x.s) for x in found.collect()} == want
    falling = row_numbers(df, [F.desc("k")], "n")
    assert {x.k: x.n for x in falling.collect()} == {k: 2999 - k for k in range(3000)}
    assert row_numbers(df.limit(0), ["k"], "n").count() == 0
