import gzip
import os
from collections import Counter

import pytest

from cellweave import __main__ as cli
from cellweave import session
from cellweave.model import CELLS, COUNTS, GENES, Dataset
from cellweave.operators.normalize import gene_moments, log1p, normalize_total
from cellweave.sources import files, h5ad
from cellweave.streaming.batches import preprocess_batches
from cellweave.streaming.running import moments, running_gene_sums


@pytest.fixture()
def matrix(spark):
    entries = [(i, j, float(i + j)) for i in range(6) for j in range(5) if (i * j) % 3]
    return Dataset(spark.createDataFrame([(i, f"b{i}") for i in range(6)], CELLS), spark.createDataFrame([(j, f"g{j}") for j in range(5)], GENES), spark.createDataFrame(entries, COUNTS))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_round_trip_and_filtered_read(spark, matrix, tmp_path):
    path = f"{tmp_path}/m"
    files.write_matrix(matrix, path)
    back = files.read_matrix(spark, path)
    assert rows(back.counts) == rows(matrix.counts) and rows(back.cells) == rows(matrix.cells) and back.shape() == (6, 5) and back.nnz() == matrix.nnz()
    assert {r[0] for r in rows(files.read_matrix(spark, path, 3).counts)} == {1, 2} and files.read_matrix(spark, path, 3).shape() == (3, 5)
    read = files.read_with_filter(spark, path, 1, 3, 1.0, 5, lambda c: log1p(normalize_total(c, 10)))
    kept = {r[0] for r in rows(read.counts)}
    assert kept == {r[0] for r in rows(read.cells)} <= {0, 1, 2, 3, 4} and read.counts.groupBy("gene").sum("v").where("`sum(v)` <= 1.0").count() == 0


def test_dense_csv(spark, tmp_path):
    path = f"{tmp_path}/dense.csv"
    with open(path, "w") as f:
        f.write("name,c.1,c2\ng1,1,0\ng0,0,2.5\ng2,0,0\n")
    data = files.read_matrix(spark, files.convert_dense_csv(spark, path))
    cells, genes = dict(rows(data.cells)), dict(rows(data.genes))
    assert os.path.isdir(f"{path}.sparse") and sorted(genes.values()) == ["g0", "g1", "g2"]
    assert {(cells[c], genes[g], v) for c, g, v in rows(data.counts)} == {("c.1", "g1", 1.0), ("c2", "g0", 2.5)}


def test_fragment_files(spark, tmp_path):
    path = f"{tmp_path}/f.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("# a comment\nchr1\t5\t9\tAA\t1\nchr1\t20\t30\tBB\t2\nchr2\t5\t9\tAA\t1\n")
    fragments = files.read_fragments_file(spark, path)
    assert sorted(r.cell for r in files.read_barcodes(spark, path).collect()) == ["AA", "AA", "BB"]
    files.write_fragments(fragments, f"{tmp_path}/f")
    found = files.read_fragments(spark.read.parquet(f"{tmp_path}/f"), "chr1", 0, 25)
    assert [(r.start, r.end, r.cell, r.row_num, r.len) for r in found.orderBy("row_num").collect()] == [(5, 9, "AA", 0, 4), (20, 30, "BB", 1, 10)]
    assert "duplicate" not in found.columns


def test_h5ad_needs_its_package(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            h5ad.h5py()
    assert h5ad.row_slice([0, 3, 3, 8], 1, 3) == (3, 8, [0, 0, 5])
    assert h5ad.H5adSource({"table": "genes"}).schema() == GENES and h5ad.H5adSource.name() == "h5ad"


def frame(spark):
    cells = spark.createDataFrame([(i, f"b{i}") for i in range(6)], CELLS)
    places = spark.createDataFrame([(i, float(i), -float(i)) for i in range(6)], "cell long, x double, y double")
    labels = spark.createDataFrame([(i, str(i % 3)) for i in range(6)], "cell long, community string")
    markers = spark.createDataFrame([(i, i / 4) for i in range(5)], "cell long, EP_raw double")
    return session.dashboard_frame(cells, places, labels, markers)


def test_frames(spark):
    f = frame(spark)
    assert f.columns == ["x", "y", "labels", "EP_raw", "EP_raw_labels", "point_index", "barcode"]
    assert {r.point_index: (r.EP_raw, r.EP_raw_labels) for r in f.collect()}[5] == (0.0, 2)
    series = {r.labels: (r.n, r.x, r.point_index) for r in session.scatter_series(f).collect()}
    assert series[1] == (2, [1.0, 4.0], [1, 4])
    assert {(r.labels, r.value): r.n for r in session.violin_counts(f, "EP_raw").collect()}[0, 0.0] == 1
    one, two = (spark.createDataFrame([(x,) for x in v], "labels int") for v in ([1, 2, 2], [2, 3]))
    assert rows(session.toggle_rows(one, two)) == [(1,), (3,)] == [(x,) for x in session.toggle([1, 2], [2, 3])]
    assert session.parse_labels(" 1, 2,") == [1, 2] and session.parse_labels(None) == []


def test_session(spark):
    seen = []

    def again(chosen):
        seen.append(chosen.count())
        return chosen.selectExpr("point_index", "x + 100 as x", "y", "7 as labels")

    s = session.Session(frame(spark), again)
    assert s.click(1) == [1] and s.click(2) == [1, 2] and s.click(1) == [2]
    assert {r.point_index for r in s.selection().collect()} == {2, 5}
    assert s.lasso([3]) == [] and s.lasso([4, 3, 4]) == [3, 4]
    assert {(r.x, r.labels, r.EP_raw, r.EP_raw_labels) for r in s.rerun().collect()} == {(103.0, 7, 0.75, 7), (104.0, 7, 1.0, 7)} and seen == [2]
    assert s.export().columns == s.base.columns and s.reset().count() == 6 and s.selected_labels == []


def test_running_sums(spark, matrix, tmp_path):
    matrix.counts.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = running_gene_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    want = gene_moments(matrix.counts, 6)
    assert rows(moments(spark.table("sums"), 6).select(want.columns)) == rows(want)


def test_batches_that_arrive(spark, tmp_path):
    entries = [(c, g, float((c * 7 + g * 3) % 5 + 1)) for c in range(30) for g in range(20) if (c * g + c) % 4 != 1]
    parts = [[e for k, e in enumerate(entries) if k % 3 == p] for p in range(3)]
    write = lambda p: spark.createDataFrame(parts[p], COUNTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def check(rows):
        got = preprocess_batches(spark, f"{tmp_path}/in", 3, 16, 20.0, 100.0, folder=f"{tmp_path}/kept")
        degree, sums = Counter(c for c, _, _ in rows), Counter()
        rows = [r for r in rows if 3 <= degree[r[0]] <= 16]
        for _, g, v in rows:
            sums[g] += v
        rows = [r for r in rows if sums[r[1]] >= 20]
        whole = spark.createDataFrame(rows, COUNTS)
        want = gene_moments(log1p(normalize_total(whole, 100.0)), got.n_cells)
        assert {r.cell for r in got.cells.collect()} == {c for c, _, _ in rows} and got.n_cells == len({c for c, _, _ in rows}) and got.n_genes == len({g for _, g, _ in rows})
        by_gene = lambda df: {r.gene: [round(r[c], 9) for c in ("total", "squares", "entries", "mean", "mean_sq")] for r in df.collect()}
        assert by_gene(got.moments) == by_gene(want) and by_gene(want)

    write(0)
    write(1)
    check(parts[0] + parts[1])
    write(2)
    check(entries)
    with open(f"{tmp_path}/kept/cells/state/commits/2"):
        pass
    (tmp_path / "none").mkdir()
    assert preprocess_batches(spark, f"{tmp_path}/none", 1, 9).n_cells == 0


def test_command_line(capsys, spark):
    assert cli.main(["list"]) == 0 and "hvg" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        cli.main(["run", "no such query", "x"])
