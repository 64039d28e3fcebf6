import random

import numpy as np
import pytest

from cellweave.operators import coverage, intervals

FRAGMENT = "chrom string, start int, end int, cell long"
GENE = "gene string, chrom string, start int, end int, strand string"


def plain_overlap(gene, fragment, up, down):
    """The three closed-interval cases, one by one."""
    _, chrom, gs, ge, strand = gene
    if strand == "rev":
        up, down = down, up
    lo, hi = gs - up, ge + down
    c, s, e = fragment[:3]
    return c == chrom and (lo <= s <= hi or lo <= e <= hi or s <= lo and e >= hi)


@pytest.mark.parametrize("width", [3, 50, 100_000])
def test_overlap_join(spark, width):
    r = random.Random(width)
    genes = [("g", "chr1", 100, 200, "fwd"), ("h", "chr1", 100, 200, "rev")] + [(f"x{i}", r.choice(["chr1", "chr2"]), s := r.randrange(400), s + r.randrange(60), r.choice(["fwd", "rev"])) for i in range(15)]
    fragments = [("chr1", 40, 50, 0), ("chr1", 40, 49, 1), ("chr1", 201, 210, 2), ("chr1", 250, 260, 3), ("chr1", 40, 99, 4), ("chr1", 10, 900, 5), ("chr2", 100, 200, 6)]
    fragments += [(r.choice(["chr1", "chr2", "chr3"]), s := r.randrange(-50, 500), s + r.randrange(120), 10 + i) for i in range(80)]
    found = intervals.overlap_join(spark.createDataFrame(genes, GENE), spark.createDataFrame(fragments, FRAGMENT), 50, 0, width)
    got = sorted((x.gene, x.cell) for x in found.collect())
    assert got == sorted((g[0], f[3]) for g in genes for f in fragments if plain_overlap(g, f, 50, 0))
    assert ("g", 0) in got and ("g", 1) not in got and ("g", 2) not in got and ("h", 3) in got and ("h", 4) not in got and ("g", 5) in got


def test_overlap_join_of_all_lengths(spark):
    """Both sides large, intervals from one base to all of a chromosome, and bins that are split."""
    r = random.Random(9)
    span = lambda: (s := r.randrange(5000), s + r.choice([0, 3, 30, 300, 3000, 20_000]))
    genes = [(f"g{i}", r.choice("ab"), *span(), "fwd") for i in range(120)]
    fragments = [(r.choice("abc"), *span(), i) for i in range(400)] + [("a", 100, 105, 1000 + i % 3) for i in range(90)] + [(None, 1, 2, 7), ("a", 9, 8, 7), ("a", None, 8, 7)]
    g, f = spark.createDataFrame(genes, GENE), spark.createDataFrame(fragments, FRAGMENT)
    want = sorted((x[0], y[3]) for x in genes for y in fragments if y[1] is not None and y[1] <= y[2] and plain_overlap(x, y, 0, 0))
    for width, most in ((16, 10), (1000, 50), (16, 10**6)):
        got = intervals.overlap_join(g, f, 0, 0, width, most)
        assert sorted((x.gene, x.cell) for x in got.collect()) == want
    assert got.columns == [*f.columns, "gene", "gene_chrom", "gene_start", "gene_end", "strand"]
    rows = intervals.binned(f.withColumn("own", f.cell), "chrom", "start", "end", 16, 6).groupBy("cell", "start", "end", "_level").count()
    assert rows.where("cell < 400").agg({"count": "max"}).first()[0] <= 2
    peaks = spark.createDataFrame([(i, *x[1:4]) for i, x in enumerate(genes)], "peak long, chrom string, start int, end int")
    matrix = {(x.peak, x.cell): x.v for x in intervals.peak_cell_counts(peaks, f, 16).collect()}
    assert sum(matrix.values()) == len(want) and intervals.peak_cell_counts(peaks, f.where("false"), 16).count() == 0


@pytest.mark.parametrize("longest", [0, 40, 3000])
def test_peak_totals_make_no_pairs(spark, monkeypatch, longest):
    """Totals equal those of all pairs, while no pair is made: copies of few places would square."""
    r = random.Random(longest)
    peaks = [(i, r.choice("abc"), s := r.randrange(-50, 900), s + r.randrange(longest + 1)) for i in range(150)] + [(900, "a", 9, 3), (901, None, 1, 5), (902, "z", 1, 5)]
    fragments = [(r.choice("ab"), s := r.randrange(-50, 900), s + r.choice([0, 1, 5, 30, 200]), r.choice([None, *range(25)])) for _ in range(400)] + [("a", 9, 8, 7), (None, 1, 2, 7)]
    p, f = spark.createDataFrame(peaks, "peak long, chrom string, start int, end int"), spark.createDataFrame(fragments, FRAGMENT)
    want = {}
    for peak, chrom, s, e in peaks:
        met = [x for x in fragments if x[0] is not None and x[0] == chrom and s <= e and x[1] <= x[2] and x[1] <= e and x[2] >= s]
        if met:
            want[peak] = (len({x[3] for x in met} - {None}), len(met))
    monkeypatch.delattr(intervals, "overlap_join")
    assert {x.peak: (x.cells, x.fragments) for x in intervals.peak_totals(p, f).collect()} == want


def test_keyed_tiles_and_a_network(spark, tmp_path):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(c, 20 + k, int(v)) for c in "ab" for k, v in enumerate(r.integers(0, 9, 70))], "cluster string, pos int, depth long").repartition(3)
    tracks = coverage.tracks(df)
    for interval, pad in ((7, 0), (10, 5), (60, 5), (80, 0)):
        got = {(x.cluster, x.tile): x["values"] for x in coverage.keyed_tiles(df, 20, 90, interval, pad).collect()}
        assert got == {(x.cluster, x.tile): x["values"] for x in coverage.tiles(tracks, interval, pad).collect()}
    rows = {(x.cluster, x.pos): x["values"] for x in coverage.tile_positions(coverage.keyed_tiles(df, 20, 90, 10, 5), 20, 10, 5, "values").collect()}
    assert rows == {(x.cluster, x.pos): x.depth for x in df.where("pos >= 25 and pos < 85").collect()}
    layers = [
        coverage.Layer(r.normal(size=(3, 1, 5)), r.normal(size=3), dilation=2),
        coverage.Layer(r.normal(size=(3, 3, 3)), r.normal(size=3), dilation=4, residual=True),
        coverage.Layer(r.normal(size=(2, 3, 1)), r.normal(size=2), positive=False),
    ]
    coverage.write_network(spark, layers, f"{tmp_path}/net")
    model = coverage.network_model(coverage.read_network(spark, f"{tmp_path}/net"))
    full = {x.cluster: np.array(x.track) for x in tracks.collect()}

    def plain(x):
        """The network one number at a time."""
        x = [list(x)]
        for layer in layers:
            y = [[layer.bias[o] + sum(layer.weights[o, i, k] * x[i][t + (k - layer.weights.shape[2] // 2) * layer.dilation] for i in range(len(x)) for k in range(layer.weights.shape[2]) if 0 <= t + (k - layer.weights.shape[2] // 2) * layer.dilation < len(x[0])) for t in range(len(x[0]))] for o in range(len(layer.bias))]
            y = [[max(0.0, v) for v in row] for row in y] if layer.positive else y
            x = [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(x, y, strict=True)] if layer.residual else y
        return x

    # The network sees four and four places to each side: a pad of eight makes tiles exact.
    found = coverage.tile_positions(coverage.denoise(coverage.keyed_tiles(df, 20, 90, 9, 8), model), 20, 9, 8, "signal", "peak").collect()
    assert len(found) == 2 * 54
    want = {c: plain(x) for c, x in full.items()}
    for x in found:
        assert abs(x.signal - want[x.cluster][0][x.pos - 20]) < 1e-9 and abs(x.peak - 1 / (1 + np.exp(-np.clip(want[x.cluster][1][x.pos - 20], -30, 30)))) < 1e-9


def test_regions_and_fragment_tables(spark):
    rows = spark.createDataFrame([("c", 5, 9, 2), ("c", 3, 12, 1), ("c", 9, 9, 3), ("d", 1, 2, 1)], FRAGMENT)
    assert intervals.parse_region("chr1:1,001-2,000") == ("chr1", 1000, 2000)
    with pytest.raises(ValueError):
        intervals.parse_region("chr1")
    assert sorted(x.cell for x in intervals.region_string_scan(rows, "c:10-12").collect()) == [1]
    table = intervals.fragment_table(rows).where("chrom = 'c'").orderBy("row_num")
    assert [(x.cell, x.row_num, x.len) for x in table.collect()] == [(1, 0, 9), (2, 1, 4), (3, 2, 0)]
    assert [x.end_index for x in intervals.cumulative_length(table).orderBy("row_num").collect()] == [9, 13, 13]
    assert [tuple(x) for x in intervals.count_fragments(rows).collect()] == [(1, 2), (2, 1), (3, 1)]
    names = spark.createDataFrame([("chr1:5-10",), ("odd",), ("a:b:1-2",)], "name string")
    assert [tuple(x) for x in intervals.parse_peaks(names).collect()] == [("chr1:5-10", "chr1", 5, 10), ("odd", None, None, None), ("a:b:1-2", "a:b", 1, 2)]


def test_coverage_by_hand(spark):
    rows = spark.createDataFrame([(8, 12, 0), (11, 14, 0), (15, 20, 1), (13, 13, 1)], "start int, end int, cluster int")
    clusters = spark.createDataFrame([(0,), (1,), (2,)], "cluster int")
    want = {0: [1, 2, 1, 1, 0, 0], 1: [0, 0, 0, 0, 0, 1], 2: [0] * 6}
    for depths in (coverage.coverage(rows, 10, 16), coverage.coverage_sweep(rows, 10, 16)):
        dense = coverage.dense_coverage(depths, clusters, 10, 16)
        assert {x.cluster: x.track for x in coverage.tracks(dense).collect()} == want
    assert coverage.coverage_sweep(rows, 30, 40).count() == 0 and coverage.expand_fragments(rows).where("cluster = 1").count() == 5


def test_sweep_equals_expansion_and_tiles_reassemble(spark):
    r = random.Random(2)
    rows = [(s := r.randrange(100), s + r.randrange(40), r.choice("ab")) for _ in range(200)]
    df = spark.createDataFrame(rows, "start int, end int, cluster string")
    a, b = (sorted(map(tuple, f(df, 20, 90).collect())) for f in (coverage.coverage, coverage.coverage_sweep))
    assert a == b and sum(x[2] for x in a) == sum(max(0, min(e, 90) - max(s, 20)) for s, e, _ in rows)
    tracks = coverage.tracks(coverage.dense_coverage(coverage.coverage_sweep(df, 20, 90), df, 20, 90))
    full = {x.cluster: x.track for x in tracks.collect()}
    for interval, pad in ((7, 0), (10, 5), (60, 5), (80, 0)):
        tiles = coverage.tiles(tracks, interval, pad)
        n = (70 - 2 * pad) // interval
        assert tiles.count() == 2 * n and all(len(x["values"]) == interval + 2 * pad for x in tiles.collect())
        back = {x.cluster: x.track for x in coverage.untile(coverage.denoise(tiles, coverage.identity_model), pad, "signal").collect()}
        assert back == ({k: v[pad : pad + n * interval] for k, v in full.items()} if n else {})
    smooth, _ = coverage.moving_average_model(5)(np.array([full["a"]]))
    assert np.allclose(smooth[0][2:-2], [np.mean(full["a"][i - 2 : i + 3]) for i in range(2, 68)])


def test_gene_activity_and_depth_choice(spark):
    counts = spark.createDataFrame([(1, 10, 3.0), (1, 11, 4.0), (2, 12, 5.0)], "cell long, gene long, v double")
    peaks = spark.createDataFrame([(10, "c", 95, 99), (11, "c", 150, 160), (12, "d", 95, 99)], "peak long, chrom string, start int, end int")
    genes = spark.createDataFrame([("g", "c", 100, 200, "fwd"), ("h", "d", 500, 600, "fwd")], GENE)
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    got = {(x.cell, x.gene): x.activity for x in intervals.gene_activity(counts, peaks, genes, cells, 5, 0).collect()}
    assert got == {(1, "g"): 3.0, (1, "h"): 0.0, (2, "g"): 0.0, (2, "h"): 0.0}
    sums = coverage.cluster_fragment_sums(spark.createDataFrame([(1, 5), (2, 7), (9, 1)], "cell long, fragments long"), cells.withColumn("cluster", cells.cell))
    assert [x.cluster for x in coverage.closest_to(sums, 7, 1).collect()] == [2]
    top = intervals.top_peaks(counts.union(spark.createDataFrame([(2, 10, 1.0)], counts.schema)), 2, 2)
    assert [tuple(x) for x in top.collect()] == [(10, 1.0), (11, 0.5)]
