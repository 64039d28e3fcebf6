"""Neighbour descent, components of stored entries, and layouts of several tiles, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import community, dealt, descent, graph, krylov, layout


def vectors_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, vec array<double>")


def nearest_of(x, k):
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(np.sort(d, axis=1)[:, :k])


def test_knn_descent_finds_nearly_all(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([c + r.normal(size=(200, 10)) for c in r.normal(size=(6, 10)) * 4] + [np.ones((60, 10)), np.ones((1, 10)) * 90])
    got = descent.descend(vectors_of(spark, x), 10, trees=3, leaf=64, wide=20)
    rows = got.graph.toPandas()
    assert got.rounds >= 1 and (rows.src != rows.dst).all() and not rows.duplicated(["src", "dst"]).any()
    assert np.allclose(np.linalg.norm(x[rows.src] - x[rows.dst], axis=1), rows.dist)
    assert (rows.groupby("src").size() == 10).all() and rows.src.nunique() == len(x)
    # Where distances tie, other neighbours are as good.
    want = nearest_of(x, 10)
    near = np.stack(rows.sort_values(["src", "rank"]).groupby("src").dist.apply(np.array))
    assert (near <= want + 1e-9).mean() > 0.97
    assert got.compared < 0.5 * len(x) ** 2


def test_knn_descent_of_few_is_exact(spark):
    r = np.random.default_rng(2)
    df = vectors_of(spark, r.normal(size=(70, 5)))
    got = descent.descend(df, 6)
    same = ["src", "dst", "rank"]
    assert {tuple(x) for x in got.graph.select(same).collect()} == {tuple(x) for x in graph.knn(df, 6).select(same).collect()}
    assert got.compared == 70 * 69 // 2
    assert descent.knn_descent(df.limit(1), 6).count() == 0 and descent.knn_descent(df.where("false"), 6).count() == 0
    assert {tuple(x) for x in graph.knn_of(df.where("cell % 9 = 0"), df, 6, block=20).select(same).collect()} == {tuple(x) for x in graph.knn(df, 6).where("src % 9 = 0").select(same).collect()}


@pytest.mark.parametrize("at, width, kind", [(0, 1, float), (1e5, 1, float), (0, 1e-30, float), (3, 1, int), (0, 1e20, float)])
def test_nearest_is_exact_whatever_single_precision_makes_of_it(at, width, kind):
    """Vectors far from zero, whole numbers whose distances tie, very small and very large ones, vectors that come twice, and unknown ones."""
    r = np.random.default_rng(11)
    q = ((r.normal(size=(3000, 12)) * 2 + at) * width).astype(kind).astype(float)
    q[5] = q[4]
    names = r.permutation(9000)[:3000]
    ids, p = np.concatenate([names[:280], [9500, 9501]]), np.concatenate([q[:280], q[300:302]])
    for unknown in (False, True):
        if unknown:
            q[77, 3] = np.nan
        src, dst, dist = graph.nearest(ids, p, names, q, 9)
        real = np.sqrt(np.square(p[:, None] - q).sum(axis=2))
        real[ids[:, None] == names] = np.nan
        for i, name in enumerate(ids):
            order = np.lexsort((names, real[i]))[:9]
            assert dst[src == name].tolist() == names[order].tolist() and np.array_equal(dist[src == name], real[i][order])


def test_nearest_of_fewer_than_asked_for():
    """Not even then is a vector its own neighbour, but one that comes twice is that of its other self."""
    x = np.random.default_rng(14).normal(size=(6, 3))
    src, dst, dist = graph.nearest(np.arange(6), x, np.arange(6), x, 9)
    assert sorted(zip(src, dst, strict=True)) == [(i, j) for i in range(6) for j in range(6) if i != j] and (dist > 0).all()
    src, dst, dist = graph.nearest(np.arange(1), x[:1], np.array([0, 0, 1]), x[[0, 0, 1]], 9)
    assert dst.tolist() == [0, 1] and dist[0] == 0


def test_products_of_neighbours_are_in_single_precision(monkeypatch):
    """Products of all pairs are half of the work in double precision."""
    kinds, real = [], np.partition
    monkeypatch.setattr(graph.np, "partition", lambda a, *rest, **named: kinds.append(a.dtype) or real(a, *rest, **named))
    x = np.random.default_rng(12).normal(size=(600, 8))
    graph.nearest(np.arange(600), x, np.arange(600), x, 5)
    assert kinds and set(kinds) == {np.dtype(np.float32)}


def test_neighbours_of_vectors_without_clusters(spark):
    """The hardest kind, of which descent loses more the more there are; all pairs are less work up to DENSE."""
    x = np.random.default_rng(3).normal(size=(2600, 64))
    got = descent.descend(vectors_of(spark, x), 15)
    rows = got.graph.toPandas()
    square = (x * x).sum(axis=1)
    d = square[:, None] - 2 * x @ x.T + square
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i, near in enumerate(np.argsort(d, axis=1)[:, :15]) for j in near}
    assert set(zip(rows.src, rows.dst, strict=True)) == want and len(rows) == len(want)
    assert got.compared == 2600 * 2599 // 2 < descent.DENSE**2


@pytest.mark.parametrize("cells, genes, k", [(120, 60, 5), (40, 90, 8), (12, 3, 10)])
def test_components_of_stored_entries(spark, cells, genes, k):
    r = np.random.default_rng(cells)
    a = (r.random((cells, genes)) < 0.2) * r.normal(3, 2, (cells, genes))
    a[5] = 0
    a[:, 1] = 0
    counts = spark.createDataFrame([(int(i), int(j) * 7, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "cell long, gene long, v double").repartition(3)
    cell_rows, gene_rows = spark.range(cells).toDF("cell"), spark.createDataFrame([(j * 7,) for j in range(genes)], "gene long")
    found, rows = krylov.fit(counts, cell_rows, gene_rows, k, tolerance=1e-8)
    centred = a - a.mean(axis=0)
    want = np.linalg.svd(centred, compute_uv=False)[: min(k, genes)]
    assert np.allclose(found.singular, want, atol=1e-6 * want[0]) and abs(found.squares - (centred**2).sum()) < 1e-6
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-9)
    got = np.stack(krylov.scores(found, rows, cell_rows).toPandas().sort_values("cell").vec)
    assert np.allclose(got, centred @ found.vectors, atol=1e-9)


@pytest.mark.parametrize("cells, genes, k, unit, held", [(120, 60, 5, 8, 60), (40, 90, 8, 16, 10000), (12, 3, 10, 8, 1)])
def test_components_dealt_to_tasks(spark, monkeypatch, cells, genes, k, unit, held):
    """More numbers than the driver may hold: the same components, from vectors that it never has."""
    r = np.random.default_rng(cells)
    a = (r.random((cells, genes)) < 0.2) * r.normal(3, 2, (cells, genes))
    a[5] = 0
    a[:, 1] = 0
    counts = spark.createDataFrame([(int(i), int(j) * 7, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "cell long, gene long, v double").repartition(3)
    cell_rows, gene_rows = spark.range(cells).toDF("cell"), spark.createDataFrame([(j * 7,) for j in range(genes)], "gene long")
    monkeypatch.setattr(krylov, "MOST", 1)
    monkeypatch.setattr(dealt.fit, "__defaults__", (*dealt.fit.__defaults__[:-2], unit, held))
    found, rows = krylov.fit(counts, cell_rows, gene_rows, k, tolerance=1e-6)
    centred = a - a.mean(axis=0)
    want = np.linalg.svd(centred, compute_uv=False)[: min(k, genes)]
    assert np.allclose(found.singular, want, atol=1e-6 * want[0]) and abs(found.squares - (centred**2).sum()) < 1e-6 and found.error <= 1e-6
    vectors = np.stack(dealt.loadings(found, rows).toPandas().sort_values("gene").vec)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-9)
    assert (vectors[np.abs(vectors).argmax(axis=0), range(len(want))] > 0).all()
    got = np.stack(krylov.scores(found, rows, cell_rows).toPandas().sort_values("cell").vec)
    assert np.allclose(got, centred @ vectors, atol=1e-9)


def test_equal_components_dealt_to_tasks(spark, monkeypatch):
    """Copies of one matrix, whose singular values come as often as there are copies, in several tiles that several tasks share."""
    r = np.random.default_rng(4)
    one = (r.random((14, 10)) < 0.4) * r.integers(1, 9, (14, 10)).astype(float)
    a = np.kron(np.eye(9), one)
    counts = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "cell long, gene long, v double").repartition(3)
    for name, value in (("SIDE", 2), ("SORTED", 50), ("SENT", 100)):
        monkeypatch.setattr(dealt, name, value)
    cell_rows, gene_rows = spark.range(len(a)).toDF("cell"), spark.range(a.shape[1]).toDF("gene")
    found, rows = dealt.fit(counts, cell_rows, gene_rows, 4, 1, unit=8, held=20)
    assert rows.tiles[0].count() > 9 and rows.tiles[0].agg(F.max("pieces")).first()[0] > 1
    centred = a - a.mean(axis=0)
    want = np.linalg.svd(centred, compute_uv=False)[:4]
    vectors = np.stack(dealt.loadings(found, rows).toPandas().sort_values("gene").vec)
    assert found.error <= 1e-4 and np.allclose(found.singular, want, rtol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    got = np.stack(krylov.scores(found, rows, cell_rows).toPandas().sort_values("cell").vec)
    assert np.allclose(got, centred @ vectors, atol=1e-9)
    inner = got.T @ got
    assert np.allclose(inner, np.diag(found.singular**2), atol=1e-12 * inner.max())
    assert np.linalg.norm(centred.T @ (centred @ vectors) - vectors * found.singular**2, axis=0).max() <= 2e-4 * found.singular[-1] ** 2


def test_repulsion_of_several_tiles(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([c + r.normal(size=(550, 2)) * s for c, s in zip(r.normal(size=(4, 2)) * 30, (1, 3, 9, 0.2), strict=True)])
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell long, x double, y double")
    n, z, pushed = layout.layout_sums(places)
    want, each = layout.repulsion(x, np.empty((0, 3)))
    got = pushed.orderBy("cell").select("vx", "vy").toPandas().to_numpy()
    assert n == 2200 and abs(z - each.sum()) < 0.01 * each.sum()
    assert np.abs(got - want).sum() < 0.02 * np.abs(want).sum()
    assert layout.repulsion_error(places) < 0.05
    box, _ = layout.extent(layout.start_state(places, 1.0))
    tiles = layout.tiled(layout.start_state(places, 1.0), n, box)
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] < n


def test_repulsion_error_is_that_of_all_cells(spark):
    """Pushes that are right on each 50th cell alone, against all pairs; blocks and cells that come twice change nothing."""
    x = np.random.default_rng(9).normal(size=(230, 2)) * 5
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate([*x, *x[:10]])]
    rows = [(i if i < 230 else i - 230, a, b) for i, a, b in rows]
    places = spark.createDataFrame(rows, "cell long, x double, y double")
    y = np.array([r[1:] for r in rows])
    d = y[:, None] - y
    q = 1 / (1 + (d * d).sum(axis=2)) ** 2
    want = (q[:, :, None] * d).sum(axis=1)
    state = spark.createDataFrame([(*r, *(f if r[0] % 50 == 0 else (0.0, 0.0)), 0.0) for r, f in zip(rows, want.tolist(), strict=True)], layout.STATE)
    size = np.hypot(*want.T)
    wrong = size[[r[0] % 50 != 0 for r in rows]].sum() / size.sum()
    for block in (None, 20):
        assert abs(layout.repulsion_error(places, (len(rows), 0.0, state), block) - wrong) < 1e-9


def test_tiled_layouts_keep_clusters(spark):
    r = np.random.default_rng(3)
    label = np.arange(1300) % 13
    x = r.normal(size=(13, 10))[label] * 4 + r.normal(size=(1300, 10))
    near = graph.knn(vectors_of(spark, x), 15).cache()
    start = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(1300, 2)) * 3)], "cell long, x double, y double")
    joint = layout.affinities(near, 5).cache()

    def purity(places):
        y = places.toPandas().sort_values("cell")[["x", "y"]].to_numpy()
        d = ((y[:, None] - y) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return (label[np.argpartition(d, 10, axis=1)[:, :10]] == label[:, None]).mean()

    before = purity(start)
    made = layout.tsne(joint, start, iterations=100)
    assert purity(made) > before + 0.4 and layout.divergence(joint, made) < 0.8 * layout.divergence(joint, start)
    assert purity(layout.umap(graph.connectivities(near), start, epochs=100)) > before + 0.4


def test_tsne_of_many_tiles_comes_nearer(spark, monkeypatch):
    """Where most neighbours are in other tiles, which stand still for a turn, steps must not throw cells beyond them."""
    x = np.random.default_rng(5).normal(size=(2600, 16))
    vectors = vectors_of(spark, x)
    joint = layout.affinities(graph.knn(vectors, 30), 10).cache()
    start = layout.initial_positions(vectors).cache()
    monkeypatch.setattr(layout, "TILE", 32)
    made = layout.tsne(joint, start, iterations=150)
    assert layout.divergence(joint, made) < layout.divergence(joint, start)


def test_repulsion_in_single_precision():
    r = np.random.default_rng(6)
    for width, at in ((0.05, 0.0), (3.0, 400.0)):
        x, far = r.normal(size=(100, 2)) * width + at, np.column_stack([r.integers(1, 900, 300), r.normal(size=(300, 2)) * 30 * width])
        m, others = np.concatenate([np.ones(100), far[:, 0]]), np.concatenate([x, far[:, 1:]])
        d = x[:, None] - others
        q = 1 / (1 + (d * d).sum(axis=2))
        force, z = layout.repulsion(x, far)
        want = ((q * q * m)[:, :, None] * d).sum(axis=1)
        assert np.allclose(z, q @ m - 1, rtol=1e-5) and np.abs(force - want).sum() < 1e-4 * np.abs(want).sum()


def jobs_of(spark, name, work):
    """What `work` gives, and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    made = work()
    count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    return made, count


@pytest.mark.parametrize("refined", [False, True])
def test_small_levels_take_no_jobs_of_their_own(spark, refined):
    """Pairs of cliques in rings of rings, which merge level by level: all levels after the first that fits are one job's."""
    r = np.random.default_rng(4)
    n = 4 * 4 * 4 * 4 * 6
    pairs = {(int(i), int(j)) for size, degree in ((6, 5), (24, 3), (96, 2), (384, 1)) for i in range(n) for j in i // size * size + r.integers(0, size, degree) if i < j}
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in sorted(pairs)], "src long, dst long, weight double").cache()
    nodes = spark.range(n).toDF("cell")
    labels, jobs = jobs_of(spark, f"levels {refined}", lambda: community.communities(edges, nodes, 1.0, refined, 1e-5).cache())
    assert labels.count() == n and labels.select("id").distinct().count() == n
    assert jobs <= 12
    assert community.modularity(edges, labels) > 0.5


def test_large_levels_take_few_jobs(spark, monkeypatch):
    """Levels above BLOCK, whose sweeps are one task's, and those above SWEPT, moved in turns: both find the cliques."""
    r = np.random.default_rng(4)
    n = 4 * 4 * 6
    edges = [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if i // 6 == j // 6]
    edges += [(min(i, j), max(i, j), 1.0) for i, j in r.integers(0, n, (20, 2)).tolist() if i // 6 != j // 6] + [(5, 5, 1.0)]
    frame, nodes = spark.createDataFrame(edges, "src long, dst long, weight double").cache(), spark.range(n + 2).toDF("cell")
    monkeypatch.setattr(community, "BLOCK", 60)
    found = {}
    for most in (1 << 20, 0):
        monkeypatch.setattr(community, "SWEPT", most)
        labels, jobs = jobs_of(spark, f"sweeps {most}", lambda: community.communities(frame, nodes, 1.0, True, 1e-5).cache())
        of = {x.id: x.c for x in labels.collect()}
        assert len(of) == n + 2 and of[n] == n and of[n + 1] == n + 1
        assert all(len({of[i] for i in range(c, c + 6)}) == 1 for c in range(0, n, 6))
        found[most] = jobs
    assert found[1 << 20] < found[0]


def test_sweeps_are_as_good_as_moves_one_by_one():
    r = np.random.default_rng(13)
    n = 1200
    group = r.permutation(n) // 40
    pairs = {(int(i), int(j)) for i in range(n) for j in [*r.choice(np.flatnonzero(group == group[i]), 5), *r.integers(0, n, 3)] if i < j}
    a = np.array(sorted(pairs))
    src, dst = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
    by = np.argsort(src, kind="stable")
    src, dst, weight, ids = src[by], dst[by], np.ones(len(by)), np.arange(n) * 3
    k, total = np.bincount(src, weight, n), float(len(by))

    def modularity(labels):
        _, of = np.unique(labels, return_inverse=True)
        size = np.bincount(of, k)
        return weight[of[src] == of[dst]].sum() / total - (size @ size) / total**2

    one_by_one = community.best_moves(community.Block(community.whole_rows(ids, ids, k, k, src, dst, weight)), total, 1.0)
    got = community.swept(ids, ids, k, src, dst, weight, total, 1.0, 1e-5)
    assert set(got) <= set(ids.tolist()) and modularity(got) > 0.97 * modularity(np.array(one_by_one))


def test_far_squares_open_levels_at_once(spark):
    """Every tile sees all points outside it, in a plan whose joins don't grow with the square of the levels."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(2500, 2)), [[300.0, -200.0]]])
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell long, x double, y double")
    state = layout.start_state(places, 1.0)
    box, _ = layout.extent(state)
    placed = layout.tiled(state, len(x), box)
    far = layout.far_squares(placed, len(x), box)
    assert far._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    outside = far.groupBy("tile").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("cx")).alias("x")).join(placed.groupBy("tile").agg(F.count("*").alias("n"), F.sum("x").alias("own")), "tile").collect()
    assert len(outside) == 3 and all(t.m + t.n == len(x) and abs(t.x + t.own - x[:, 0].sum()) < 1e-6 for t in outside)
