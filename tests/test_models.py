from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from cellweave.operators import community, graph, layout, reduce


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(3, 8)) * 6
    x = np.concatenate([c + r.normal(size=(30, 8)) for c in centres])
    rows = [(i, v.tolist(), str(i // 30)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "cell long, vec array<double>, cluster string").cache()


def test_pca(blobs):
    x, df = blobs
    mean, components, share = reduce.fit_pca(df, 4)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(components.T @ components, np.eye(4), atol=1e-8) and np.all(np.diff(share) <= 1e-12)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :4]
    got = np.array([r.vec for r in reduce.pca(df, 4).orderBy("cell").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert reduce.pca_on_first(df, 3, 0.5).count() == 90 and len(reduce.leading(df, 2).first().vec) == 2
    assert np.allclose(np.array([[r.cov] for r in reduce.covariance(df).orderBy("i", "j").collect()]).reshape(8, 8), np.cov(x.T))


@pytest.mark.parametrize("block, own", [(2048, False), (20, False), (20, True)])
def test_knn(blobs, block, own):
    x, df = blobs
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    if not own:
        np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:5]}
    got = graph.knn(df, 5, include_self=own, block=block).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == 450
    assert all(abs(r.dist - d[r.src, r.dst]) < 1e-9 for r in got)


@pytest.mark.parametrize("block", [2048, 7])
def test_knn_approximate(blobs, block):
    _, df = blobs
    exact = {(r.src, r.dst) for r in graph.knn(df, 5).collect()}
    got = graph.knn_approximate(df, 5, block=block).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got) and all(r.src != r.dst for r in got)
    assert len(exact & {(r.src, r.dst) for r in got}) >= 0.9 * len(exact)


def test_membership_weights(blobs):
    _, df = blobs
    near = graph.knn(df, 8).cache()
    sums = {r.src: r.s for r in graph.membership_weights(near).groupBy("src").agg(F.sum("weight").alias("s")).collect()}
    assert len(sums) == 90 and all(abs(s - 3.0) < 1e-3 for s in sums.values())
    two = near.sparkSession.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (3, 1, 1.0)], "src long, dst long, weight double")
    assert {(r.src, r.dst): r.weight for r in graph.symmetric(two).collect()} == {(1, 2): 0.625, (1, 3): 1.0}


def test_communities(blobs):
    _, df = blobs
    edges = graph.connectivities(graph.knn(df, 8)).cache()
    nodes = df.select("cell").union(df.sparkSession.createDataFrame([(500,)], "cell long"))
    found = community.louvain(edges, nodes).cache()
    labels = found.selectExpr("cell as id", "community as c")
    alone = nodes.selectExpr("cell as id", "cast(cell as string) as c")
    assert found.count() == 91 and community.modularity(edges, labels) > max(0.5, community.modularity(edges, alone))
    assert found.join(df, "cell").groupBy("community").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    assert {r.community for r in found.collect()} == {str(k) for k in range(found.select("community").distinct().count())}


def test_leiden_is_connected(blobs):
    _, df = blobs
    edges = graph.connectivities(graph.knn(df, 8)).cache()
    found = community.leiden(edges, df, 1.0).cache()
    c = {r.cell: r.community for r in found.collect()}
    nodes = list(c)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for e in edges.collect():
        if c[e.src] == c[e.dst]:
            root[find(e.src)] = find(e.dst)
    assert len({find(n) for n in nodes}) == len(set(c.values()))
    assert community.modularity(edges, found.selectExpr("cell as id", "community as c")) > 0.4


def test_kmeans_and_ranking(blobs):
    x, df = blobs
    labels = reduce.kmeans(df, 3)
    assert labels.join(df, "cell").groupBy("kmeans").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    groups = df.select("cell", F.col("cluster").alias("group"))
    ranked = reduce.rank_features(df.select("cell", "vec"), groups, n_features=2).collect()
    assert len(ranked) == 6
    for r in ranked:
        if r["rank"] == 1:
            means = np.array([x[30 * k : 30 * k + 30].mean(axis=0) for k in range(3)])
            assert means[int(r["group"]), r.feature] > means[:, r.feature].mean()
    two = {(r["group"], r.feature): r.score for r in reduce.rank_features(df.select("cell", "vec"), groups, ["0", "2"]).collect()}
    assert all(abs(two["0", f] + two["2", f]) < 1e-6 for f in range(8))
    assert [(r["group"], r["ord"]) for r in reduce.select_groups(groups, ["2", "0"]).orderBy("ord").collect()] == [("2", 0), ("0", 1)]
    with pytest.raises(ValueError):
        reduce.rank_features(df.select("cell", "vec"), groups, ["0"], n_features=1)
    with pytest.raises(ValueError):
        reduce.rank_features(df.select("cell", "vec"), groups, ["0", "1"], reference="no such")


def spread(positions, cells):
    p = np.array([(r.x, r.y) for r in sorted(positions.collect(), key=lambda r: r.cell)])
    assert p.shape == (cells, 2) and np.isfinite(p).all()
    centres = np.array([p[30 * k : 30 * k + 30].mean(axis=0) for k in range(3)])
    inside = np.mean([np.linalg.norm(p[30 * k : 30 * k + 30] - centres[k], axis=1).mean() for k in range(3)])
    return min(np.linalg.norm(centres[i] - centres[j]) for i in range(3) for j in range(i)) / inside


def test_layouts_keep_blobs_apart(blobs):
    _, df = blobs
    near = graph.knn(df, 12).cache()
    start = layout.initial_positions(reduce.pca(df, 2)).cache()
    assert spread(layout.umap(graph.connectivities(near), start, epochs=4), 90) > 1
    assert spread(layout.tsne(layout.affinities(near, 4), start, iterations=5), 90) > 1
    a, b = layout.curve(0.1, 1.0)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.02


def block_of(edges, labels):
    """A block of all nodes, of (src, dst, weight) given in both directions."""
    k = Counter()
    for s, _, w in edges:
        k[s] += w
    size = Counter()
    for i, c in labels.items():
        size[c] += k[i]
    rows = [(0, community.NODE, i, c, 0, float(k[i]), float(size[c])) for i, c in labels.items()] + [(0, community.ARC, s, d, labels[d], float(w), float(size[labels[d]])) for s, d, w in edges if s != d]
    names = ["block", "kind", "a", "b", "c", "p", "q"]
    return community.Block(pa.table({n: [r[j] for r in rows] for j, n in enumerate(names)})), sum(w for _, _, w in edges)


def test_moves_end_where_no_node_gains():
    r = np.random.default_rng(5)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (200, 2)) if a != b}
    edges = [(x, y, 1.0 + (a + b) % 3) for a, b in pairs for x, y in ((a, b), (b, a))]
    nodes = sorted({e[0] for e in edges})
    block, total = block_of(edges, {i: i for i in nodes})
    found = dict(zip(block.ids.tolist(), community.best_moves(block, total, 1.0), strict=True))

    def modularity(of):
        k = Counter()
        for s, _, w in edges:
            k[of[s]] += w
        return sum(w for s, d, w in edges if of[s] == of[d]) / total - sum(x * x for x in k.values()) / total**2

    reached = modularity(found)
    assert reached > 0.2
    for i in nodes:
        assert all(modularity(found | {i: c}) <= reached + 1e-9 for c in set(found.values()))


def test_refined_parts_are_well_connected():
    r = np.random.default_rng(6)
    edges = {}
    for a, b in r.integers(0, 80, (500, 2)):
        if a // 40 == b // 40 and a != b:
            edges[min(a, b), max(a, b)] = 1.0
    edges |= {(0, 41): 1.0}
    arcs = [(int(x), int(y), w) for (a, b), w in edges.items() for x, y in ((a, b), (b, a))]
    nodes = sorted({a for a, _, _ in arcs})
    labels = {i: i // 40 for i in nodes}
    block, total = block_of([a for a in arcs if labels[a[0]] == labels[a[1]]], labels)
    inside = np.array([sum(block.weight[b:e]) for b, e in zip(block.begin, block.end, strict=True)])
    whole = np.array([sum(block.k[block.of == c]) for c in block.of])
    of = community.well_merged(block, inside, whole, total, 1.0, 3)
    parts = {}
    for i, p in enumerate(of):
        parts.setdefault(p, []).append(i)
    assert 2 <= len(parts) < len(nodes)
    for p, members in parts.items():
        ids = {int(block.ids[i]) for i in members}
        assert len({labels[i] for i in ids}) == 1
        size, home = sum(block.k[i] for i in members), whole[members[0]]
        out = sum(w for a, b, w in arcs if a in ids and b not in ids and labels[a] == labels[b])
        assert len(members) == 1 or out >= size * (home - size) / total - 1e-9 or size == home
        seen, todo = set(), [next(iter(ids))]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [b for a, b, _ in arcs if a == i and b in ids]
        assert seen == ids


@pytest.mark.parametrize("method, block", [(community.louvain, 8192), (community.leiden, 8192), (community.louvain, 25), (community.leiden, 25)])
def test_communities_of_a_ring_of_cliques(spark, monkeypatch, method, block):
    monkeypatch.setattr(community, "BLOCK", block)
    size, cliques = 5, 12
    edges = [(c * size + a, c * size + b, 1.0) for c in range(cliques) for a in range(size) for b in range(a + 1, size)]
    edges += [(min(x, y), max(x, y), 1.0) for c in range(cliques) for x, y in [(c * size, (c + 1) % cliques * size + 1)]]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = {r.cell: r.community for r in method(frame, spark.range(size * cliques).withColumnRenamed("id", "cell")).collect()}
    of_clique = [{found[c * size + a] for a in range(size)} for c in range(cliques)]
    assert all(len(x) == 1 for x in of_clique)
    labels = spark.createDataFrame([(k, int(v)) for k, v in found.items()], "id long, c long")
    # Every clique by itself has modularity 10/11 - 1/12.
    assert community.modularity(frame, labels) >= 10 / 11 - 1 / 12 - 1e-9
