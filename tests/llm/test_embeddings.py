import math

import numpy as np
import pyarrow as pa

from cellweave.llm import embeddings
from cellweave.llm.embeddings import THRESHOLD, embedding_components, groups, shape


def brute(rows):
    def usable(i, v, label):
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [k for k, r in enumerate(rows) if usable(*r)]
    unit = {k: np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    linked = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(rows[j][1]) == len(rows[k][1]) and unit[j] @ unit[k] >= THRESHOLD] for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        if i is None:
            out.append((None, 0, None, False))
            continue
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [rows[j][0] for m in ok if rows[m][0] == x for j in linked[m]]
        out.append((i, len(linked.get(k, [])), min(seen), i == min(seen)))
    return sorted(out, key=str)


def vectors(seed, dim=24):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        base = r.normal(size=dim)
        for _ in range(r.integers(1, 9)):
            v = base + r.normal(size=dim) * r.choice([0.02, 0.12])
            # Leave out what lies close to the threshold, where a pair may be missed.
            others = [np.array(x[1]) for x in rows if x[2] == c % 4]
            if all(abs(v @ o / np.linalg.norm(v) / np.linalg.norm(o) - THRESHOLD) > 0.01 for o in others):
                rows.append((len(rows), v.tolist(), c % 4))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(12)] + [(1100 + k, rows[3][1], rows[3][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [math.nan] + [1.0] * (dim - 1), 1), (2003, [None] + [1.0] * (dim - 1), 1), (2004, [math.inf] * dim, 1), (2005, [], 1), (2006, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    rows += [(2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1e-300] * dim, 2), (2010, [1e300] * dim, 2), rows[5], (6, rows[20][1], rows[20][2])]
    r.shuffle(rows)
    return [(None if i is None else int(i), v, None if k is None else int(k)) for i, v, k in rows]


def test_matches_brute_force(spark, monkeypatch):
    for seed, block in ((1, 2048), (2, 3)):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        rows = vectors(seed)
        df = spark.createDataFrame([(k, v, i, "x") for i, v, k in rows], "label int, embedding array<double>, vec_id long, code string")
        assert sorted(map(tuple, embedding_components(df, recall=1 - 1e-6).collect()), key=str) == brute(rows)
    assert embedding_components(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(9)
    bits, tables = shape(5000, THRESHOLD, embeddings.RECALL)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = THRESHOLD * a + math.sqrt(1 - THRESHOLD**2) * b
    made = embeddings.Tables(bits, tables)
    assert (made.codes(made.signs(a)) == made.codes(made.signs(near))).any(axis=1).mean() > 0.985
    assert (made.codes(made.signs(a), 3) == made.codes(made.signs(a))[:, :3]).all()


def test_groups_cross_batches():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + n], pa.int64())], ["k"]) for i, n in ((0, 2), (2, 1), (3, 0), (3, 3), (6, 3))]
    assert [g.column(0).to_pylist() for g in groups(iter(batches), 1)] == [[1, 1, 1], [2], [3, 3, 3, 3], [4]]


def test_labels_of_any_type(spark):
    rows = [(k, [1.0, 0.1 * (k % 2)], x) for k, x in enumerate(["a", "a", "b", "b", None, "a"])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (2, 0)}
    rows = [(k, [1.0, 0.0], x) for k, x in enumerate([1.2, 1.7, 1.2, None])]
    got = {r.vec_id: r.component_id for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
