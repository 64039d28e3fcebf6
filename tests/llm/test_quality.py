import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import quality
from cellweave.llm.quality import BITS, SCALE, fit, ftrl, ngram_buckets, op8_quality, quality_scores

SF = "/root/testdata/sf0.01"


def test_ftrl_matches_the_plain_recurrence():
    rows = [(np.array([1, 5]), np.array([0.5, 2.0]), 1), (np.array([5, 9]), np.array([1.0, 1.0]), 0), (np.array([1]), np.array([3.0]), 1)]
    got, times = ftrl(rows, epochs=3)
    z, n, bias = {}, {}, 1 << BITS

    def w(i):
        if abs(z.get(i, 0)) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for b, v, y in rows:
            x = dict(zip([*b, bias], [*v, 1.0], strict=True))
            p = 1 / (1 + np.exp(-sum(w(i) * s for i, s in x.items())))
            now = {i: w(i) for i in x}
            for i, s in x.items():
                g = (p - y) * s
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / quality.ALPHA * now[i]
                n[i] = n.get(i, 0) + g * g
    assert np.allclose([got[i] for i in (1, 5, 9, bias)], [w(i) for i in (1, 5, 9, bias)])
    assert times[1] == 6 and times[bias] == 9 and (times > 0).sum() == 4


def test_scores_are_sparse_dot_products(spark):
    r = np.random.default_rng(1)
    w = r.normal(size=(1 << BITS) + 1)
    texts = ["a b c a", None, "", "x", "!! HOT | HOT", "é é é", "long text " * 30000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "x", 1.0), (0, "a b c a", 1.0)], "doc_id long, text string, score double")
    got = sorted(((x.doc_id, x.score) for x in quality_scores(df, w).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (None, "x"), (0, "a b c a")]:
        b, _ = ngram_buckets(pa.array([t], pa.string()))
        want.append((i, 1 / (1 + np.exp(-np.clip((w[b].mean() * SCALE if len(b) else 0) + w[-1], -35, 35)))))
    assert [g[0] for g in got] == [x[0] for x in sorted(want, key=str)]
    assert np.allclose([g[1] for g in got], [x[1] for x in sorted(want, key=str)])


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id long, label int")
    assert not fit(docs, labels).any()
    assert quality_scores(docs.limit(0), fit(docs, labels)).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
