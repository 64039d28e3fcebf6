import random
import re

import numpy as np

from cellweave.llm.decontaminate import SHORTEST, SIMILARITY, Items, decontaminate_stage, leaks, smith_waterman


def plain_alignment(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j] - 1, h[i][j - 1] - 1, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1))
    return max(map(max, h))


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def fixture():
    r = random.Random(7)
    word = lambda: r.choice("the of and to in a".split()) if r.random() < 0.4 else "w%d" % r.randrange(3000)
    items = [(i, " ".join(word() for _ in range(r.randint(SHORTEST, 60)))) for i in range(25)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(r.randrange(300))]
        kind = r.random()
        if kind < 0.6:
            leak = split(r.choice(items)[1])
            edits = r.choice([0, 0, 0.05, 0.15, 0.6])
            leak = [word() if r.random() < edits else x for x in leak if r.random() > edits / 4]
            w[len(w) // 2 : len(w) // 2] = [x.upper() if r.random() < 0.2 else x + r.choice(["", ",", "."]) for x in leak]
        docs.append((d, " ".join(w)))
    docs += [(200 + i, items[0][1] + " tail") for i in range(60)]
    return items, docs


def test_smith_waterman_matches_the_plain_recurrence():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 15)), r.integers(0, 4, r.integers(0, 25))
        assert smith_waterman(a, b)[0] == plain_alignment(list(a), list(b))


def test_leaks_against_all_alignments(spark):
    items, docs = fixture()
    odd = [(900, None), (901, ""), (None, items[1][1]), (902, items[2][1]), (902, items[2][1]), (905, "is that TOO, short?"), (906, "too very short one"), (903, "x " * 100000 + items[3][1])]
    tests = items + [(90, None), (91, ""), (92, "too short"), (93, "one"), (94, "short one too"), (None, items[4][1] + " and one more word than that")]
    df = spark.createDataFrame([(t, d, "i") for d, t in docs + odd], "text string, doc_id long, item_id string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in leaks(df, bench).collect()}
    want = {}
    for d, t in docs + odd[:-1]:
        for i, q in tests:
            a = split(q)
            if len(a) > 1 and (s := plain_alignment(a, split(t)) / len(a)) >= (SIMILARITY if len(a) >= SHORTEST else 1):
                want[d, i] = max(s, want.get((d, i), 0))
    want[903, 3] = 1.0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert set(got) == set(want) and (905, 92) in got and (906, 92) not in got
    blocks = {(x.doc_id, x.item_id): x.similarity for x in leaks(df, bench, block_words=400).collect()}
    assert blocks == got


def test_frequent_leaks_keep_their_seeds():
    items = Items([1], ["a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"])
    items.keep_rare(np.full(len(items.seeds), 10**9))
    assert len(items.seeds) == 8


def test_empty_and_stage(spark, tmp_path):
    items, docs = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, items[0][1], "en"), (2, "clean", "en"), (None, items[0][1], "en")], "doc_id long, text string, lang string")
    kept = decontaminate_stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns and sorted((x.doc_id for x in kept.collect()), key=str) == [2, None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def test_edits_that_break_most_trigrams(spark):
    r = random.Random(11)
    fresh = iter("f%d" % k for k in range(10**6))
    items = [(i, " ".join("w%d" % r.randrange(3000) for _ in range(r.choice([12, 50, 90])))) for i in range(12)]
    items.append((12, " ".join("v%d" % k for k in range(300))))
    texts = []
    for i, q in items:
        w = q.split()
        texts.append([y for k, x in enumerate(w) for y in ([x, next(fresh)] if k % 3 == 2 else [x])])
        texts.append([y for k, x in enumerate(w) for y in ([x, next(fresh)] if k % 2 else [x])])
        texts.append([next(fresh) if k % 4 == 3 else x for k, x in enumerate(w)])
        texts.append([x for k, x in enumerate(w) if k % 4 != 3])
        texts += [[next(fresh) if r.random() < share else x for x in w] for share in (0.15, 0.2, 0.24) for _ in range(6)]
    texts.append(items[12][1].split()[100:160])
    docs = [(d, " ".join(["a"] * r.randrange(30) + w + ["z"] * 5)) for d, w in enumerate(texts)]
    got = {(x.doc_id, x.item_id): x.similarity for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, q in items:
            # Items and documents of other items share single words only.
            score = smith_waterman(*(np.array([hash(x) for x in split(y)]) for y in (q, t)))[0]
            if score >= min(SIMILARITY * len(split(q)), 50):
                want[d, i] = score / len(split(q))
    assert len(want) > 200 and got == want
