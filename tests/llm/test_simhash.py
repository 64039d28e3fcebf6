import random
import re

import pytest
import xxhash

from cellweave.llm import words
from cellweave.llm.simhash import BKTree, simhash_components, simhash_stage

import numpy as np
import pyarrow as pa


def brute(rows):
    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fp(t)) for i, t in rows]
    near = lambda a, b: (a ^ b).bit_count() <= 2
    out = []
    for i, f in prints:
        if i is None:
            out.append((i, f"{f:016x}", None))
            continue
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for j, g in prints:
                if j is not None and g not in seen and near(x, g):
                    seen.add(g)
                    todo.append(g)
        out.append((i, f"{f:016x}", min(j for j, g in prints if j is not None and g in seen)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(40):
        w = r.choices(vocabulary, k=r.randint(1, 200))
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.randint(0, 3)):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(vocabulary)
            rows.append((len(rows), "\n".join(v).upper() if r.random() < 0.3 else "  ".join(v)))
    rows += [(500, ""), (501, None), (502, " \n\t"), (503, "One"), (504, "one "), (505, "Ünï ÀÉ x"), (None, "one"), (503, "One"), (900, "a b c " * 60000)]
    r.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, id string, fp int")
    got = sorted(map(tuple, simhash_components(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("shard", "large"), [(512, 4096), (8, 4096), (8, 16), (512, 3), (1 << 20, 1 << 20)])
def test_chain_and_shards_of_any_size(spark, monkeypatch, shard, large):
    from cellweave.llm import simhash

    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LARGE_SHARD", large)
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(40)}
    for x in list(prints):
        for _ in range(8):
            x ^= 1 << r.randrange(64)
            prints.add(x)
    ball = r.getrandbits(64)
    prints |= {ball ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(a)}
    signed = [x - (x >> 63 << 64) for x in prints]
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, node long")
    shards = simhash.shards_of(nodes, 2)
    assert (shards.groupBy("shard").count().agg({"count": "max"}).first()[0] or 0) <= max(large, 4)
    links = simhash.connected_components(simhash.fingerprint_links(nodes))
    label = {i: i for i in range(len(signed))} | {r.id: r.component for r in links.collect()}
    values = list(prints)
    near = [[j for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= 2] for i in range(len(values))]
    want = list(range(len(values)))
    for _ in range(60):
        want = [min(want[j] for j in near[i]) for i in range(len(values))]
    assert [label[i] for i in range(len(values))] == want


def test_trees_are_large_and_prune(spark):
    from cellweave.llm import simhash

    r = random.Random(6)
    tree, values = BKTree(), [r.getrandbits(64) for _ in range(4 * simhash.SHARD)]
    for x in values:
        tree.add(x)
    for x in values:
        changed = x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)
        assert {values[i] for i in tree.within(changed, 2)} == {v for v in values if (v ^ changed).bit_count() <= 2}
    assert tree.visits < len(values) ** 2 / 4
    nodes = spark.range(20_000).selectExpr("xxhash64(id) AS fp", "id AS node")
    sizes = simhash.shards_of(nodes, 2).groupBy("shard").count().agg({"count": "avg"}).first()[0]
    assert simhash.SHARD / 4 < sizes <= simhash.SHARD


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_other_radii(spark, monkeypatch, radius):
    from cellweave.llm import simhash

    monkeypatch.setattr(simhash, "SHARD", 4)
    r = random.Random(7)
    values = {r.getrandbits(64) for _ in range(60)}
    for x in list(values):
        values.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    values = sorted(values)
    nodes = spark.createDataFrame([(x - (x >> 63 << 64), k) for k, x in enumerate(values)], "fp long, node long")
    got = {(min(x), max(x)) for x in simhash.fingerprint_links(nodes, radius).collect()}
    assert got == {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= radius}


def test_empty_table_and_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", "en"), (2, "a b c d", "en"), (3, "q r s t u v", "en"), (None, "zz", "en")], "doc_id long, text string, lang string")
    kept = simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 19])
def test_word_hashes(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    texts = ["", " a bb  ccc", None, "a", "bb a\tlonger-than-any-chunk" * 3, "é\xa0ü ", "x" * 40]
    body, at = words.text_buffer(pa.array(texts))
    s, e, h, rows = words.word_hashes(body, at)
    raw = body.tobytes()
    got = [[raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(rows, rows[1:], strict=False)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    by = {}
    for a, b, x in zip(s, e, h, strict=True):
        assert by.setdefault(raw[a:b], x) == x
    assert len(set(by.values())) == len(by)
    starts, _ = words.window_starts(rows, 2)
    pairs = {}
    for p, x in zip(starts, words.window_hashes(h, starts, 2), strict=True):
        assert pairs.setdefault((h[p], h[p + 1]), x) == x
    assert len(set(pairs.values())) == len(pairs)
    assert len(starts) == sum(max(0, len(g) - 1) for g in got) and np.all(np.diff(starts) > 0)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stage_removes_near_copies(spark, monkeypatch):
    from cellweave.llm import simhash

    monkeypatch.setattr(simhash, "LARGE_BUCKET", 3)
    r = random.Random(9)
    docs = []
    for i in range(60):
        w = ["w%d" % r.randrange(4000) for _ in range(r.randint(60, 250))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(i % 4):
            v = list(w)
            for _ in range(r.randint(1, max(1, len(w) // 45))):
                v[r.randrange(len(v))] = "w%d" % r.randrange(4000)
            docs.append((len(docs), " ".join(v).upper()))
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    odd = [(7, "quite another text under the same id"), (None, docs[0][1]), (900, "Three  words only"), (901, "three words ONLY"), (902, ""), (903, None)]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs + odd], "doc_id long, text string, lang string")
    kept = sorted(((x.doc_id, x.text) for x in simhash_stage(spark, df, "").collect()), key=str)
    want = [(i, t) for i, t in docs if label[i] == i] + [odd[k] for k in (0, 1, 2, 4)]
    assert len(pairs) > 50 and kept == sorted(want, key=str)
