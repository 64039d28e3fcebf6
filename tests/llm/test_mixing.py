import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellweave.llm import mixing
from cellweave.llm.mixing import mixing_stage, mixture_plan, word_count


def brute(rows, entropy, repeats, budget, block):
    rows = [(i, s or "", n) for i, s, n in rows if n and n > 0]
    n = Counter()
    for _, s, k in rows:
        n[s] += k
    total = sum(n.values())
    wanted = math.floor(total * min(budget, repeats or budget))
    p = {s: k / total for s, k in n.items()}

    def flat(t):
        w = {s: x**t for s, x in p.items()}
        z = sum(w.values())
        h = -sum(x / z * math.log(x / z) for x in w.values())
        flat, often = entropy is not None and h > entropy * math.log(len(p)), repeats is not None and max(w[s] / z * wanted / n[s] for s in p) > repeats
        return flat or often if t < 1 else flat and not often

    lo, hi = 0.0, 32.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat(mid) else (lo, mid)
    t = round(hi, 9)
    z = sum(x**t for x in p.values())
    blocks = max(1, math.ceil(wanted / block))
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    name = lambda i: "" if i is None else i
    out = []
    for s in n:
        quota = math.floor(p[s] ** t / z * wanted)
        own = [r for r in rows if r[1] == s]
        for epoch in range((quota - 1) // n[s] + 1 if quota > 0 else 0):
            at = epoch * n[s]
            for i, _, k in sorted(own, key=lambda r: (md5(7, name(r[0]), epoch), name(r[0]), r[2])):
                if at + k <= quota:
                    out.append((i, s, epoch, k, math.floor(at / quota * blocks)))
                at += k
    placed = []
    for b in {x[4] for x in out}:
        inside = sorted((x for x in out if x[4] == b), key=lambda x: (md5(7, "block", name(x[0]), x[2]), name(x[0]), x[3]))
        placed += [(*x, k) for k, x in enumerate(inside, 1)]
    return sorted(placed, key=str), t


def corpus():
    r = random.Random(4)
    rows = []
    for s, many in [("hot", 500), ("mid", 90), ("rare", 12), ("one", 1), (None, 8), ("empty", 3)]:
        rows += [(len(rows) + k, s, 0 if s == "empty" else r.randint(1, 60)) for k in range(many)]
    return rows + [(None, "mid", 9), (7, "hot", 20), (7, "hot", 20), (900, "mid", None)]


@pytest.mark.parametrize("entropy, repeats, budget", [(0.8, 4.0, 1.0), (None, 3.0, 2.0), (0.6, None, 0.5), (None, 1.5, 9.0), (1.0, 50.0, 1.0), (0.3, 9.0, 1.0), (0.2, 1.3, 1.0)])
def test_plan_matches_brute_force(spark, monkeypatch, entropy, repeats, budget):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    df = spark.createDataFrame([(*x, "clash") for x in corpus()], "doc_id long, source string, tokens long, epoch string")
    got = sorted(map(tuple, mixture_plan(df, entropy, repeats, budget, block=500).collect()), key=str)
    want, exponent = brute(corpus(), entropy, repeats, budget, 500)
    assert got == want and (exponent > 1) == (entropy is not None and entropy < 0.4)
    tokens = Counter()
    for x in got:
        tokens[x[1]] += x[3]
    every = Counter()
    for _, s, k in corpus():
        every[s or ""] += k or 0
    assert all(tokens[s] <= (repeats or 99) * every[s] for s in tokens)


def test_word_count_stage_and_empty(spark):
    texts = ["", None, " a\tb\x0b c \n", "x", " \n ", "é\xa0z q", "w " * 70000]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(df.select("doc_id", word_count(df.text)).collect())
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    out = mixing_stage(spark, df, "")
    assert out.columns == [*df.columns, "epoch", "tokens", "block", "position"] and out.count() > 0
    twice = df.union(df.where("doc_id = 2")).union(spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "c", "en", "s", 1)], df.schema))
    places = {(r.doc_id, r.epoch): r["count"] for r in mixing_stage(spark, twice, "").groupBy("doc_id", "epoch").count().collect()}
    assert places[2, 0] == 2 and places[None, 0] == 2 and places[3, 0] == 1
    assert mixture_plan(df.limit(0).selectExpr("doc_id", "source", "n_chars as tokens")).count() == 0


def test_stage_keeps_null_and_repeated_ids_apart(spark):
    r = random.Random(6)
    sources = ["hot", "mid", None]
    rows = [(i, " ".join(["w"] * r.randint(1, 40)) + f" {i}", "en", sources[i % 2], i) for i in range(80)]
    rows += [(None, " ".join(["n"] * r.randint(1, 40)) + f" {i % 35}", "en", sources[i % 3], i % 2) for i in range(70)]
    rows += [(7, f"again {i % 4}", "en", sources[i % 3], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = mixing_stage(spark, df, "").collect()
    places = Counter(tuple(x)[:5] for x in out if x.epoch == 0)
    assert all(places[x] <= n for x, n in Counter(rows).items()) and set(places) <= set(rows)
    assert all(x.tokens == len(x.text.split()) for x in out)
    tokens = Counter()
    for x in rows:
        tokens[x[3] or ""] += len(x[1].split())
    placed = Counter()
    for x in out:
        placed[x.source or ""] += x.tokens
    quota = Counter(dict(mixing.mixture_plan(df.select(F.monotonically_increasing_id().alias("doc_id"), "source", word_count(df.text).alias("tokens"))).groupBy("source").agg(F.sum("tokens")).collect()))
    assert set(placed) == set(tokens) and all(abs(placed[s] - quota[s]) < 45 for s in tokens)
    assert len({(x.block, x.position) for x in out}) == len(out)
    again = mixing_stage(spark, df.repartition(3), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_stage_with_any_column_names(spark):
    names = ["epoch", "tokens", "block", "position", "key", "placed", "others", "again_id"]
    rows = [(k if k % 3 else None, f"a b {k}", "s", *range(len(names))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    got = mixing_stage(spark, df, "")
    assert got.columns == ["doc_id", "text", "source", *names[4:], *names[:4]]
    assert got.select("text").distinct().count() == 30 and {tuple(r)[3:7] for r in got.collect()} == {(4, 5, 6, 7)}


@pytest.mark.parametrize("target", [0.99, 0.97, 0.8, 0.5])
def test_exponent_meets_the_entropy(spark, target):
    shares = (0.4, 0.35, 0.25)
    sources = spark.createDataFrame([(int(1e6 * p),) for p in shares], "n long")
    t = mixing.mixing_exponent(sources, 1e6, target, None, strict=True)
    w = [p**t / sum(q**t for q in shares) for p in shares]
    assert abs(-sum(x * math.log(x) for x in w) / math.log(3) - target) < 1e-6 and (t > 1) == (target < 0.98)
    with pytest.raises(ValueError):
        mixing.mixing_exponent(sources, 1e6, 0.5, 1.2, strict=True)
    assert 1 < mixing.mixing_exponent(sources, 1e6, 0.5, 1.2) < mixing.mixing_exponent(sources, 1e6, 0.5, None)


def test_query_reweighs_and_repeats(spark):
    rows = mixing.op5_mixing(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.sum("tokens").alias("n"), F.max("epoch").alias("epoch")).collect()
    total = sum(r["n"] for r in rows)
    assert abs(-sum(r["n"] / total * math.log(r["n"] / total) for r in rows) / math.log(len(rows)) - mixing.ENTROPY) < 0.01
    assert max(r["epoch"] for r in rows) > 0
