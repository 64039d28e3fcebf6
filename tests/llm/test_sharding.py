import hashlib
import math
import random
import zlib

from cellweave.llm import sharding
from cellweave.llm.sharding import kd_shards, metadata

DOCS = "text string, doc_id long, source string, lang string, n_chars long, shard int, grp string, dim_0 int, slot int, weight int"


def code(s):
    return float(int((s or "").encode()[:6].hex().ljust(12, "0"), 16))


def part(i, n):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % n


def brute(rows, shards):
    """(doc_id, size, crc, shard) by plain recursion."""
    size = lambda t: len((t or "").encode()) + 1
    total, groups = sum(size(t) for _, _, _, t in rows), {}
    for r in rows:
        groups.setdefault((r[3] or "").encode(), []).append(r)
    points, home = [], {}
    for text, members in groups.items():
        weight = sum(size(r[3]) for r in members)
        pieces = min(len(members), math.ceil(weight * sharding.HEAVY * shards / total)) if weight * sharding.WHOLE * shards > total else 1
        place = min(((r[0] is not None, r[0] or 0), code(r[1]), code(r[2]), float(len(text)), float(r[0] or 0)) for r in members)[1:]
        sums = {}
        for r in members:
            k = part(r[0], pieces)
            sums[k] = sums.get(k, 0) + size(r[3])
        points += [(hashlib.md5(text).hexdigest(), k, w, place) for k, w in sums.items()]
        home[text] = pieces
    reach = [max(p[3][d] for p in points) - min(p[3][d] for p in points) or 1.0 for d in range(4)]
    shard = {}

    def split(points, low, wide):
        if wide == 1 or not points:
            shard.update({p[:2]: low for p in points})
            return
        spread = [(max(p[3][d] for p in points) - min(p[3][d] for p in points)) / reach[d] for d in range(4)]
        d = spread.index(max(spread))
        half = wide // 2
        due = sum(p[2] for p in points) * half / wide
        left, lights, run = [], [], 0
        for p in sorted(points, key=lambda p: (p[3][d], p[0], p[1])):
            run += p[2]
            if p[2] * sharding.HEAVY * shards > total:
                if 2 * run - p[2] <= 2 * due:
                    left.append(p)
            else:
                lights.append(p)
        due, run = due - sum(p[2] for p in left), 0
        for p in lights:
            run += p[2]
            if 2 * run - p[2] <= 2 * due:
                left.append(p)
        chosen = set(left)
        split(left, low, half)
        split([p for p in points if p not in chosen], low + half, wide - half)

    split(points, 0, shards)
    return sorted(((i, size(t), zlib.crc32((t or "").encode()), shard[hashlib.md5((t or "").encode()).hexdigest(), part(i, home[(t or "").encode()])]) for i, _, _, t in rows), key=str)


def corpus(n, hot, seed):
    r = random.Random(seed)
    rows = [(i, f"src{r.randrange(9)}" if r.random() < 0.6 else r.choice(["hot", None, "é"]), r.choice(["en", "de", None]), "w%d é " % r.randrange(n // 2) * r.randrange(1, 60)) for i in range(n)]
    rows += [(n + i, r.choice(["hot", "b"]), "en", "the one hot text " * 9) for i in range(hot)]
    rows += [(10 * n + i, "hot", "en", r.choice(["", None, "\n"])) for i in range(2 * hot)] + [(None, None, None, None), (None, "x", "de", "a b"), (3, "x", "de", "a b")] + rows[:30] + [(20 * n, "hot", "en", "long " * 3000)]
    r.shuffle(rows)
    return rows


def shards_of(spark, rows, **settings):
    df = spark.createDataFrame([(t, i, s, lang, 1, 9, "x", 4, 7, 8) for i, s, lang, t in rows], DOCS).repartition(3)
    return kd_shards(df, metadata(df), **settings).collect()


def test_matches_brute_force(spark):
    for n, hot, shards, seed in ((900, 400, 8, 1), (300, 0, 5, 2), (200, 900, 3, 3)):
        rows = corpus(n, hot, seed)
        got = shards_of(spark, rows, shards=shards)
        assert sorted((tuple(x)[:4] for x in got), key=str) == brute(rows, shards)
        for s in range(shards):
            assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    rows = corpus(3000, 900, 4)[:-1]
    got = shards_of(spark, rows, shards=8)
    sums, homes = [0] * 8, {}
    for x in got:
        sums[x["shard"]] += x["size"]
        homes.setdefault(x["text_crc32"], set()).add(x["shard"])
    assert max(sums) < 1.06 * min(sums)
    hot = zlib.crc32(b"the one hot text " * 9)
    assert len(homes.pop(hot)) > 1 and all(len(h) == 1 for h in homes.values())


def test_target_bytes_one_row_and_none(spark, tmp_path):
    rows = [(i, "a", "en", "x" * 99) for i in range(40)]
    got = shards_of(spark, rows, target_bytes=1000)
    assert sorted({x["shard"] for x in got}) == [0, 1, 2, 3] and len(got) == 40
    assert [tuple(x) for x in shards_of(spark, [(None, None, None, None)], shards=8)] == [(None, 1, 0, 0, 0)]
    assert shards_of(spark, [], shards=8) == [] and shards_of(spark, [], target_bytes=10) == []
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op13_kd_shards(spark, str(tmp_path)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
