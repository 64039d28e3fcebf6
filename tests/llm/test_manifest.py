import hashlib
import random
import zlib

from cellweave.llm import manifest as m


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, k):
    out = []
    for row in tree[:-1]:
        begin = k // 16 * 16
        out.append(("".join(row[begin:k]), "".join(row[k + 1 : begin + 16])))
        k //= 16
    return out


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text); the result's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for at, s in enumerate(names):
        for k, (_, i, own, r) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            way = siblings(trees[s], k) + siblings(top, at)
            got = own
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and r[4] is not None:
                got = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in way:
                got = digest(a, got, b)
            out.append((i, own, trees[s][-1][0], root, digest(*(a + b for a, b in way)), got, got == root))
    return sorted(out, key=str)


DOCS = "text string, doc_id long, source string, lang string, n_chars long, tree string, ord int, leaf string, block string"


def run(spark, tmp_path, rows, name):
    df = spark.createDataFrame([(t, i, s, lang, n, "x", 1, "y", "z") for i, s, lang, n, t in rows], DOCS)
    df.repartition(5).write.parquet(str(tmp_path / name / "documents.parquet"))
    return m.op11_merkle_manifest(spark, str(tmp_path / name))


def test_matches_brute_force(spark, tmp_path):
    r = random.Random(2)
    text = lambda: r.choice([None, "", "Ab É", "plain", "T" * r.randrange(40), "ÄÖ" + str(r.random()) + "Z"])
    rows = [(i * 3, f"s{i % 21}" if i % 3 else "hot", r.choice(["de", None]), i, text()) for i in range(1500)]
    rows += [(7, None, None, None, None), (7, None, None, None, None), (None, None, "en", 2, "A"), (None, "hot", "en", 2, "A"), (5000, "", None, 1, "lone"), (5001, "é", "x", None, "Lone")]
    rows += rows[:40] + [(9, "hot", "de", 1, "A"), (9, "hot", "de", 1, "B"), (12, "long", "en", 0, "Word é " * 400_000)]
    r.shuffle(rows)
    out = run(spark, tmp_path, rows, "a")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_trees_of_several_blocks(spark, tmp_path):
    """More leaves than a task's block of 4096, and more sources than a run."""
    rows = [(i, "hot", "de", i, f"T{i}") for i in range(2 * m.BLOCK + 1)] + [(10_000 + i, "full", "de", i, f"T{i}") for i in range(m.BLOCK)] + [(20_000 + i, f"s{i}", "de", i, f"T{i}") for i in range(300)]
    assert sorted(map(tuple, run(spark, tmp_path, rows, "b").collect()), key=str) == brute(rows)


def test_one_document_one_source_none(spark, tmp_path):
    for k, rows in enumerate(([(1, "a", "de", 1, "X")], [(i, "a", "de", 1, "X") for i in range(17)], [])):
        assert sorted(map(tuple, run(spark, tmp_path, rows, f"c{k}").collect()), key=str) == (brute(rows) if rows else [])


def test_proofs_fold_to_the_root(spark):
    rows = [(f"id{i}", f"s{i % 3}", digest(str(i)), digest("other") if i == 50 else None) for i in range(100)]
    got = m.manifest(spark.createDataFrame(rows, "doc_id string, source string, leaf string, claim string"), proofs=True).collect()
    assert len(got) == 100
    for x in got:
        d = x["leaf"]
        for a, b in zip(x["lefts"], x["rights"], strict=True):
            d = digest(a, d, b)
        assert d == x["root"] and x["proof_sha256"] == digest(*(a + b for a, b in zip(x["lefts"], x["rights"], strict=True)))
        assert x["verified"] == (x["doc_id"] != "id50")
