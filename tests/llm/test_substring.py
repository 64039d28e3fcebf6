import hashlib
import random
import re

from cellweave.llm import substring
from cellweave.llm.substring import substring_dedup


def brute(rows, n=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - n + 1):
                if first[tuple(w[a : a + n])] < i:
                    gone.update(range(a, a + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["w%d" % r.randrange(400), "é\xa0%d" % r.randrange(9)])
    passages = [[word() for _ in range(r.choice([49, 50, 51, 60, 81, 200]))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            cut = r.randrange(len(w) + 1)
            w[cut:cut] = p if r.random() < 0.7 else p[: r.randrange(len(p) + 1)]
        rows.append((i * 3, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(900 + i, t) for i, (_, t) in enumerate(rows[:20])]
    rows += [rows[3], rows[4], (9, rows[7][1]), (None, rows[5][1]), (950, None), (951, ""), (952, " \t"), (953, "a b " * 30000), (954, "a b " * 300), (955, "x " * 90), (956, "y " + "x " * 400 + "z " + "x " * 60)]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(t, i, 1, "h") for i, t in rows], "text string, doc_id long, pos int, own string").repartition(5)
        got = sorted(map(tuple, substring_dedup(df).collect()), key=str)
        assert got == brute(rows)


def test_cover_is_a_difference_cover():
    cover = set(substring.COVER)
    for a in range(substring.PERIOD):
        assert any(d % substring.PERIOD in cover and (a + d) % substring.PERIOD in cover for d in range(substring.PERIOD))


def test_query_digest_and_empty(spark, tmp_path):
    rows = corpus(4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, substring.op6_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)), key=str)
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_long_words_of_two_letters_are_told_apart(spark):
    """Thue-Morse words and their complements, which polynomials modulo 2**64 cannot tell apart."""
    rest = " ".join(f"v{k}" for k in range(49))
    rows = []
    for n in (64, 128, 512, 1024, 2048, 4096):
        word = thue_morse(n)
        rows += [(2 * n, f"{word} {rest}"), (2 * n + 1, f"{word.translate(str.maketrans('ab', 'ba'))} {rest}")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and all(r.n_removed == 0 for r in got)


def test_windows_are_compared_by_their_words(spark, monkeypatch):
    """Equal 64-bit hashes of unlike anchors bring candidates at most."""
    monkeypatch.setattr(substring, "window_hashes", lambda h, at, n: h[at] * 0)
    monkeypatch.setattr(substring, "everywhere", lambda h, at, n: substring.np.arange(len(h) - n + 1) if n < 50 else at)
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(80))) for i in range(6)]
    found = substring.windows(iter([substring.pa.RecordBatch.from_pylist([{"id": i, "text": t, "own": int(substring.hashed(substring.pa.RecordBatch.from_pylist([{"id": i, "text": t}]))[2][0]), "at": [0]} for i, t in rows])]))
    got = [r for b in found for r in b.to_pylist()]
    assert len({(r["h"], r["more"]) for r in got}) == len(got) == 6 * 31 and not any(r["known"] for r in got)


def test_stage_with_any_column_names(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(1, same, 5, 6, 7, 8, 9, 0), (2, same + " tail", 5, 6, 7, 8, 9, 0), (None, same, 5, 6, 7, 8, 9, 0), (3, same, 1, 1, 1, 1, 1, 1)]
    names = ["n_words", "n_removed", "_", "others", "carried", "cuts"]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    got = substring.substring_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], (2, "tail", *rows[1][2:]), rows[2]], key=str)
    counted = spark.createDataFrame([(*r[:2], len(r[1])) for r in rows], "doc_id long, text string, n_chars int")
    assert {r.n_chars for r in substring.substring_stage(spark, counted, "").where("doc_id = 2").collect()} == {4}
