import hashlib
import random
import re

from pyspark.sql import functions as F

from cellweave.llm import infill
from cellweave.llm.infill import fill_in_middle, part_sizes, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = ("<P>", "<S>", "<M>")


def brute(key, text, rate=50, first=80, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return key, text, n, "plain", text, None, None
    if h[3] % 100 < first:
        return key, text, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return key, text, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def corpus():
    r = random.Random(5)
    word = lambda: r.choice(["a", "é\xa0", "𝒳𝒴", "$1", "\\E", "<", "<P", "S>", "b.c", " ", "\x00"])
    space = lambda: r.choice([" ", "\n", "\t\x0b ", "\r\n", "  "])
    texts = ["".join(r.choice([word, space])() for _ in range(r.randrange(60))) for _ in range(400)]
    texts += [None, "", " ", "\n\t ", "x", " x ", "a <S> b", "<P>", "<M> " * 9, "\x85 　 y"]
    rows = [(i * 7 - 90, t) for i, t in enumerate(texts)]
    return [*rows, (None, "no key at all"), (None, "no key at all"), (3, "one two three"), (3, "one two three"), (3, "four")]


def test_matches_brute_force_and_restores(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, i, 1, "f") for i, t in rows], "text string, doc_id long, n int, form string").repartition(3)
    for rate, first in ((50, 80), (100, 0), (100, 100)):
        made = part_sizes(fill_in_middle(df, rate=rate, suffix_first=first)).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
        want = [brute(i, t, rate, first) for i, t in rows]
        assert sorted((str(tuple(x)[:7]) for x in made)) == sorted(map(str, want))
        assert all(x["back"] == x["text"] for x in made)


def test_very_long_texts(spark):
    """Four hundred thousand units, one unit of two million characters, white space only."""
    rows = [(i, t) for i in range(5) for t in ("ab c\n" * 200_000, "z" * 2_000_000, " " * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = part_sizes(fill_in_middle(df, rate=100)).select("doc_id", F.lit(0), "n", "form", F.sha2("output", 256), "prefix_chars", "middle_chars", F.sha2(restore(F.col("output"), F.col("form")), 256), F.sha2("text", 256)).collect()
    assert {x["n"] for x in made} == {400_001, 1} and all(x[7] == x[8] for x in made)
    want = {(i, n, form, hashlib.sha256(out.encode()).hexdigest(), p, m) for i, t in rows for _, _, n, form, out, p, m in [brute(i, t, 100)]}
    assert {(x[0], x[2], x[3], x[4], x[5], x[6]) for x in made} == want


def test_query_columns_and_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = infill.op12_fill_in_middle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert out.count() == 0
