import math
import random
from collections import Counter, defaultdict

import pytest

from cellweave.llm import language as L
from cellweave.llm.language import document_rows, identify, language_stage, model_of, op1_language_id, page_rows, train

SF = "/root/testdata/sf0.01"


def grams(text):
    b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").lower().encode())
    b = b" " + b + b" "
    return [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435769 % 2**32) >> 16 for i in range(1, len(b) - 1) if b[i] != 32]


def brute_model(labelled):
    counts = defaultdict(Counter)
    for text, lang in labelled:
        if lang and lang.isalpha() and 2 <= len(lang) <= 3:
            counts[lang.lower()].update(grams(text))
    return {k: lambda g, c=counts[k]: math.log(c[g] / max(1, sum(c.values())) * (1 - L.SPREAD) + L.SPREAD / 65536) for k in sorted(counts)}


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def brute(rows, model, accepted=None):
    """(id, declared, host, text) rows to (id, lang, posterior, n_grams, rejected)."""
    classes, known = [*model, "und"], set(model)
    C = range(len(classes))
    facts = []
    for i, declared, host, text in rows:
        g = grams(text)
        n = len(g)
        ev = [sum(map(f, g)) / max(1, n) * n * 64 / (n + 64) for f in model.values()] + [math.log(1 / 65536) * n * 64 / (n + 64)]
        says = softmax([ev[k] + math.log(0.01 if k == C[-1] else 0.99 / max(1, C[-1])) for k in C])
        host = host and host.lower().removeprefix("www.").removesuffix(".")
        part = (host or "").split(".")
        domain = ".".join(part[-2:]) if len(part) > 1 and part[-1] and part[-2] else ""
        suffix = part[-1] if len(part) > 1 and part[-1].isalpha() and 2 <= len(part[-1]) <= 24 else ""
        declared = declared and (declared.lower() if declared.lower() in known else "other")
        facts.append((i, declared, host, domain, suffix, ev, says if n else [0.0] * len(classes), n))
    tables = [defaultdict(lambda: [0.0] * len(classes)) for _ in range(5)]
    for f in facts:
        for table, key in zip(tables, (f[1], f[2], f[3], f[4], "all"), strict=True):
            if key:
                table[key] = [a + b for a, b in zip(table[key], f[6], strict=True)]
    overall = tables[4]["all"]
    root = [(x + 1) / sum(y + 1 for y in overall) for x in overall]
    out = []
    for i, declared, host, domain, suffix, ev, says, n in facts:
        def lean(table, key, parent):
            own = [max(0, a - b) for a, b in zip(table[key], says, strict=True)] if key else [0.0 for _ in C]
            v = [own[k] + 8 * parent[k] for k in C]
            return [x / sum(v) for x in v]

        prior = lean(tables[1], host, lean(tables[2], domain, root))
        fused = []
        for k, name in enumerate(classes):
            s = ev[k] + math.log(prior[k])
            if declared:
                hit = 1 / len(classes) if name == "und" else 0.7 if declared == name else 0.3 / max(1, C[-1])
                s += math.log((tables[0][declared][k] + 20 * hit) / (overall[k] + 20))
            if suffix:
                s += math.log((tables[3][suffix][k] + 8 * root[k]) / (overall[k] + 8))
            fused.append(s)
        p = softmax(fused)
        best = classes[p.index(max(p))]
        share = sum(x for x, c in zip(p, classes, strict=True) if c in (known if accepted is None else accepted))
        out.append((i, best if n else "und", max(p) if n else 0.0, n, not n or share < 0.6))
    return sorted(out, key=str)


def fixture():
    r = random.Random(2)
    letters = {"aa": "abcdehilnort ", "bb": "uxyzqwkmèü ", "cc": "abpvmñó stu "}
    text = lambda k, n: "".join(r.choices(letters[k], k=n))
    labelled = [(text(k, 300), k) for k in letters for _ in range(5)] + [("abc", None), (None, "aa"), ("abc", "not a code")]
    rows = []
    for i in range(80):
        k = r.choice([*letters])
        declared = r.choice([None, k, k.upper(), "aa", "xx"])
        host = r.choice([None, f"{k}.site.com", f"www.{k}.site.com", "Mixed.org", "plain", f"x.{k}", ""])
        rows.append((i, declared, host, text(k, r.choice([1, 3, 10, 200]))))
    rows += [(200, "aa", "aa.site.com", None), (201, None, None, ""), (202, None, None, "123 !!"), (203, None, None, "жщцфъ" * 30), (None, None, "plain", "abc"), (3, *rows[3][1:]), (204, None, "h", "abcdeh " * 30000)]
    return labelled, rows


def test_matches_brute_force(spark):
    labelled, rows = fixture()
    df = spark.createDataFrame(labelled, "text string, lang string")
    languages, model = train(df)
    table = spark.createDataFrame(rows, "doc_id long, declared string, host string, text string")
    got = sorted(map(tuple, identify(table, languages, model).collect()), key=str)
    want = brute(rows, brute_model(labelled))
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))
    assert {g[1] for g in got} == {"aa", "bb", "cc", "und"}
    some = sorted(((r.doc_id, r.rejected) for r in identify(table, languages, model, ["aa", "bb"]).collect()), key=str)
    assert some == sorted(((w[0], w[4]) for w in brute(rows, brute_model(labelled), ["aa", "bb"])), key=str)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    languages, model = model_of(docs)
    assert languages == [] and identify(document_rows(docs), languages, model).count() == 0
    some = spark.createDataFrame([(i, "abc def " * 9, "aa", "s", 1) for i in range(9)] + [(50, "42", "aa", "s", 2), (None, "42", "aa", "s", 2)], docs.schema)
    kept = language_stage(spark, some, "")
    assert kept.columns == some.columns and sorted((x.doc_id for x in kept.collect()), key=str) == sorted([*range(9), None], key=str)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "https://u@WWW.a.fr:80/x", '<!doctype html><HTML class=x lang="fr-CA"><script>var a="<p>"</script><p>un</p>'), (2, None, None), (3, "nonsense", "<p lang=de>x")], "page_id long, url string, html string")
    got = {r.page_id: (r.declared, r.host, (r.text or "").split()) for r in page_rows(pages).collect()}
    assert got == {1: ("fr", "WWW.a.fr", ["un"]), 2: (None, None, []), 3: (None, "", ["x"])}


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_held_out_documents(spark):
    found = op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(doc_id as string)) % 5 = 0").selectExpr("doc_id", "lang as truth")
    rows = found.join(docs, "doc_id").collect()
    assert rows and sum(r.lang == r.truth for r in rows) > 0.97 * len(rows)
    assert found.count() == 1000 + 250


def test_labels_with_regions_count_for_their_language(spark):
    from cellweave.llm.language import train

    rows = [("das ist ein text", "de"), ("das ist ein anderer text", "DE-at"), ("ceci est un texte", "fr_ca"), ("junk", "x1"), ("junk", None), ("junk", "")]
    languages, model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert languages == ["de", "fr"] and model.shape[0] == 3
