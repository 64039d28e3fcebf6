import random
import re

import corpus_pipeline
from cellweave.llm.mixing import BLOCK, BUDGET, ENTROPY, REPEATS

from .test_decontaminate import plain_alignment, split
from .test_mixing import brute as brute_mixture
from .test_simhash import brute as brute_components
from .test_substring import brute as brute_substrings


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choices("abdehilnorst", k=r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    passage = " ".join(word() for _ in range(70))
    docs = []
    for i in range(120):
        w = [word() for _ in range(r.randint(20, 160))]
        if i % 10 == 3:
            w[5:5] = passage.split()
        if i % 17 == 4:
            w[3:3] = items[i % 4][1].upper().split()
        docs.append((i, " ".join(w)))
    docs += [(200 + i, docs[i][1]) for i in range(9)] + [(300, docs[20][1].upper()), (301, "!! 42 ##"), (302, ""), (303, None), (304, docs[33][1] + " more"), (305, passage)]
    return items, [(i, t, "en", f"s{(i or 0) % 3 and 1}", len(t or "")) for i, t in docs]


def test_stages_one_by_one(spark, tmp_path):
    items, docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = {d[0]: d for d in docs}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name == "language ID":
            now = {i: d for i, d in now.items() if re.search("[a-z]", (d[1] or "").lower())}
        elif name == "SimHash near-dedup":
            now = {i: now[i] for i, _, c in brute_components([d[:2] for d in now.values()]) if i == c}
        elif name == "substring dedup":
            cut = {i: (k, t) for i, _, k, t in brute_substrings([d[:2] for d in now.values()])}
            now = {i: d if not cut[i][0] else (i, cut[i][1], *d[2:4], len(cut[i][1])) for i, d in now.items() if not cut[i][0] or cut[i][1]}
        elif name == "benchmark decontamination":
            leak = {i for i, d in now.items() if any(plain_alignment(split(q), split(d[1])) >= 0.5 * len(split(q)) for _, q in items)}
            assert leak
            now = {i: d for i, d in now.items() if i not in leak}
        else:
            want, _ = brute_mixture([(i, d[3], len(d[1].split())) for i, d in now.items()], ENTROPY, REPEATS, BUDGET, BLOCK)
            assert sorted(((r.doc_id, r.source, r.epoch, r.tokens, r.block, r.position) for r in out.collect()), key=str) == want
            assert all(r.text == now[r.doc_id][1] for r in out.collect())
            break
        assert out.columns == frame.columns
        got = out.collect()
        assert {r.doc_id: tuple(r) for r in got} == now and len(got) == len(now), name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.source, r.epoch, r.tokens, r.block, r.position) for r in whole.collect()), key=str) == want
