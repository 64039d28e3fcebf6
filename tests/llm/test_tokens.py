import random

from cellweave.llm import tokens
from cellweave.llm.tokens import TokenTrie, token_counts, unigram_scores


def brute(word, scores, unknown):
    text = "▁" + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(end):
            piece = text[begin:end]
            if piece in scores:
                options.append((-(best[begin][0] + scores[piece]), best[begin][1] + 1))
            elif end - begin == 1:
                options.append((-(best[begin][0] + unknown), best[begin][1] + len(piece.encode())))
        s, n = min(options)
        best[end] = (-s, n)
    return best[-1][1]


def sample_words():
    r = random.Random(1)
    words = ["", "a", "tion", "unbelievable", "日本語", "ñandú", "\U0001f600x", "x" * 300, "\x00", "they're", "123456"]
    words += ["".join(r.choices("abcdefinorst", k=r.randint(1, 12))) for _ in range(400)]
    return [w for w in words if w]


def test_trie_matches_plain_dynamic_programming():
    scores = unigram_scores()
    trie = TokenTrie(scores, most_nodes=500)
    for word in sample_words():
        assert trie.count([word.encode()]) == brute(word, scores, trie.unknown)
    words = [w.encode() for w in sample_words()]
    assert TokenTrie(scores).count(words * 2) == 2 * sum(TokenTrie(scores).count([w]) for w in words)
    assert len(trie.children) <= 500 + 400


def test_agrees_with_a_unigram_model_of_the_same_pieces():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    scores = unigram_scores()
    model = pb.ModelProto()
    model.ParseFromString(open(tokens.VOCABULARY, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = True
    low = min(scores.values())
    for piece in model.pieces:
        if piece.type == pb.ModelProto.SentencePiece.NORMAL:
            piece.score = scores.get(piece.piece, low - 1000)
    engine = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    trie = TokenTrie(scores)
    words = [w for w in sample_words() if "\x00" not in w]
    assert sum(trie.count([w.encode()]) != len(engine.encode(w)) for w in words) <= len(words) // 100


def test_rows(spark):
    rows = [(1, "a tion\tunbelievable"), (2, ""), (3, None), (None, "日本語"), (1, "a tion\tunbelievable"), (4, " \n "), (5, "tion " * 100000)]
    df = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, n_tokens int, lang string")
    scores = unigram_scores()
    unknown = TokenTrie(scores).unknown
    want = [(i, len((t or "").split()), sum(brute(w, scores, unknown) for w in (t or "").split()[:4]) if len(t or "") < 99 else 100000 * brute("tion", scores, unknown)) for i, t in rows]
    assert sorted(map(tuple, token_counts(df).collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_long_words_take_bounded_memory():
    import tracemalloc

    scores = unigram_scores()
    trie = TokenTrie(scores)
    r = random.Random(2)
    for n in (tokens.LONG_WORD - 1, tokens.LONG_WORD + 1, 1000, 3000):
        word = "".join(r.choices("tionerañ日x", k=n))
        assert trie.count([word.encode()]) == brute_window(word, scores, trie.unknown)
    before = len(trie.children)
    word = b"".join(r.choices([b"tion", b"er", b"zq"], k=40_000))
    tracemalloc.start()
    n = trie.count([word, b"a", word])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trie.children) <= before + 2 and peak < 10 * len(word) + 2_000_000
    assert n == 2 * trie.long_word(word) + trie.count([b"a"])


def brute_window(word, scores, unknown):
    """`brute` that tries pieces of up to 48 characters only, so that long words end."""
    text = "▁" + word
    assert max(map(len, scores)) <= 48
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(max(0, end - 48), end):
            piece = text[begin:end]
            if piece in scores:
                options.append((-(best[begin][0] + scores[piece]), best[begin][1] + 1))
            elif end - begin == 1:
                options.append((-(best[begin][0] + unknown), best[begin][1] + len(piece.encode())))
        s, n = min(options)
        best[end] = (-s, n)
    return best[-1][1]
