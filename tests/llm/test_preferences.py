from cellweave.llm.preferences import conversations_as_pairs, format_preferences

TURN = "array<struct<role:string,text:string>>"


def shown(turns):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    c, r = chosen or [], rejected or []
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def spans(turns):
        out, at = [], 0
        for role, text in turns:
            begin = at + len(f"<|{role or 'unknown'}|>\n")
            at = begin + len(text or "") + len("<|end|>\n")
            if role == "assistant":
                out.append((begin, at))
        return out

    return n, shown(c[:n]), shown(c[n:]), shown(r[n:]), spans(c[n:]), spans(r[n:])


def test_pairs_match_brute_force(spark):
    u, a, s = ("user", "hi \U0001f600"), ("assistant", "é"), ("system", None)
    pairs = [
        (1, [s, u, a], [s, u, ("assistant", "no")]),
        (2, [u, a], [u, a]),
        (3, None, [u, a]),
        (4, [], []),
        (5, [u, a, u, a], [u, a]),
        (6, [(None, "x"), a], [(None, "x"), u, a, a]),
        (7, [u], [a]),
        (7, [u], [a]),
        (None, [u, a], [u]),
        (8, [("user", "long " * 50000), a], [("user", "long " * 50000), u]),
    ]
    df = spark.createDataFrame([(*p, "extra") for p in pairs], f"pair_id long, chosen {TURN}, rejected {TURN}, prompt string")
    got = [(r[0], r[1], r[2], r[3], r[4], [tuple(x) for x in r[5]], [tuple(x) for x in r[6]]) for r in format_preferences(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(c, r)) for i, c, r in pairs), key=str)
    assert format_preferences(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [
        (0, 1, "assistant", "A0"), (0, 0, "user", "U"), (0, 2, "user", "bye"),
        (1, 0, "user", "V"), (1, 1, "assistant", "A1"),
        (2, 0, "user", "alone"), (2, 1, "assistant", "A2"),
        (4, 0, "user", "no reply"), (5, 0, "assistant", "A5"), (5, 0, "assistant", "A5"), (5, None, None, None),
        (None, 0, "user", "nobody"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: ([(t.role, t.text) for t in r.chosen], [(t.role, t.text) for t in r.rejected]) for r in conversations_as_pairs(df).collect()}
    assert got == {
        0: ([("user", "U"), ("assistant", "A0"), ("user", "bye")], [("user", "U"), ("assistant", "A1")]),
        1: ([("user", "V"), ("assistant", "A1")], [("user", "V"), ("assistant", "A0")]),
        2: ([("user", "alone"), ("assistant", "A2")], [("user", "alone")]),
        4: ([("user", "no reply")], [("user", "no reply")]),
        5: ([(None, None), ("assistant", "A5"), ("assistant", "A5")], [(None, None), ("assistant", "A5")]),
    }
    assert format_preferences(conversations_as_pairs(df.limit(0))).count() == 0
