from plexspark.llm import chat

O, C = chat.OPEN, chat.CLOSE


def rendered(turns):
    return "".join(f"{O}{r or ''}\n{t or ''}{C}\n" for r, t in turns)


def formatted(spark, rows):
    return {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string")).collect()}


def sides(pair, chosen, rejected):
    return [(pair, s, i, r, t, "clash") for s, turns in (("chosen", chosen), ("rejected", rejected)) for i, (r, t) in enumerate(turns)]


def test_prompt_is_the_longest_common_prefix(spark):
    a, b, x, y = ("user", "hi"), ("assistant", "héllo"), ("user", None), ("assistant", "")
    cases = {1: ([a, b, x], [a, y, x]), 2: ([a, b], [a, b]), 3: ([a, x, b], [a, x]), 4: ([b], [a]), 5: ([x, (None, None), b], [x, (None, None), y]), 6: ([], [a, b])}
    rows = [r for p, (c, r_) in cases.items() for r in sides(p, c, r_)] + [(None, "chosen", 0, "user", "t", ""), (1, "other", 0, "user", "t", "")]
    got = formatted(spark, rows)
    assert set(got) == set(cases)
    for p, (c, r) in cases.items():
        n = next((i for i, (u, v) in enumerate(zip(c, r, strict=False)) if u != v), min(len(c), len(r)))
        g = got[p]
        assert (g.n_prompt, g.prompt, g.chosen, g.rejected) == (n, rendered(c[:n]), rendered(c[n:]), rendered(r[n:]))
        for text, mask, turns in ((g.chosen, g.chosen_mask, c[n:]), (g.rejected, g.rejected_mask, r[n:])):
            assert sum(m.length for m in mask) == len(text)
            at, learned = 0, []
            for m in mask:
                learned += [text[at : at + m.length]] * m.learn
                at += m.length
            assert learned == [(t or "") + C for role, t in turns if role == "assistant"]


def test_order_ties_and_empty(spark):
    rows = [(1, "chosen", 1, "assistant", "b", ""), (1, "chosen", 0, "user", "q", ""), (1, "chosen", 0, "user", "q", ""), (1, "rejected", 0, "user", "q", ""), (1, "rejected", None, "system", "s", "")]
    got = formatted(spark, rows)[1]
    assert got.n_prompt == 0 and got.chosen == rendered([("user", "q"), ("user", "q"), ("assistant", "b")]) and got.rejected == rendered([("system", "s"), ("user", "q")])
    assert formatted(spark, []) == {}


def test_mates(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "u"), (1, 3, "assistant", "z1"), (2, 0, "user", "only"), (5, 0, "assistant", "x"), (None, 0, "assistant", "n")]
    turns = chat.mate_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected) for r in chat.format_preferences(turns).collect()}
    assert got == {
        0: (rendered([("user", "q0")]), rendered([("assistant", "a0")]), rendered([("assistant", "z1")])),
        1: (rendered([("user", "q1"), ("assistant", "a1"), ("user", "u")]), rendered([("assistant", "z1")]), rendered([("assistant", "a0")])),
    }


def test_mates_with_nulls_ties_repeats_and_none(spark):
    kind = "conv_id long, turn long, role string, text string, side string, pair_id long"
    rows = [(0, 0, "user", None), (0, 1, "assistant", "b"), (0, 1, "assistant", "a"), (1, 0, "assistant", None), (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "z"), (3, 5, "assistant", "m"), (4, None, "assistant", "n"), (None, 1, "assistant", "n"), (5, 1, None, "t")]
    out = chat.format_preferences(chat.mate_preferences(spark.createDataFrame([(*r, "clash", 9) for r in rows], kind)))
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected) for r in out.collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[2] == (rendered([("user", "q"), ("user", "q")]), rendered([("assistant", "z")]), rendered([("assistant", "m")]))
    # of answers of one turn all are replaced by the mate's least one; null renders as empty
    assert got[0] == (rendered([("user", None)]), rendered([("assistant", "a"), ("assistant", "b")]), rendered([("assistant", None), ("assistant", None)]))
    assert got[1] == ("", rendered([("assistant", None)]), rendered([("assistant", "a")]))
    none = spark.createDataFrame([], kind)
    assert chat.format_preferences(chat.mate_preferences(none)).count() == 0


def test_long_texts_and_conversations(spark):
    long = "word " * 400_000
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(2000)] + [(1, 0, "user", long), (1, 1, "assistant", long + "end")]
    turns = chat.mate_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in chat.format_preferences(turns).collect()}
    assert got[0].n_prompt == 1999 and got[0].chosen == rendered([("assistant", "1999")]) and got[0].rejected == rendered([("assistant", long + "end")])
    assert got[1].prompt == rendered([("user", long)]) and sum(m.length for m in got[1].chosen_mask) == len(got[1].chosen)
