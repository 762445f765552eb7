from sunloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((-(10**9) if t is None else t, r or "", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    kept = {}
    for c, s in seqs.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            kept.setdefault(s, []).append(c)
    return sorted((min((c for c in cs if c is not None), default=None) or -1, len(cs), "".join(chat.render_text(r, x) for r, x in s)) for s, cs in kept.items())


def test_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(c, t, *a[t]) for c, n in ((1, 2), (2, 4), (3, 3), (4, 4)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 0, "", ""), (7, 1, "user", "x")]
    rows += [(None, 0, "user", "alone"), (8, None, "user", "n"), (8, 1, "user", "m"), (9, 0, "user", "tie"), (9, 0, "user", "tie"), (9, 0, "assistant", "tie")]
    got = sorted((r.conv_id or -1, r.n_copies, r.rendered) for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect())
    assert got == brute(rows)


def test_extra_columns_and_empty(spark):
    rows = [(1, 0, "user", "x" * 50_000, "r", "w")]
    df = spark.createDataFrame(rows, TURNS + ", rolling string, whole string")
    assert chat.format_chats(df).count() == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_many_turns_take_linear_time(spark):
    """One conversation of 20,000 turns, and each tenth of it as a snapshot."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c, n in ((1, 20_000), *((10 + i, 2_000 * i) for i in range(1, 10))) for t in range(n)]
    out = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(4)).select("conv_id", "n_turns").collect()
    assert [tuple(r) for r in out] == [(1, 20_000)]


def test_prefixes_in_another_order_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", "c"), (2, 0, "user", "b"), (2, 1, "user", "a"), (3, 0, "user", "a"), (3, 5, "user", "b"), (4, 0, "user", "b")]
    got = {r.conv_id for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1, 2}
