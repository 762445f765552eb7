import random
import re
import string
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sunloom.llm import common, decontam

from .helpers import awkward, documents, prose

ITEMS = "item_id long, text string"
Q = "Anna bought 12 apples and 5 kg of sugar for 30 dollars while Peter waited near the old bridge for 12 minutes before the rain began to fall again"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def judged(docs, bench):
    return {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}


def tokens_of(text):
    """(kind, value, may open as a name) of every token, by a plain reading of the rules."""
    out, opens = [], True
    for word in text.split():
        core = word.strip(string.punctuation)
        number = re.match(r"[+-]?\d[\d.,:/]*", core)
        rest = core[number.end() :] if number else ""
        after = bool(out) and out[-1][0] == "number"
        if number and (not rest or rest.lower().encode() in decontam.UNITS):
            out.append(("number", number[0].rstrip(".,:/"), False))
            if rest:
                out.append(("unit", rest.lower(), False))
        elif core:
            low = core.lower()
            named = core[0].isupper() and not core.isupper() and low.encode() not in decontam.FUNCTION
            if low.encode() in decontam.NUMBER_WORDS:
                out.append(("number", low, False))
            elif low.encode() in decontam.UNITS and after:
                out.append(("unit", low, False))
            elif named and not opens:
                out.append(("name", low, False))
            else:
                out.append(("literal", decontam.PRONOUNS.get(low.encode(), low.encode()).decode(), named))
        opens = word.rstrip("\"')]").endswith((".", "!", "?"))
    return out


def readings(tokens, at, width):
    """(template, slots, whether it is the first reading) of every reading of a window."""
    inside = tokens[at : at + width]
    open_at = [i for i, t in enumerate(inside) if t[2]]
    for n in range(len(open_at) + 1):
        for chosen in combinations(open_at, n):
            kinds = ["name" if i in chosen else t[0] for i, t in enumerate(inside)]
            yield tuple(t[1] if k == "literal" else (k,) for k, t in zip(kinds, inside, strict=True)), [(k, t[1]) for k, t in zip(kinds, inside, strict=True) if k != "literal"], not chosen


def agreeing(windows):
    pairs = {p for _, ps, _ in windows for p in ps}
    clash = {(a, b) for a, b in pairs for c, d in pairs if (a == c and b != d) or (b == d and a != c and "number" not in (a[0], c[0]))}
    return {pos for pos, ps, _ in windows if not clash & set(ps)}


def held(item, doc):
    """The share of an item's windows that a document holds."""
    mine, theirs = tokens_of(item), tokens_of(doc)
    width = min(5, len(mine))
    named = ["name" if t[2] else t[0] for t in mine]
    used = [i for i in range(len(mine) - width + 1) if width and named[i : i + width].count("literal") >= min(2, width)]
    places = range(len(theirs) - width + 1) if width else []
    values = lambda ts, i: [t[1] for t in ts[i : i + width]]
    if not used:
        every = range(len(mine) - width + 1) if width else []
        return sum(any(values(mine, i) == values(theirs, q) for q in places) for i in every) / max(1, len(every))
    aligned = {}
    for i in used:
        own = list(readings(mine, i, width))
        for q in places:
            for t, s, f in readings(theirs, q, width):
                aligned.setdefault(q - i, []).extend((i, list(zip(s0, s, strict=True)), f and f0) for t0, s0, f0 in own if t0 == t)
            if i == 0 and mine[0][1].encode() in decontam.UNITS and values(mine, 0) == values(theirs, q):
                aligned.setdefault(q, []).append((0, [], False))
    covered = set()
    for windows in aligned.values():
        covered |= agreeing(windows) | agreeing([w for w in windows if w[2]])
    return len(covered) / len(used)


def brute(docs, bench):
    found = {}
    for d, text in docs:
        for item, it in bench:
            if it is not None and text is not None and held(it, text) >= 0.8:
                found.setdefault(d, set()).add(item)
    return found


def test_reparameterised_question_is_caught(spark):
    other = Q.replace("Anna", "Maria").replace("12", "15").replace("30", "44").replace("Peter", "Oskar").replace("kg", "lb")
    clash = Q.replace("12 apples", "15 apples").replace("30 dollars", "15 dollars")
    loose = Q.replace("12 minutes", "99 minutes").replace("12 apples", "15 apples")
    docs = documents(spark, [(1, f"Some words here. {Q} and more", "en", "a"), (2, f"Well then. {other}. Yes", "en", "a"), (3, f"So. {clash}", "en", "a"), (4, prose(1, 200), "en", "a"), (5, f"So. {loose}", "en", "a"), (6, Q[: len(Q) // 2], "en", "a")])
    got = judged(docs, items(spark, (7, Q)))
    assert {d for d, r in got.items() if r.contaminated} == {1, 2}
    assert got[1].best_item == 7 and got[1].best_share == 1.0 and got[4].best_share == 0.0


def test_matches_brute_force(spark):
    r = random.Random(2)

    def text(seed, n):
        words = prose(seed, n).split()
        return " ".join(r.choice([w, w.capitalize(), str(r.randrange(20)), "5 km", w + "."]) if r.random() < 0.3 else w for w in words)

    bench = [(i, text(i, 12 + i)) for i in range(12)] + [(50, "one two"), (51, ""), (52, None), (53, "7 8 9 10 11 12"), (0, text(99, 20))]
    docs = []
    for i in range(120):
        b = bench[i % 12][1].split()
        if i % 4 == 0:
            b[r.randrange(len(b))] = "changed"
        docs.append((i, f"{text(1000 + i, 30)}. {' '.join(b)} {text(2000 + i, 20)}" if i % 3 else text(3000 + i, 60)))
    docs += [(200, "one two three"), (201, None), (202, ""), (203, "1 2 3 4 5 6")]
    want = brute(docs, bench)
    got = judged(documents(spark, [(d, t, "en", "a") for d, t in docs]), items(spark, *bench))
    assert {d for d, x in got.items() if x.contaminated} == set(want)
    assert len(want) > 30
    for d, x in got.items():
        assert x.best_item is None if d not in want else x.best_item in want[d]


def test_canonical_tokens():
    canonical = decontam.Canonicaliser()
    _, kind, _ = canonical(b"Anna met Bob. He ran 5km, then 3 hours (12.5%) for km -- NASA")
    N, U, A, L = decontam.NUMBER, decontam.UNIT, decontam.NAME, decontam.LITERAL
    assert kind.tolist() == [L, L, A, L, L, N, U, L, N, U, N, L, L, L]
    assert len(canonical(b"")[0]) == 0 and len(canonical(b" .. !")[0]) == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, f"x. {Q}" if i % 2 else prose(i, 50), "en", "a") for i in range(20)])
    bench = items(spark, (1, Q), (2, prose(5, 40)))
    one = judged(docs, bench)
    kept = {r.doc_id for r in decontam.clean_rows(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert judged(docs, bench) == one
    assert {r.doc_id for r in decontam.clean_rows(docs, bench).collect()} == kept == set(range(0, 20, 2))


def test_awkward_and_columns(spark):
    df = awkward(spark).withColumn("item", F.lit(1)).withColumn("windows", F.lit("w"))
    bench = items(spark, (1, prose(1, 60)), (None, prose(77, 30)), (2, None))
    rows = decontam.contamination(df, bench).collect()
    assert len(rows) == df.count()
    assert {r.doc_id for r in rows if r.contaminated} == {1, 2, None}
    kept = decontam.clean_rows(df, bench)
    # The clean one of the two rows without a key stays.
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10, None}
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(df, bench.limit(0)).collect())


def test_window_hash_knows_its_width():
    t = np.arange(1, 20, dtype=np.uint64)
    assert not set(decontam.window_hashes(t, 4).tolist()) & set(decontam.window_hashes(t, 5).tolist())
    assert len(decontam.window_hashes(t[:3], 5)) == 0


def test_names_that_open_sentences_are_reparameterised(spark):
    item = "Tom has 3 apples. Tom gives 2 to Mary. How many apples does Tom have left"
    other = "Bob has 7 apples. Bob gives 4 to Jane. How many apples does Bob have left"
    mixed = "Bob has 7 apples. Rob gives 4 to Jane. How many apples does Sam have left"
    docs = documents(spark, [(1, other, "en", "a"), (2, f"Question: {other}", "en", "a"), (3, mixed, "en", "a"), (4, f"Question: {item}", "en", "a")])
    assert {d for d, r in judged(docs, items(spark, (7, item))).items() if r.contaminated} == {1, 2, 4}


def test_verbatim_items_whatever_precedes(spark):
    bench = ["What is the capital of France", "Name three rivers", "Who is Anna Kowalska", "Anna met Peter", "Minutes pass slowly here", "Describe Mount Everest to Anna and Peter"]
    before = ["", "Question: ", "so it says ", "It ended. ", "Part 3: ", "the Old "]
    docs = [(10 * i + j, f"{b}{t}", "en", "a") for i, t in enumerate(bench) for j, b in enumerate(before)]
    docs += [(900, "Paris is the capital of France", "en", "a"), (901, "they say Maria is Peter Smith", "en", "a"), (902, "Well, Maria met Oskar", "en", "a")]
    got = judged(documents(spark, docs), items(spark, *enumerate(bench)))
    assert {d for d, r in got.items() if r.contaminated} == {d for d, *_ in docs if d < 900}
    assert all(got[d].best_share == 1.0 for d, *_ in docs if d < 900)


#: Word problems: what is done, to what, where, and what is asked.
DONE = "buys sells paints counts folds carries washes borrows stacks trims".split()
THING = "apples ribbons lamps bricks tickets marbles baskets candles postcards kettles".split()
PLACE = "market harbour library garden station museum bakery theatre orchard workshop".split()
ASKED = ["How many {t} are left", "What is the total cost of the {t}", "How long does {a} need for all {t}", "Which share of the {t} belongs to {b}", "How many more {t} does {b} have than {a}"]
WOMEN, MEN = "Anna Maria Jane Olivia Sophie Nadia Clara Ruth".split(), "Tom Bob Peter Oskar Ivan Hugo Liam Omar".split()


def question(r, shape):
    """A word problem of a shape (its literal words) with names and figures of its own."""
    d, e, t, p, q = shape
    woman = r.random() < 0.5
    a, b = r.choice(WOMEN if woman else MEN), r.choice(MEN if woman else WOMEN)
    n, m, k = r.sample(range(2, 90), 3)
    he = "She" if woman else "He"
    his = "her" if woman else "his"
    return f"{a} {d} {n} {t} at the {p}. {b} {e} {m} {t} on {his} way home. {he} pays {k} dollars for each. {q.format(t=t, a=a, b=b)}?"


def shape(r):
    return r.choice(DONE), r.choice(DONE), r.choice(THING), r.choice(PLACE), r.choice(ASKED)


def test_recall_of_reparameterised_items(spark):
    """200 items with names that open sentences, each with other names, pronouns and figures, and 400 clean texts."""
    r = random.Random(11)
    shapes = [shape(r) for _ in range(200)]
    bench = [(i, question(r, s)) for i, s in enumerate(shapes)]
    planted = [(i, f"{prose(i, 30)}{r.choice(['. ', ': ', ' Question: ', '. Part 3: '])}{question(r, s)} {prose(1000 + i, 20)}") for i, s in enumerate(shapes)]
    # Clean questions share at most two of their five parts with any item.
    others = [s for s in (shape(r) for _ in range(6000)) if all(sum(x == y for x, y in zip(s, o, strict=True)) <= 2 for o in shapes)][:200]
    clean = [(1000 + i, f"{prose(5000 + i, 30)}. {question(r, s)} {prose(6000 + i, 20)}" if i < len(others) else prose(9000 + i, 120)) for i, s in enumerate([*others, *[None] * (400 - len(others))])]
    got = judged(documents(spark, [(d, t, "en", "a") for d, t in [*planted, *clean]]), items(spark, *bench))
    caught = sum(got[d].contaminated for d, _ in planted) / len(planted)
    wrong = sum(got[d].contaminated for d, _ in clean)
    assert len(others) >= 50
    assert (caught, wrong) == (1.0, 0)


def test_items_of_one_template_are_one_class(spark):
    r = random.Random(3)
    bench = [(i, question(r, ("buys", "sells", "apples", "market", ASKED[0]))) for i in range(50)]
    classes, windows = decontam._benchmark(items(spark, *bench, (0, bench[0][1])), "item_id", "text")
    assert classes.select("item", "n_items").collect() == [(0, 50)]
    # One window for each position, and further ones for openers that are read as words.
    assert windows.where("not other").select("pos").distinct().count() == classes.first().n
    got = judged(documents(spark, [(1, bench[7][1], "en", "a")]), items(spark, *bench))
    assert (got[1].n_items, got[1].best_item, got[1].best_share) == (50, 0, 1.0)
