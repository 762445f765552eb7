"""Small tables with the cases every operator must handle."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)"""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)


def prose(seed, n, words=("the", "and", "of", "sun", "moon", "river", "stone", "light", "wind", "tree", "house", "road", "cloud", "field")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "", "er", "ing", "s"]) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    long = prose(3, 6000)
    return documents(
        spark,
        [
            (1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "b"), (None, prose(1, 60), "en", None),
            (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "en", "a"), (6, long, "en", "a"), (7, long + " x", "en", "b"),
            (8, "x", "en", "c"), (None, None, None, None), (9, "été 中文 \U0001f600", "fr", "c"), (10, "12 34 !!", "en", "c"),
        ],
    )
