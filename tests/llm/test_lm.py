import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import lm

from .helpers import awkward, documents, prose


def tokens(text):
    return ["".join(c.lower() if c.isascii() else c for c in w.decode()) for w in (text or "").encode().split()] + [None]


class Plain:
    """Interpolated modified Kneser-Ney, with dictionaries."""

    def __init__(self, texts, order=2):
        rows, self.order = [tokens(t) for t in texts], order
        self.uni = Counter(t for r in rows for t in r)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        padded = [["<s>"] * (order - 1) + r for r in rows]
        #: By length of the n-gram: counts of the longest, numbers of different words before the shorter ones.
        self.of = {order: Counter(tuple(r[i : i + order]) for r in padded for i in range(len(r) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.of[k] = Counter(g[1:] for g in self.of[k + 1])
        self.cut = {k: lm.discounts([sum(c == i for c in self.of[k].values()) for i in (1, 2, 3, 4)]) for k in self.of}
        self.all, self.back = Counter(), Counter()
        for k in range(2, order + 1):
            for g, c in self.of[k].items():
                self.all[g[:-1]] += c
                self.back[g[:-1]] += self.cut[k][min(c, 3) - 1]
        self.bi = self.of[2]
        self.even = sum(self.cut[1][min(c, 3) - 1] for c in self.of[1].values()) / max(1, len(self.bi)) if self.bi else 1.0

    def less(self, k, gram):
        c = self.of[k][gram]
        return max(c - (self.cut[k][min(c, 3) - 1] if c else 0), 0)

    def p(self, before, w):
        """Of a word after the tuple ``before``."""
        p = self.even / (self.v + 1) + (self.less(1, (w,)) / len(self.bi) if self.bi else 0)
        for k in range(2, self.order + 1):
            context = before[len(before) - k + 1 :]
            if self.all[context]:
                p = self.less(k, (*context, w)) / self.all[context] + self.back[context] / self.all[context] * p
        return p

    def score(self, text):
        r = tokens(text)
        base = sum(math.log10((self.uni[t] + 1) / (self.n + self.v + 1)) for t in r)
        padded = ["<s>"] * (self.order - 1) + r
        return len(r), sum(self.uni[t] > 0 for t in r), base, sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), r[i])) for i in range(len(r)))


@pytest.mark.parametrize(("shard_bytes", "order", "files"), [(10**9, 2, None), (3000, 2, None), (3000, 2, 2), (10**9, 3, None), (3000, 3, 3), (3000, 4, None)])
def test_matches_plain_model(spark, shard_bytes, order, files):
    df = documents(spark, [(i, prose(i, i % 50), "en", "a") for i in range(120)]).unionByName(awkward(spark))
    rows = df.collect()
    plain = Plain([r.text for r in rows if r.doc_id is None or r.doc_id % 3], order)
    model = lm.train(df.where("doc_id is null or doc_id % 3 <> 0"), shard_bytes=shard_bytes, order=order, files=files)
    assert (model.shards > 1) == (shard_bytes < 10**6)
    assert files is None or len({n.split(".")[1] for n in model.files}) <= files < model.shards
    assert (model.train_tokens, model.vocabulary, model.bigrams) == (plain.n, plain.v, len(plain.bi))
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(model, df).collect())
    want = sorted((r.doc_id or -1, *(round(x, 6) for x in plain.score(r.text))) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], abs=1e-4)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    plain = Plain([prose(i, 30) for i in range(20)], order)
    words = [*plain.uni, "unheard"]
    for a in ["<s>", "the", "unheard", None]:
        for b in ("<s>", "and"):
            assert sum(plain.p((b, a)[-(order - 1) :], w) for w in words) == pytest.approx(1.0)


def test_a_longer_context_scores_better(spark):
    df = documents(spark, [(i, " ".join(["alpha beta gamma delta", "omega beta gamma sigma"][i % 2].split() * 5), "en", "a") for i in range(60)])
    two, three = ({r.doc_id: r.score for r in lm.held_out_scores(df, order=k).collect()} for k in (2, 3))
    assert all(three[i] > two[i] for i in two)


def test_counts_beyond_a_byte_and_32_bits():
    counts = np.array([1, 254, 255, 256, 2**33, 3, 2**40], "u8")
    low, big = lm.small(counts)
    assert low.dtype == np.uint8 and big.tolist() == [255, 256, 2**33, 2**40]
    assert lm.whole(low, big).tolist() == counts.tolist()


def test_frequent_words_keep_their_counts(spark):
    """Counts above 255 lie beside their table."""
    df = documents(spark, [(i, "the sun " * 400 + prose(i, 20), "en", "a") for i in range(30)])
    plain = Plain([r.text for r in df.collect()])
    model = lm.train(df, shard_bytes=4000, files=3)
    got = {r.doc_id: (r.base_score, r.score) for r in lm.score_texts(model, df).collect()}
    for r in df.collect():
        assert got[r.doc_id] == pytest.approx(plain.score(r.text)[2:], abs=1e-3)


def test_a_lost_file_is_an_error(spark):
    df = documents(spark, [(i, prose(i, 40), "en", "a") for i in range(60)])
    model = lm.train(df, shard_bytes=2000, files=4)
    folder = Path(model.layout.folder.removeprefix("file:"))
    assert {f.name for f in folder.iterdir() if not f.name.startswith(".")} == set(model.files)
    next(folder.glob("gram1.*.key")).unlink()
    with pytest.raises(Exception, match="the model lacks"):
        lm.score_texts(model, df).collect()


def test_held_out_rows_teach_nothing(spark):
    df = documents(spark, [(i, f"only{i} " + prose(i, 30), "en", "a") for i in range(80)]).withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in lm.held_out_scores(df).collect()}
    for i, r in got.items():
        held = zlib.crc32(str(i).encode()) % 7 == 2
        assert r.held_out == held
        assert (r.n_known < r.n_tokens) == held
        assert held or r.score > r.base_score


def test_no_training_rows_and_empty(spark):
    model = lm.train(awkward(spark).limit(0))
    assert (model.train_tokens, model.vocabulary) == (0, 0)
    rows = lm.score_texts(model, awkward(spark)).collect()
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in rows)
    assert lm.held_out_scores(awkward(spark).limit(0)).count() == 0
