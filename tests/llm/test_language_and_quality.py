import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import langid, quality

from .helpers import awkward, documents, prose

SPANISH = ("el", "la", "que", "nación", "camino", "piedra", "luz", "viento", "árbol", "casa", "señal")
GERMAN = ("der", "die", "und", "straße", "stein", "licht", "wind", "baum", "haus", "schön", "zeichen")


def mixed(spark, n=240):
    rows = [(i, prose(i, 25, *([(SPANISH,), (GERMAN,), ()][i % 3])), ("es", "de", "en")[i % 3], "a") for i in range(n)]
    return documents(spark, rows)


def test_held_out_accuracy(spark):
    df = mixed(spark).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    truth = {r.doc_id: r.lang for r in df.collect()}
    rows = langid.held_out_languages(df).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_unknown_and_awkward(spark):
    df = mixed(spark).unionByName(awkward(spark))
    rows = langid.identify(df, langid.learn(mixed(spark)), keep=["text"]).collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered)
    kept = langid.accepted(df.withColumn("score", F.lit(1)), langid.learn(mixed(spark)))
    assert "score" in kept.columns and kept.count() >= 240
    assert langid.held_out_languages(df.limit(0)).count() == 0
    nothing = langid.identify(df, langid.learn(df.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def presence_rows(texts):
    rows = np.zeros((len(texts), langid.BUCKETS), np.float32)
    for row, t in zip(rows, texts, strict=True):
        langid.presence(t, row)
    return rows


def test_folded_weights_equal_kernel_rows():
    rows = np.zeros((12, langid.BUCKETS), np.float32)
    for i in range(12):
        langid.presence(prose(i, 20, *((SPANISH,) if i % 2 else (GERMAN,))), rows[i])
    names = np.array(["es" if i % 2 else "de" for i in range(12)], object)
    model = langid.fit(rows, names)
    kernel = (rows @ rows.T) / np.sqrt(np.outer(rows.sum(1), rows.sum(1)))
    assert kernel.diagonal() == pytest.approx(1.0)
    assert [model.languages[i] for i in model.shares(rows).argmax(axis=1)] == names.tolist()


@pytest.mark.parametrize("in_all", [1024, 2])
def test_scores_equal_kernel_ridge_solved_directly(monkeypatch, in_all):
    """The model against a ridge in the landmarks' kernels, without a Nystroem map and without folding."""
    monkeypatch.setattr(langid, "LANDMARKS_IN_ALL", in_all)
    pools = {"de": GERMAN, "en": ("the", "and", "of", "sun", "moon", "river"), "es": SPANISH}
    texts = [prose(i, 20, pools[sorted(pools)[i % 3]]) for i in range(30)]
    names = np.array([sorted(pools)[i % 3] for i in range(30)], object)
    wide = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    grams = [set(np.flatnonzero(r).tolist()) for r in presence_rows(texts)]
    model = langid.fit(presence_rows(texts), names, landmarks=4)
    assert len(model.weights) == (1 if in_all == 1024 else 2)
    marks = [i for n in sorted(pools) for i in [k for k in range(30) if names[k] == n][:4]] if in_all == 1024 else [i for n in ("de", "es") for i in [k for k in range(30) if names[k] == n][:1]]
    k_nm, k_mm = wide(grams, [grams[i] for i in marks]), wide([grams[i] for i in marks], [grams[i] for i in marks])
    weight = np.diag([1 / sum(names == n) for n in names])
    sought = np.array([[1.0 if n == m else -1.0 for m in sorted(pools)] for n in names])
    alpha = np.linalg.solve(k_nm.T @ weight @ k_nm + langid.RIDGE / 3 * k_mm, k_nm.T @ weight @ sought)
    new = presence_rows([prose(100 + i, 15, pools[sorted(pools)[i % 3]]) for i in range(9)])
    raw = wide([set(np.flatnonzero(r).tolist()) for r in new], [grams[i] for i in marks]) @ alpha
    share = np.exp(langid.SHARPNESS * raw)
    assert model.shares(new) == pytest.approx(share / share.sum(axis=1, keepdims=True), abs=1e-3)


def test_many_languages(spark):
    """300 languages, each with words of its own letters."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows = []
    for i in range(300):
        words = ["".join(letters[3 * i + (k >> b) % 3] for b in range(4)) for k in range(12)]
        rows += [(10 * i + j, prose(10 * i + j, 12, words), f"l{i:03}", "a") for j in range(8)]
    out = langid.held_out_languages(documents(spark, rows)).collect()
    want = {d: lang for d, _, lang, _ in rows}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in out if r.held_out]) > 0.95


def test_presence_is_of_the_whole_text():
    one, two = np.zeros(langid.BUCKETS, np.uint8), np.zeros(langid.BUCKETS, np.uint8)
    langid.presence("a" * 200_000, one)
    langid.presence("a" * 200_000 + "zebra", two)
    assert two.sum() > one.sum()
    assert not langid.presence("12 !? \t", one)


def labelled(spark, n=300):
    def text(i):
        good = prose(i, 40)
        return good if i % 4 else [good.upper().replace(" ", "!! "), " | ".join(good.split()), good.replace(" ", "### "), "Orre " * 40][i // 4 % 4]

    return documents(spark, [(i, text(i), "en", "a") for i in range(n)]), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    rows = quality.held_out_quality(docs.withColumn("score", F.lit("x")), labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_awkward(spark):
    docs, labels = labelled(spark, 60)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 0, 0), (999, 1, 0)], labels.schema))
    out = quality.held_out_quality(docs.unionByName(awkward(spark)), odd).collect()
    assert len(out) == 60 + awkward(spark).count()
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.held_out_quality(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.held_out_quality(docs.limit(0), labels).count() == 0


def test_votes_match_brute_force():
    r = np.random.default_rng(1)
    model = quality.fit(r.poisson(1.0, (80, quality.TERMS)).astype(np.float32), r.integers(0, 2, 80).astype(np.float32))
    rows = r.poisson(1.0, (9, quality.TERMS)).astype(np.float32)
    for row, got in zip(rows, model.vote(rows), strict=True):
        cosines = model.vectors @ model.latent(row[None])[0]
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 1e-3) ** quality.FOCUS
        assert got == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), rel=1e-4)


def test_training_texts_are_distinct(spark, monkeypatch):
    rows = [(i, prose(i % 40, 25, SPANISH), "es", "a") for i in range(6000)] + [(9000 + i, prose(i, 25, GERMAN), "de", "a") for i in range(1500)]
    df = documents(spark, rows).cache()
    bits, langs = langid.training_rows(df, "text", "lang")
    assert (langs == "es").sum() == len({b.tobytes() for b in bits[langs == "es"]}) == 40
    assert (langs == "de").sum() == langid.PER_LANGUAGE
    monkeypatch.setattr(langid, "REACH", 0.0)
    again, names = langid.training_rows(df, "text", "lang")
    assert names.tolist() == langs.tolist() and (again == bits).all()


def ranking(scored):
    """The share of pairs of a good and a bad text that the scores put in order."""
    good, bad = (np.array([s for s, y in scored if y == k]) for k in (1, 0))
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


def test_words_alone_tell_quality(spark):
    """Texts of the same shapes whose quality lies in their vocabulary."""
    good, bad = [[a + b for a in x for b in "aeiou"] for x in ("bdfgk", "lmnpr")]
    rows = [(i, prose(i, 30, good if i % 2 else bad), "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [(r.score, r.doc_id % 2) for r in quality.held_out_quality(documents(spark, rows), labels).collect() if r.held_out]
    assert ranking(held) > 0.97


def test_a_key_with_several_texts_teaches_the_same_each_time(spark):
    docs, labels = labelled(spark, 120)
    more = docs.unionByName(documents(spark, [(i, prose(7000 + i, 30).upper(), "en", "a") for i in range(40)]))
    one, two = (quality.labelled_sample(df, labels, "doc_id", "text", "quality") for df in (more.repartition(3), more.repartition(7, "text")))
    assert len(one[0]) == 120 and (one[0] == two[0]).all() and (one[1] == two[1]).all()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/labels.parquet").exists(), reason="needs the driver's tables")
def test_held_out_ranking_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    some = docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    held = [(r.score, known[r.doc_id]) for r in quality.held_out_quality(some, labels).collect() if r.held_out and r.doc_id in known]
    assert ranking(held) >= 0.99


def test_latent_vectors_equal_a_direct_decomposition():
    r = np.random.default_rng(4)
    counts = r.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    model = quality.fit(counts, r.integers(0, 2, 60).astype(np.float32))
    idf = np.log(61 / (1 + (counts > 0).sum(axis=0))) + 0.2
    weighed = np.log1p(counts) * idf
    style, words = weighed[:, : quality.STYLE], weighed[:, quality.STYLE :]
    rows = np.concatenate([style / np.linalg.norm(style, axis=1, keepdims=True), quality.WORD_WEIGHT * words / np.linalg.norm(words, axis=1, keepdims=True)], axis=1)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(rows, full_matrices=False)
    latent = (u * s)[:, : quality.DIMENSIONS]
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    assert model.vectors @ model.vectors.T == pytest.approx(latent @ latent.T, abs=1e-3)
