from collections import defaultdict

import pytest

from sunloom.llm import mixing, sharding, simhash

from .helpers import awkward, documents, prose
from .test_simhash import plain_components, plain_fingerprint

cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(i, 30 + i % 50), "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]
    rows += [(300 + i, rows[50 + i][1] + " " + prose(900, 30), "en", "s2") for i in range(5)]
    documents(spark, rows).unionByName(awkward(spark)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "shards"]

    known = cp.language_id(spark, docs, corpus).cache()
    assert known.columns == docs.columns
    have = [(r.doc_id, r.text) for r in known.collect()]
    assert {i for i, _ in have} >= {i for i in range(150)} | {200, 300}
    assert all(any(c.isalpha() for c in t) for _, t in have)

    unique = cp.near_duplicates(spark, known, corpus).cache()
    # One row of each component, that with its smallest key; keys that repeat with other texts are other documents.
    rows = known.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    component = dict(zip(prints, plain_components(prints, list(range(len(rows)))), strict=True))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        own = least.get(component[p])
        least[component[p]] = r.doc_id if own is None else own if r.doc_id is None else min(own, r.doc_id)
    assert {component[plain_fingerprint(r.text)]: r.doc_id for r in unique.collect()} == least
    assert unique.count() == len(least)

    clean = cp.decontamination(spark, unique, corpus).cache()
    assert {r.doc_id for r in unique.collect()} - {r.doc_id for r in clean.collect()} == {i for i in range(300, 305)}

    mixed = cp.source_mix(spark, clean, corpus).cache()
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    want = defaultdict(int)
    for r in mixing.mix(clean).where("copies > 0").collect():
        want[r.doc_id] += r.copies
    assert copies == want
    assert mixed.columns == docs.columns

    last = cp.shards(spark, mixed, corpus)
    assert last.count() == mixed.count()
    assert {"shard", "shard_depth", "n_bytes", "oversized"} <= set(last.columns)


def test_run(spark, corpus):
    out = cp.run(spark, corpus)
    assert out.count() > 50
    assert simhash.near_components(out).count() == out.count()
    assert sum(r.n_bytes for r in out.collect()) <= sharding.PRODUCTION_LIMIT


def test_run_on_no_documents(spark, corpus, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_own_key(spark, corpus):
    texts = [prose(2000 + i, 60) for i in range(12)]
    leak = prose(5000, 40) + " " + prose(900, 30)
    rows = [(None if i < 8 else 7, t, "en", "a") for i, t in enumerate(texts)]
    docs = documents(spark, [*rows, rows[0], rows[8], (None, leak, "en", "a"), (7, leak + " end", "en", "b"), (None, None, "en", "a")])
    unique = cp.near_duplicates(spark, docs.where("doc_id is null"), corpus)
    kept = [r.text for r in unique.collect()]
    prints = list({plain_fingerprint(t) for t in [*texts[:8], leak, None]})
    assert len(kept) == len(set(plain_components(prints, list(range(len(prints))))))
    assert set(kept) == {*texts[:8], leak, None}
    clean = cp.decontamination(spark, docs, corpus)
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(map(str, [*texts, texts[0], texts[8], None]))
