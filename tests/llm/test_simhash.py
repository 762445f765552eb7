import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sunloom.llm import simhash

from .helpers import awkward, documents, prose


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(prints, ids):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def cluster_prints(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n // 10):
        x = r.getrandbits(64)
        for _ in range(10):
            out.append(x)
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
    return sorted(set(out))


@pytest.mark.parametrize("n", [0, 1, 10, 200, 900])
def test_trie_join_finds_all_components(n):
    prints = np.array(cluster_prints(n, n) or [], np.uint64)
    links = simhash.trie_self_join(prints, np.zeros(len(prints), np.int64))
    assert len(links) < max(1, len(prints))
    want = plain_components(prints.tolist(), list(range(len(prints))))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (int(prints[a]) ^ int(prints[b])).bit_count() <= 4
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(prints))] == want


def test_trie_join_of_a_dense_ball_stays_small():
    r = random.Random(4)
    prints = np.array(sorted({0x0123456789ABCDEF ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(3000)}), np.uint64)
    assert len(simhash.trie_self_join(prints, np.zeros(len(prints), np.int64))) == len(prints) - 1


@pytest.mark.parametrize("part_rows", [20_000, 7])
def test_forest_over_blocks(spark, part_rows):
    prints = cluster_prints(300, 9)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    roots = {np.int64(r.node).view(np.uint64).item(): np.int64(r.root).view(np.uint64).item() for r in simhash.components(simhash.link_forest(df, part_rows=part_rows)).collect()}
    want = plain_components(prints, list(range(len(prints))))
    groups = {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_blocks_cover_every_link():
    r = random.Random(1)
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_keys(blocks)
        for _ in range(200):
            x = 0
            for _ in range(4):
                x |= 1 << r.randrange(64)
            assert any(x & m == 0 for m in masks)


def test_documents_match_brute_force(spark):
    base = prose(1, 300).split()
    rows = [(i, " ".join(base[:i] + ["Changed"] + base[i + 1 :]), "en", "a") for i in range(0, 300, 20)]
    rows += [(1000 + i, prose(100 + i, 5 + 3 * i), "en", "b") for i in range(30)]
    df = documents(spark, rows).unionByName(awkward(spark)).withColumn("fp", F.lit("mine"))
    texts = df.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in texts]
    want = sorted(zip([r.doc_id or -1 for r in texts], [f"{p:016x}" for p in prints], [c or -1 for c in plain_components(prints, [r.doc_id for r in texts])], strict=True))
    got = simhash.near_components(df).withColumn("f", simhash.fingerprint_text("fp")).collect()
    assert sorted((r.doc_id or -1, r.f, r.component_id or -1) for r in got) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("spread", [10**6, 0])
def test_components_of_chains_and_stars(spark, spread):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long"), spread=spread).collect()}
    assert {r for n, r in got.items() if n > 99} == {100}
    assert {r for n, r in got.items() if 1 < n < 60} == {1}


def test_empty(spark):
    assert simhash.near_components(awkward(spark).limit(0)).count() == 0
    assert simhash.near_dedup(awkward(spark).limit(0)).count() == 0


def test_keys_that_repeat_with_other_texts_stay(spark):
    one, two = prose(1, 80), prose(2, 80)
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"), (9, one + " end", "en", "a"), (None, two + " end", "en", "a")]
    kept = simhash.near_dedup(documents(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    assert plain_components(prints, list(range(5))) == [0, 1, 1, 0, 1]
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, one), (5, two)])


def test_hot_prints_and_components(spark, monkeypatch):
    """Large groups go another way through the joins, with the same result."""
    from sunloom.llm import common

    monkeypatch.setattr(common, "LARGE_GROUP", 3)
    monkeypatch.setattr(simhash, "SPREAD_EDGES", 0)
    base = prose(1, 300).split()
    rows = [(i, " ".join(base[:i] + ["Changed"] + base[i + 1 :]), "en", "a") for i in range(0, 300, 10)] + [(1000 + i, prose(3, 20), "en", "b") for i in range(40)] + [(2000 + i, prose(50 + i, 30), "en", "b") for i in range(20)]
    df = documents(spark, rows)
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    want = dict(zip([r[0] for r in rows], plain_components(prints, [r[0] for r in rows]), strict=True))
    assert {r.doc_id: r.component_id for r in simhash.near_components(df).collect()} == want
