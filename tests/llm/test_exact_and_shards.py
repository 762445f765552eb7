import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sunloom.llm import common, exact_dedup, sharding
from sunloom.llm.queries import sharding_sql

from .helpers import awkward, documents, prose


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_match_brute_force(spark):
    df = awkward(spark)
    rows = df.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for g in got:
        ids = digest[g.text_sha256]
        known = [i for i in ids if i is not None]
        assert g.group_size == len(ids)
        assert g.keep_id == (min(known) if known else None)
        assert g.kept == (g.doc_id == g.keep_id)


def test_short_chunks_and_shifted_copies(spark):
    base = prose(5, 400)
    df = documents(spark, [(1, base, "en", "a"), (2, base.replace(" ", "\n\t"), "en", "a"), (3, "q " + base, "en", "a"), (4, base[:-1], "en", "a")])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df, pattern=r"(?s).{8,30}?[aeinorst][dghklmpuy](?=[ ])|.{1,32}").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_chunks_rebuild_the_text(spark):
    texts = [prose(i, n) for i, n in enumerate((0, 1, 50, 3000))] + ["x" * 5000, "中" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", exact_dedup.chunks_of(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t
        assert all(len(c) <= 1024 for c in r.c)


def test_dedup_keeps_columns_and_one_row(spark):
    df = awkward(spark).withColumn("kept", F.lit("mine")).withColumn("recipe", F.lit(1))
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r.text) for r in df.collect()})


def test_empty(spark):
    empty = awkward(spark).limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize(("limit", "bits"), [(200, 17), (1000, 17), (1000, 2), (10_000, 17), (10**9, 17)])
def test_shards_match_sql(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(sharding, "DIRECTORY_BITS", bits)
    df = documents(spark, [(i, prose(i, i % 30), "en", "a") for i in range(300)])
    con = duckdb.connect()
    con.register("d", df.toPandas())
    want = sorted(con.execute(sharding_sql(limit, table_name="d")).fetchall())
    got = sorted((r.doc_id, r.shard, r.shard_depth, r.n_bytes, r.oversized) for r in sharding.shard_documents(df, limit).collect())
    assert got == want


def test_shards_hold_the_limit(spark):
    df = awkward(spark).unionByName(documents(spark, [(77, prose(9, 40), "en", "a")] * 40)).withColumn("shard", F.lit("mine"))
    limit = 600
    rows = sharding.shard_documents(df, limit).collect()
    assert len(rows) == df.count()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    for r in rows:
        assert total[r.shard] <= limit or r.oversized
        assert r.oversized == (r.n_bytes > limit)
    firsts = {r.shard.split("+")[0] for r in rows}
    assert not any(a != b and b.startswith(a) for a in firsts for b in firsts)


def test_splits_beyond_the_first_bits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 4)
    df = documents(spark, [(i, prose(i, i % 30), "en", "a") for i in range(300)])
    con = duckdb.connect()
    con.register("d", df.toPandas())
    want = sorted(con.execute(sharding_sql(500, table_name="d")).fetchall())
    assert max(w[2] for w in want) > 4
    assert sorted((r.doc_id, r.shard, r.shard_depth, r.n_bytes, r.oversized) for r in sharding.shard_documents(df, 500).collect()) == want


def test_directory(spark):
    df = documents(spark, [(i, prose(i, 20), "en", "a") for i in range(200)])
    out = sharding.directory(sharding.shard_documents(df, 2000)).collect()
    assert sum(r.slots for r in out) == 2 ** out[0].global_depth
    assert sum(r.shard_docs for r in out) == 200


def test_keys_that_repeat_with_other_texts_stay(spark):
    rows = [(1, "one", "en", "a"), (1, "two", "en", "a"), (1, "two", "en", "a"), (2, "one", "en", "a"), (None, "three", "en", "a"), (None, "four", "en", "a"), (None, "two", "en", "a")]
    kept = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "one"), ("1", "two"), ("None", "four"), ("None", "three")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_groups_join_like_others(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)] + [(-1, None), (-2, 10**6)], "id long, k long")
    groups = rows.where("k is not null and id >= 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    want = sorted(map(str, rows.join(groups, "k", how).select("id", "k", "n", "last").collect()))
    for least in (256, 10**9):
        monkeypatch.setattr(common, "LARGE_GROUP", least)
        assert sorted(map(str, common.with_group(rows, groups, "k", "n", how).select("id", "k", "n", "last").collect())) == want


def test_chunks_of_other_scripts_depend_on_content(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("абвгдежзиклмнопрст ") for _ in range(6000)), "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6000))]
    for t in texts:
        df = spark.createDataFrame([(t,), ("x" + t,)], "t string")
        one, two = (set(row.c) for row in df.select(exact_dedup.chunks_of(F.col("t")).alias("c")).collect())
        assert len(one & two) >= 0.7 * len(one)
