import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sunloom.llm import mixing

from .helpers import awkward, documents, prose


def test_word_count_and_edges(spark):
    df = awkward(spark)
    got = mixing.mix(df).collect()
    want = sorted((r.doc_id or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect())
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == want
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)


def test_targets_are_shared_and_capped():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 500}
    t = mixing.targets(sizes)
    assert t["a"] == 30
    assert sum(t.values()) == pytest.approx(2510)
    # b, c and null weigh 2, 1 and 5 (the fourth weight is the first again); null stops at 1500.
    assert t[None] == pytest.approx(1500)
    assert t["b"] == pytest.approx(2 * t["c"])


def test_taken_is_near_target_and_reruns_agree(spark):
    df = documents(spark, [(i, prose(i, 5 + i % 40), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1500)])
    one, two = (sorted((r.doc_id, r.copies) for r in mixing.mix(x).collect()) for x in (df, df.repartition(7)))
    assert one == two
    taken, target = defaultdict(int), {}
    for r in mixing.mix(df).collect():
        taken[r.members[0]] += r.taken
        target[r.members[0]] = r.target
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
    assert len({c for _, c in one}) > 1


def test_flow_uses_overlap_and_repeats_last():
    # "b" alone is too small for its quota; documents in both sources help it before anything repeats.
    flows = mixing.route({'["a"]': (["a"], 100), '["a","b"]': (["a", "b"], 100), '["b"]': (["b"], 20)}, {"a": 100.0, "b": 120.0})
    assert sum(v for (_, s), v in flows.items() if s == "b") == 120
    assert sum(v for (_, s), v in flows.items() if s == "a") == 100
    for p, size in (('["a"]', 100), ('["a","b"]', 100), ('["b"]', 20)):
        assert sum(v for (q, _), v in flows.items() if q == p) == size


def residual_has_no_cheaper_way(patterns, quotas, flows, most):
    """Whether no cycle of the residual graph costs less than nothing: the flow is of least cost for its amount."""
    ends, arcs = ["start", "end", *patterns, *[("q", s) for s in quotas]], []
    for p, (members, size) in patterns.items():
        sent = sum(flows[p, s] for s in members)
        for copy in range(most):
            used = min(max(sent - copy * size, 0), size)
            arcs += [("start", p, copy)] * (used < size) + [(p, "start", -copy)] * (used > 0)
        for s in members:
            arcs += [(p, ("q", s), 0)] * (flows[p, s] < most * size) + [(("q", s), p, 0)] * (flows[p, s] > 0)
    for s, quota in quotas.items():
        sent = sum(f for (_, t), f in flows.items() if t == s)
        assert sent <= round(quota)
        arcs += [(("q", s), "end", 0)] * (sent < round(quota)) + [("end", ("q", s), 0)] * (sent > 0)
    far = dict.fromkeys(ends, 0)
    for _ in range(len(ends)):
        moved = False
        for a, b, c in arcs:
            if far[a] + c < far[b]:
                far[b], moved = far[a] + c, True
        if not moved:
            break
    reach = {"start"}
    for _ in ends:
        reach |= {b for a, b, _ in arcs if a in reach}
    return not moved and "end" not in reach


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_largest_of_least_cost(seed):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    patterns = {str(i): (r.sample(names, r.randrange(1, 4)), r.randrange(1, 200)) for i in range(9)}
    quotas = {s: float(r.randrange(0, 500)) for s in names}
    assert residual_has_no_cheaper_way(patterns, quotas, mixing.route(patterns, quotas, 3), 3)


def test_selection_matches_brute_force(spark):
    """Every document's copies, from a plain walk along each pattern's line."""
    df = documents(spark, [(i, prose(i, 3 + i % 23), "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(600)])
    members = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("s1"), F.lit("s2"))).when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    tie = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), F.to_json(F.array_sort(members)), F.xxhash64("text"))
    rows = df.withColumn("n", F.size(F.split("text", " ")).cast("long")).select("doc_id", "n", F.array_sort(members).alias("m"), tie.alias("h")).collect()
    lines, sizes = defaultdict(list), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.h & (1 << 64) - 1, r.doc_id)):
        lines[tuple(r.m)].append(r)
        for s in r.m:
            sizes[s] += r.n
    quota = mixing.targets(dict(sizes))
    whole = {m: sum(r.n for r in line) for m, line in lines.items()}
    flows = mixing.route({str(m): (list(m), whole[m]) for m in lines if m}, quota)
    want = {}
    for m, line in lines.items():
        at, flow = 0, sum(flows[str(m), s] for s in m)
        for r in line:
            middle = at + r.n // 2
            want[r.doc_id] = sum(middle + k * whole[m] < flow for k in range(3)) if r.n else 0
            at += r.n
    got = {r.doc_id: r for r in mixing.mix(df, members=members).collect()}
    assert {d: r.copies for d, r in got.items()} == want
    assert all(got[r.doc_id].target == pytest.approx(quota[r.m[0]]) and got[r.doc_id].source_size == sizes[r.m[0]] for r in rows if r.m)


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_many_sources_equal_the_drivers(spark, seed):
    r = random.Random(seed)
    sizes = {f"host{r.randrange(10**6)}.example": int(r.paretovariate(0.6)) for _ in range(500)} | {None: 40, "": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {x.source: x.target for x in mixing.target_table(table, driver_sources=0).collect()}
    assert got == pytest.approx(mixing.targets(sizes))


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    df = documents(spark, [(i, prose(i, 5 + i % 9), "en", f"h{i % 300}") for i in range(900)])
    one = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 5)
    monkeypatch.setattr(mixing, "MAX_OVERLAPS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_KEYS", 0)
    assert sorted(map(str, mixing.mix(df).collect())) == one
    copies = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        copies[r.doc_id] += 1
    assert copies == {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}


def test_overlapping_members(spark):
    df = documents(spark, [(i, prose(i, 20), "en", "a") for i in range(200)])
    members = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    out = mixing.mix(df, members=members, weights=(1, 1)).collect()
    assert all(0 <= r.copies <= 3 for r in out)
    assert sum(r.taken for r in out) > 0


def test_mixed_documents_repeat_rows(spark):
    df = documents(spark, [(i, prose(i, 20), "en", f"s{i % 4}") for i in range(200)]).withColumn("copies", F.lit(1)).withColumn("size", F.lit("x"))
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}
    got = defaultdict(int)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == want
    assert max(want.values()) > 1 and len(want) < 200


def test_rows_without_a_key_are_told_by_their_text(spark):
    df = documents(spark, [(None, prose(i, 4 + i % 7), "en", "ab"[i % 2]) for i in range(300)])
    taken = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        taken[r.source] += len(r.text.split())
    target = {r.members[0]: r.target for r in mixing.mix(df).collect()}
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)


def test_empty(spark):
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    assert mixing.mixed_documents(awkward(spark).limit(0)).count() == 0
