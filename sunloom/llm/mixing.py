"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A small flow network routes the tokens of patterns that overlap to their
sources' quotas; the n-th repetition of a token costs n - 1, so that repeats are
used last and evenly. A source that shares no document with another needs no
network: its own pattern fills its quota. Documents of a pattern are then laid on
a line in seeded hash order, and the flows cover that line from its start, as
often as needed: a document is taken once for each time that its midpoint is
covered. Only one hash range of a pattern holds the line's last cut; documents of
all other ranges know their copies from the range alone, so they are neither
ordered nor moved.
"""

from __future__ import annotations

import json
import math
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm.common import BROADCAST_KEYS, byte_texts, cut, empty_text, release_memory, with_group

PRODUCTION_WEIGHTS = (5, 2, 1)
#: Copies of a document that a mix may hold at most.
MAX_COPIES = 3
#: The driver solves the flow over patterns that share sources. It sees this many of them at most, and refuses more.
MAX_OVERLAPS = 20_000
#: Sources whose targets the driver shares out; of more, their table is shared out by aggregates.
DRIVER_SOURCES = 20_000
#: Hash ranges per pattern, in bits: coarse ones, and fine ones in each; the rows of one fine range are ordered in one task.
COARSE_BITS, FINE_BITS = 7, 7
SEED = 20_240_601


def word_counts(df: DataFrame, text: str, keep: Sequence[Column]) -> DataFrame:
    """``keep`` columns and ``size``, the number of words of the whole text (null: 0)."""
    chosen = df.select(*keep, F.col(text).cast("binary").alias("__text"))
    fields = [f for f in chosen.schema.fields if f.name != "__text"]
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array([len(t.split()) for t in byte_texts(batch, "__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), size], [*names, "size"])
        release_memory()

    from pyspark.sql.types import LongType, StructField, StructType

    return chosen.mapInArrow(count, StructType([*fields, StructField("size", LongType())]))


def ordered_sources(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def targets(sizes: dict[str | None, int], weights: Sequence[float] = PRODUCTION_WEIGHTS, most: int = MAX_COPIES) -> dict[str | None, float]:
    """Shares of the summed sizes by weight; a source above ``most`` times its size stops there and the rest is reshared."""
    names = ordered_sources(list(sizes))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, fixed, free = Fraction(sum(sizes.values())), {}, list(names)
    while free:
        left, shared = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / shared > most * sizes[s]]
        if not above:
            fixed |= {s: left * weight[s] / shared for s in free}
            break
        fixed |= {s: Fraction(most * sizes[s]) for s in above}
        free = [s for s in free if s not in fixed]
    return {s: float(v) for s, v in fixed.items()}


def target_table(sources: DataFrame, weights: Sequence[float] = PRODUCTION_WEIGHTS, most: int = MAX_COPIES, driver_sources: int | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a checkpoint with one row for each source.

    Many sources are ranked by ranges, and each round in which some reach their
    limit is one aggregate over the table; the driver sees a row for each range.
    """
    spark = sources.sparkSession
    driver_sources = DRIVER_SOURCES if driver_sources is None else driver_sources
    if sources.limit(driver_sources + 1).count() <= driver_sources:
        sizes = {r["source"]: r["source_size"] for r in sources.collect()}
        return spark.createDataFrame([(s, sizes[s], t) for s, t in targets(sizes, weights, most).items()], "source string, source_size long, target double")
    ranged = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    starts = [(p, sum(n for q, n in counts.items() if q < p)) for p in counts]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    whole = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in whole))
    weight = F.element_at(F.array(*[F.lit(int(w * scale)) for w in whole]), (F.pmod(place, F.lit(len(whole))) + 1).cast("int"))
    ranked = cut(ranged.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select("source", "source_size", weight.cast("long").alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0]
    fixed_size, left, shared = 0, total, ranked.agg(F.sum("weight")).first()[0]
    free = F.lit(True)
    exact = "decimal(38,0)"
    while shared:
        # A source is above its limit if left * weight / shared > most * size; decimals keep this exact.
        above = F.col("source_size").cast(exact) * F.lit(most * shared).cast(exact) < F.col("weight").cast(exact) * F.lit(left).cast(exact)
        row = ranked.agg(F.sum(F.when(above, F.col("source_size"))).alias("size"), F.sum(F.when(above, F.col("weight"))).alias("weight"), F.sum("weight").alias("weights")).first()
        free = ~above
        size, stopped = row["size"] or 0, row["weight"] or 0
        # Whoever was above its limit stays so: the excess only raises the others' shares.
        if size == fixed_size and row["weights"] - stopped == shared:
            break
        fixed_size, left, shared = size, total - most * size, row["weights"] - stopped
    share = F.lit(left).cast("double") * F.col("weight") / F.lit(max(shared, 1)).cast("double")
    return ranked.select("source", "source_size", F.when(free, share).otherwise(F.lit(float(most)) * F.col("source_size")).alias("target"))


class FlowNetwork:
    """Integer min-cost flow by successive shortest paths."""

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for end, r, c, start in ((b, room, cost, a), (a, 0, -cost, b)):
            self.out[start].append(len(self.ends))
            self.ends.append(end)
            self.room.append(r)
            self.cost.append(c)
        return len(self.ends) - 2

    def _cheapest(self, source: int) -> tuple[list[float], list[int]]:
        far, via = [float("inf")] * len(self.out), [-1] * len(self.out)
        far[source], queue, queued = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in self.out[a]:
                if self.room[e] and far[a] + self.cost[e] < far[b := self.ends[e]]:
                    far[b], via[b] = far[a] + self.cost[e], e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        return far, via

    def solve(self, source: int, sink: int) -> int:
        sent = 0
        while True:
            far, via = self._cheapest(source)
            if far[sink] == float("inf"):
                return sent
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.ends[via[at] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push


def route(patterns: dict[str, tuple[list[str | None], int]], quotas: dict[str | None, float], most: int = MAX_COPIES) -> dict[tuple[str, str | None], int]:
    """Tokens that each pattern sends to each source's quota."""
    net = FlowNetwork()
    start, end = net.node(), net.node()
    quota_node = {s: net.node() for s in ordered_sources(list(quotas))}
    for s, n in quota_node.items():
        net.arc(n, end, round(quotas[s]), 0)
    arcs = {}
    for name in sorted(patterns):
        members, size = patterns[name]
        node = net.node()
        for copy in range(most):
            net.arc(start, node, size, copy)
        for s in members:
            arcs[name, s] = net.arc(node, quota_node[s], most * size, 0)
    net.solve(start, end)
    return {k: net.room[e ^ 1] for k, e in arcs.items()}


def pattern_plans(patterns: DataFrame, weights: Sequence[float] = PRODUCTION_WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(pattern, n, all_size, flow, source_size, target) from (pattern, members, n, all_size): the words that the mix takes of each pattern."""
    spark, patterns = patterns.sparkSession, cut(patterns)
    sources = cut(patterns.select(F.explode("members").alias("source"), "all_size").groupBy("source").agg(F.sum("all_size").alias("source_size")))
    aimed = cut(target_table(sources, weights, most))
    shared = patterns.where(F.size("members") > 1).limit(MAX_OVERLAPS + 1).collect()
    if len(shared) > MAX_OVERLAPS:
        raise ValueError(f"more than {MAX_OVERLAPS} patterns of sources that overlap")
    routed = spark.createDataFrame([], "pattern string, routed long")
    if shared:
        names = spark.createDataFrame([(s,) for s in ordered_sources(list({s for r in shared for s in r["members"]}))], "shared string")
        own = patterns.where(F.size("members") == 1).join(F.broadcast(names), F.element_at("members", 1).eqNullSafe(F.col("shared"))).collect()
        quotas = {r["source"]: r["target"] for r in aimed.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("shared"))).collect()}
        flows = route({r["pattern"]: (r["members"], r["all_size"]) for r in [*shared, *own]}, quotas, most)
        # Of a pattern's flows only their sum matters to how often its documents are taken.
        sums = Counter()
        for (pattern, _), flow in flows.items():
            sums[pattern] += flow
        routed = spark.createDataFrame(list(sums.items()), "pattern string, routed long")
    found = patterns.join(aimed, F.try_element_at("members", F.lit(1)).eqNullSafe(F.col("source")) & (F.size("members") > 0), "left").join(F.broadcast(routed), "pattern", "left")
    return found.select(
        "pattern", "n", "all_size",
        F.coalesce("routed", F.bround("target").cast("long"), F.lit(0)).alias("flow"),
        F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
    )


def _pattern(members: Column) -> Column:
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(members))), F.lit("[]"))


def _place(key: str, text: str, pattern: Column, seed: int) -> Column:
    """A document's place on its pattern's line. Rows that repeat in key, members and text share one."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), pattern, F.xxhash64(empty_text(text)))


def _range(place: str) -> Column:
    return F.expr(f"shiftrightunsigned({place}, {64 - COARSE_BITS - FINE_BITS})")


def _before(column: str, keys: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows with their pattern's plan. Few patterns are broadcast after their count; of many, large ones."""
    if plans.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(plans), "pattern")
    return with_group(rows, plans, "pattern", "n")


def _planned(df: DataFrame, key: str, text: str, members: Column, weights: Sequence[float], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents without their texts, and for each pattern its copies: ``turns`` of each document, and one more up to ``cut`` words."""
    hashed = df.withColumn("__h", _place(key, text, _pattern(members), seed))
    counted = word_counts(hashed, text, [F.col(key).alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("members"), F.col("__h").alias("h")])
    slim = cut(counted.withColumn("pattern", _pattern(F.col("members"))).withColumn("range", _range("h")))
    by_pattern = slim.groupBy("pattern").agg(F.first("members").alias("members"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("all_size"))
    plans = pattern_plans(by_pattern, weights, most).withColumn("turns", F.expr("try_divide(flow - flow % nullif(all_size, 0), all_size)").cast("long")).withColumn("cut", F.expr("flow % nullif(all_size, 0)"))
    plans = cut(plans.select("pattern", "n", "source_size", "target", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("cut", F.lit(0)).alias("cut")))
    sums = cut(slim.groupBy("pattern", "range").agg(F.sum("size").alias("range_size")).withColumn("coarse", F.expr(f"shiftright(range, {FINE_BITS})")))
    # No window orders more than 128 ranges, however many documents a pattern has.
    coarse = sums.groupBy("pattern", "coarse").agg(F.sum("range_size").alias("coarse_size"))
    coarse = coarse.select("pattern", "coarse", _before("coarse_size", ["pattern"], ["coarse"]).alias("coarse_start"))
    starts = sums.withColumn("fine_start", _before("range_size", ["pattern", "coarse"], ["range"])).join(coarse, ["pattern", "coarse"])
    starts = starts.select("pattern", "range_size", F.col("range").alias("edge"), (F.col("coarse_start") + F.col("fine_start")).alias("edge_start"))
    edges = starts.join(plans.select("pattern", "cut"), "pattern").where("cut > 0 and edge_start <= cut and cut < edge_start + range_size").select("pattern", "edge", "edge_start")
    return slim, cut(plans.join(edges, "pattern", "left"))


def _settled(most: int) -> Column:
    """Copies of a document that isn't in its pattern's edge."""
    return F.least(F.col("turns") + F.coalesce(F.col("range") < F.col("edge"), F.lit(False)).cast("long"), F.lit(most))


def _edge_copies(rows: DataFrame, most: int) -> DataFrame:
    """``copies`` of documents in the edge of their pattern, in the order of their places."""
    middle = F.col("edge_start") + _before("size", ["pattern"], ["h", "doc_id"]) + F.expr("size div 2")
    return rows.withColumn("copies", F.least(F.col("turns") + (middle < F.col("cut")).cast("long"), F.lit(most)))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    members: Column | None = None,
    weights: Sequence[float] = PRODUCTION_WEIGHTS,
    most: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, members, size, source_size, target, copies and taken for every row of ``df``.

    ``members`` is an array column, the sources a document belongs to (default:
    its ``source`` alone); null is a source of its own, an empty array belongs
    nowhere and is never taken. ``source_size`` and ``target`` are those of the
    first member. Null and empty texts have size 0 and take 0 words. Rows that
    repeat in key, members and text share one place in the order; they are
    interchangeable. Other columns are not read. No rows give no rows.
    """
    slim, plans = _planned(df, key, text, F.array("source") if members is None else members, weights, most, seed)
    rows, edge = _with_plan(slim, plans), F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    done = rows.where(~edge).withColumn("copies", _settled(most)).unionByName(_edge_copies(rows.where(edge), most))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("copies")).cast("long").alias("copies")
    return done.select("doc_id", "members", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    members: Column | None = None,
    weights: Sequence[float] = PRODUCTION_WEIGHTS,
    most: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: rows of ``df`` that are taken, as often as they are taken.

    Rows equal in key, membership and text are one document of the mix; if
    repeats of one fall on both sides of a cut, all of them take the larger number.
    """
    members = F.array("source") if members is None else members
    slim, plans = _planned(df, key, text, members, weights, most, seed)
    inside = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    chosen = cut(_edge_copies(_with_plan(slim, plans).where(inside), most).groupBy("pattern", "h").agg(F.max("copies").alias("__own")))
    few = chosen.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    edges = (F.broadcast(chosen) if few else chosen).withColumnsRenamed({"pattern": "__pattern", "h": "__h"})
    names = {c: f"__{c}" for c in plans.columns}
    plain = plans.withColumnsRenamed(names)
    placed = df.withColumn("__pattern", _pattern(members)).withColumn("__h", _place(key, text, F.col("__pattern"), seed)).withColumn("__range", _range("__h"))
    if plans.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = placed.join(F.broadcast(plain), "__pattern")
    else:
        rows = with_group(placed, plain, "__pattern", "__n")
    rows = rows.join(edges, ["__pattern", "__h"], "left")
    settled = F.least(F.col("__turns") + F.coalesce(F.col("__range") < F.col("__edge"), F.lit(False)).cast("long"), F.lit(most))
    worded = empty_text(text).rlike(r"[^\x20\x09-\x0D]")
    copies = F.when(worded, F.coalesce("__own", settled)).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
