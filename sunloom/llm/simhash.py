"""SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints are cut into blocks of bits. Two fingerprints within the
budget of differing bits agree wholly in ``blocks - budget`` of the blocks, so
each fingerprint goes once to every choice of that many blocks, keyed by their
bits. In each such group the binary trie of the fingerprints is joined with
itself: pairs of nodes descend together, differing bits accumulate, and a pair
is dropped once it exceeds the budget, or once both of its nodes lie wholly in
one component. A task emits a spanning forest of what it has linked, never all
pairs; the forests meet in a distributed connected-components step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import byte_texts, cut, keep_rows, release_memory, text_id, with_group
from sunloom.llm.hashing import shingle_hashes, words_of

WIDTH, BUDGET, BITS = 4, 4, 64
#: Rows of one group that one task joins; larger groups are cut into parts, and every two parts meet in some task.
PART_ROWS = 20_000
#: Edges up to which a node's neighbours may all meet in one task.
SPREAD_EDGES = 1_000_000
#: Node pairs in flight in a task.
FRONTIER = 1 << 19


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""
    chosen = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(words_of(t), width)) for t in byte_texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])
        release_memory()

    from pyspark.sql.types import LongType, StructField, StructType

    return chosen.mapInArrow(run, StructType([chosen.schema["doc_id"], StructField("fp", LongType())]))


class Forest:
    """Union-find over positions 0..n-1 that remembers the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def flatten(self) -> np.ndarray:
        """The root of every position."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up

    def union(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((a, b))


def trie_self_join(prints: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links within each group.

    ``prints`` (uint64) must be sorted and distinct within each run of equal
    ``group`` values. A node is a range of positions at a depth; its children
    are the halves where the next bit is 0 and 1.
    """
    n = len(prints)
    forest = Forest(n)
    if n < 2:
        return []
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lo, hi = cuts, np.r_[cuts[1:], n]
    many = hi - lo > 1
    # Where each bit turns to 1, by position: ones[d][i] = number of set bits d in prints[:i].
    ones: dict[int, np.ndarray] = {}

    def split(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum(((prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64))]
        return b - (ones[depth][b] - ones[depth][a])

    stack = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, apart = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, alo[i], ahi[i], blo[i], bhi[i], apart[i]) for i in (slice(half, None), slice(0, half))]
            continue
        roots = forest.flatten()
        # Whole nodes within one component have nothing left to link: equal least and greatest root.
        if depth and depth % 4 == 0 and len(alo):
            turns = np.r_[0, np.cumsum(roots[1:] != roots[:-1])]
            flat = (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (roots[alo] == roots[blo])
            alo, ahi, blo, bhi, apart = (x[~flat] for x in (alo, ahi, blo, bhi, apart))
        # Two single prints: their distance is known at once.
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget) & (roots[a] != roots[b])
            forest.union(np.stack([a[near], b[near]], axis=1))
            alo, ahi, blo, bhi, apart = (x[~single] for x in (alo, ahi, blo, bhi, apart))
        if not len(alo) or depth == BITS:
            continue
        amid, bmid = split(alo, ahi, depth), split(blo, bhi, depth)
        same = (alo == blo) & (ahi == bhi)
        nexts = []
        for a0, a1, b0, b1, far, skip in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, same)):
            keep = (a1 > a0) & (b1 > b0) & (apart + far <= budget)
            if skip is not None:
                keep &= ~skip
            nexts.append((a0[keep], a1[keep], b0[keep], b1[keep], apart[keep] + np.int8(far)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*nexts, strict=True))))
    return forest.links


def blocks_for(n: int, budget: int = BUDGET, share: int = 64) -> int:
    """Blocks such that random groups have at most ``share`` members; every choice finds all links."""
    for blocks in range(budget + 1, budget + 5):
        if n / 2 ** (BITS * (blocks - budget) / blocks) <= share:
            return blocks
    return budget + 4


def block_keys(blocks: int, budget: int = BUDGET, among: int = -1) -> list[int]:
    """Bit masks of every choice of ``blocks - budget`` blocks of the bits of ``among``."""
    bits = [i for i in range(BITS) if among >> i & 1]
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - budget)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_forest(prints: DataFrame, budget: int = BUDGET, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints ``prints.fp``."""
    masks = block_keys(blocks_for(prints.count(), budget), budget)

    def keyed_by(rows: DataFrame, masks: list[int]) -> DataFrame:
        choices = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks])
        return rows.select("fp", F.explode(choices).alias("k")).select("fp", F.xxhash64("k.mask", "k.bits").alias("group"))

    keyed = keyed_by(prints, masks)
    sizes = cut(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    over = sizes.where(F.col("n") > part_rows)
    if not over.isEmpty():
        # Members of a large group first get longer keys: of the bits that they don't share by their choice, a link agrees on two of six further blocks.
        fine = None
        for mask in masks:
            own = keyed_by(prints, [mask]).join(over.select("group"), "group", "left_semi")
            more = keyed_by(own.select("fp"), [mask | m for m in block_keys(budget + 2, budget, ~mask)])
            fine = more if fine is None else fine.unionByName(more)
        # Two choices may come to the same longer key.
        keyed = cut(keyed.join(over.select("group"), "group", "left_anti").unionByName(fine.distinct()))
        sizes = cut(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    large = cut(sizes.where(F.col("n") > part_rows).select("group", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    rows = keyed.join(sizes.select("group"), "group", "left_semi").withColumn("part", F.lit(0)).withColumn("with", F.lit(0))
    if not large.isEmpty():
        cutup = keyed.join(large, "group").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        pairs = cutup.select("fp", "group", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = rows.join(large, "group", "left_anti").unionByName(
            pairs.select("fp", "group", F.least("own", "other").alias("part"), F.greatest("own", "other").alias("with"))
        )
    task = F.xxhash64("group", "part", "with")
    dealt = rows.select(task.alias("task"), "fp").repartition("task").sortWithinPartitions("task")

    def join(task_ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((bits, task_ids))
        task_ids, bits = task_ids[order], bits[order]
        links = np.array(trie_self_join(bits, task_ids, budget), np.int64).reshape(-1, 2)
        pairs = [pa.array(bits[links[:, i]].view(np.int64)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_task, held_bits = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            held_task = np.r_[held_task, batch.column("task").to_numpy()]
            held_bits = np.r_[held_bits, batch.column("fp").to_numpy().view(np.uint64)]
            done = np.searchsorted(held_task, held_task[-1]) if len(held_task) else 0
            if done > 100_000:  # the last task may go on in the next batch
                yield join(held_task[:done], held_bits[:done])
                held_task, held_bits = held_task[done:], held_bits[done:]
        yield join(held_task, held_bits)

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60, spread: int | None = None) -> DataFrame:
    """(node, root) of every linked node, root being the component's smallest node.

    Alternates large-star and small-star steps; each is one grouped minimum that
    is combined before the shuffle and one join. With more than ``spread`` edges (default: ``SPREAD_EDGES``),
    nodes with very many neighbours are broadcast in the joins instead of being
    dealt by their key. Raises if the components don't settle in ``rounds``
    rounds (paths halve in each).
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    n, spread = edges.count(), SPREAD_EDGES if spread is None else spread

    def least(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return cut(low) if n > spread else low

    def joined(both: DataFrame, low: DataFrame) -> DataFrame:
        return (with_group(both, low, "u", "n") if n > spread else both.join(low, "u")).drop("n")

    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(joined(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = least(large)
        small = joined(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        small = cut(small.distinct())
        before, had, edges = edges, n, small
        n = edges.count()
        if had == n and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) for every row of ``df``.

    Null and empty texts have fingerprint 0 and link like any other. Null keys
    take part; their component's id is its smallest key that isn't null, or null.
    Repeated rows share a fingerprint. Other columns are not read, so no name
    can clash. An empty table gives an empty result.
    """
    rows = cut(fingerprints(df, key, text, width))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = cut(components(link_forest(prints.select("fp"), budget)))
    placed = cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    ids = cut(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    lookup = cut(with_group(placed, ids, "root", "prints").select("fp", "component_id", "n"))
    return with_group(rows, lookup, "fp", "n").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, F.lit("0"))


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """Rows of ``df`` that stay: of each component the row with the smallest key, null last, then the smallest text hash; once if it repeats.

    Keys may be null or repeat: what goes or stays is a key with its text.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.coalesce(text_id(text), F.lit(b"")).alias("text"))
    components_of = near_components(df.select(place.alias("place"), F.col(text).alias("text")), "place", "text", width, budget)
    # A null would match no other in a join, so places are compared by their text form.
    plain = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(text_id(text), F.lit(b"")).alias("text"))
    kept = components_of.select("component_id").distinct().select(
        F.struct(F.col("component_id.none").alias("none"), F.coalesce(F.col("component_id.key").cast("string"), F.lit("")).alias("key"), F.col("component_id.text").alias("text")).alias("place")
    )
    return keep_rows(df, plain, kept)
