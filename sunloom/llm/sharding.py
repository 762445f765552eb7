"""Sharding by extendible hashing, with DataFrame functions only.

A document's bucket is a prefix of its hash bits. Only buckets above the byte
limit split on another bit. The first ``FIRST`` bits are resolved together: the
bytes of every hash cell, of which there are at most 2^20, are summed once and
all prefix sums come from that table. Only cells which are still too large go
down further, ``STEP`` bits at a time, so no pass has more than 16 cells for a
bucket that has to split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import cut, empty_text

#: Hash bits in all, and bits resolved by the first pass and by each further one.
BITS, FIRST, STEP = 60, 20, 4
#: Depths of the first pass up to which prefixes are broadcast: at most 2^17 of them.
SHALLOW = 16
#: Bits of a directory that is broadcast at most: 2^17 slots.
DIRECTORY_BITS = 17
PRODUCTION_LIMIT = 16 * 1024 * 1024


def hash_bits(key: str, text: str) -> Column:
    """60 bits of an MD5 over key and text, as a long; a null key or text counts as empty."""
    word = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(empty_text(text).cast("binary")))
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(cell: Column, depth: Column, step: int) -> Column:
    return F.call_function("shiftright", cell, (F.lit(step) - depth).cast("int"))


def _cell_depths(cells: DataFrame, limit: int, step: int) -> DataFrame:
    """For each (base, cell): the least number of its ``step`` bits at which its bucket fits; null if none does."""
    nodes = cells.select("base", "cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("depth"))
    nodes = nodes.withColumn("prefix", _prefix(F.col("cell"), F.col("depth"), step))
    key = ["base", "depth", "prefix"]
    over = nodes.groupBy(*key).agg(F.sum("bytes").alias("total")).where(F.col("total") > limit).select(*key)
    if step > SHALLOW:
        # All cells are below the few shortest prefixes, of which a table without bases has fewer than 2^(SHALLOW + 1).
        over, short = cut(over), F.col("depth") <= SHALLOW
        parents = nodes.where(short).join(F.broadcast(over.where(short)), key, "left_semi").unionByName(nodes.where(~short).join(over.where(~short), key, "left_semi"))
    else:
        parents = nodes.join(over, key, "left_semi")
    deep = parents.groupBy("base", "cell").agg(F.count(F.lit(1)).alias("n_over"))
    return cells.select("base", "cell").join(deep, ["base", "cell"], "left").select(
        "base", "cell", F.when(F.coalesce("n_over", F.lit(0)) <= step, F.coalesce("n_over", F.lit(0)).cast("int")).alias("depth")
    )


def _bit_text(value: Column, width: Column) -> Column:
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width, F.lit("0")))


def shard_documents(df: DataFrame, limit: int = PRODUCTION_LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with shard, shard_depth, n_bytes and oversized.

    ``shard`` is the bucket's hash prefix as text of 0 and 1 (empty: the only
    bucket); all its rows' UTF-8 bytes together are at most ``limit``. Rows that
    no bit can part (repeated rows, or one document above the limit) go to pages
    of their bucket, ``<prefix>+<page>``; a document above the limit has a page
    of its own and ``oversized`` true. Null and empty texts weigh 0 bytes and
    are placed by key. Columns of ``df`` with the names of these four are
    replaced. An empty table gives an empty result.
    """
    added = {"shard", "shard_depth", "n_bytes", "oversized"}
    rows = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in added],
        F.octet_length(empty_text(text)).cast("long").alias("n_bytes"),
        hash_bits(key, text).alias("__h"),
    )
    slim = cut(rows.groupBy("__h").agg(F.sum("n_bytes").alias("bytes")))
    pending, passes, done = slim.withColumn("base", F.lit("")), [], 0
    while done < BITS:
        step = STEP if done else FIRST
        done += step
        marked = pending.withColumn("cell", F.expr(f"shiftright(__h, {BITS - done}) & {(1 << step) - 1}"))
        cells = cut(marked.groupBy("base", "cell").agg(F.sum("bytes").alias("bytes")))
        depths = cut(_cell_depths(cells, limit, step))
        passes.append((marked, depths, step))
        if depths.where("depth is null").isEmpty():
            return _finish(_by_directory(rows, passes), df)
        found = marked.join(depths.where("depth is null"), ["base", "cell"])
        pending = cut(found.select("__h", "bytes", F.concat("base", _bit_text(F.col("cell"), F.lit(step))).alias("base")))
    return _with_pages(rows, _by_hash(passes), pending, limit, df)


def _shard_text(step: int) -> Column:
    return F.concat("base", _bit_text(_prefix(F.col("cell"), F.col("depth"), step), F.col("depth"))).alias("shard")


def _by_hash(passes: list[tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """(__h, shard) of every placed hash."""
    found = [marked.join(depths.where("depth is not null"), ["base", "cell"]).select("__h", _shard_text(step)) for marked, depths, step in passes]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _by_directory(rows: DataFrame, passes: list[tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """Rows with their shard, looked up in the directory by their first hash bits.

    A directory of at most 2^``DIRECTORY_BITS`` slots is broadcast, so that texts
    aren't moved; beyond, rows are joined by their hash.
    """
    shards = None
    for _, depths, step in passes:
        own = depths.where("depth is not null").select(_shard_text(step)).distinct()
        shards = own if shards is None else shards.unionByName(own)
    shards = cut(shards)
    deepest = shards.agg(F.coalesce(F.max(F.length("shard")), F.lit(0))).first()[0]
    if deepest > DIRECTORY_BITS:
        return rows.join(_by_hash(passes), "__h")
    width = F.lit(deepest) - F.length("shard")
    first = F.call_function("shiftleft", F.coalesce(F.conv(F.when(F.length("shard") > 0, F.col("shard")), 2, 10).cast("long"), F.lit(0).cast("long")), width)
    last = first + F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    slots = shards.select("shard", F.explode(F.sequence(first, last)).alias("__slot"))
    return rows.withColumn("__slot", F.expr(f"shiftright(__h, {BITS - deepest})")).join(F.broadcast(slots), "__slot").drop("__slot")


def _with_pages(rows: DataFrame, placed: DataFrame, pending: DataFrame, limit: int, df: DataFrame) -> DataFrame:
    """Rows of equal hash that exceed the limit: equal rows, dealt to pages by number.

    Each of 256 lanes numbers its own rows, so one hot row is not one task.
    """
    from pyspark.sql import Window

    lane = F.monotonically_increasing_id() % 256
    equal = rows.withColumn("__lane", lane).join(pending.select("__h", F.col("base").alias("__base")), "__h")
    number = F.row_number().over(Window.partitionBy("__h", "__lane").orderBy("n_bytes")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    paged = equal.withColumn("shard", F.concat("__base", F.lit("+"), F.col("__lane"), F.lit("."), F.floor(number / each))).drop("__lane", "__base")
    rest = rows.join(placed, "__h")
    return _finish(rest.unionByName(paged), df, limit)


def _finish(rows: DataFrame, df: DataFrame, limit: int | None = None) -> DataFrame:
    depth = F.length(F.substring_index("shard", "+", 1)).cast("int")
    over = F.lit(False) if limit is None else F.col("n_bytes") > limit
    return rows.drop("__h").withColumns({"shard_depth": depth, "oversized": over})


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: its prefix, local depth, bytes, documents and directory slots (2^(global - local))."""
    shards = sharded.groupBy("shard", "shard_depth").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    deepest = sharded.agg(F.coalesce(F.max("shard_depth"), F.lit(0))).first()[0]
    return shards.withColumn("global_depth", F.lit(deepest)).withColumn("slots", F.pow(F.lit(2.0), F.col("global_depth") - F.col("shard_depth")))
