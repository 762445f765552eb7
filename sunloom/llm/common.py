"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, line feed, VT, FF, carriage return.
#: ``bytes.split()`` without arguments splits on exactly these bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Keys that are broadcast at most (about 20 MB as a hash table).
BROADCAST_KEYS = 200_000
#: Rows up to which a group is never taken for a large one.
LARGE_GROUP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sunloom-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a reliable checkpoint, so that later plans don't compute them again."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give a Python worker's freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def empty_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_id(column: str | Column) -> Column:
    """SHA-256 of a text; a null text has none."""
    return F.unhex(F.sha2((F.col(column) if isinstance(column, str) else column).cast("binary"), 256))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a value's decimal text modulo ``modulus``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The byte strings of a binary column, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or b""


def without(df: DataFrame, keys: DataFrame, same: Column) -> DataFrame:
    """Rows of ``df`` that match no row of ``keys``. Few keys are broadcast after their count, so that ``df`` isn't shuffled."""
    keys = cut(keys)
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, same, "left_anti")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each ``key``, null keys match nothing; ``size`` is how many rows have it).

    A group with over a thousandth of all rows would be one large task. There are
    at most a thousand of these, so they are broadcast, and only the other rows
    are dealt by their key. Both inputs are read twice: they should be checkpoints.
    """
    most = max(LARGE_GROUP, (groups.agg(F.sum(size)).first()[0] or 0) // 1000)
    large = cut(groups.where(F.col(size) > most))
    if large.isEmpty():
        return rows.join(groups, key, how)
    hot = rows.join(F.broadcast(large), key)
    cold = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(size) <= most), key, how)
    return hot.unionByName(cold)


def keep_rows(df: DataFrame, place: Column, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose place is in the one column of ``kept``, one row for each place. Places are never null.

    Only rows whose place repeats go through a distinct, and few places that go
    are broadcast instead of moving ``df``.
    """
    marked = df.withColumn("__place", place)
    wanted = kept.select(F.col(kept.columns[0]).alias("__kept"))
    counts = cut(marked.groupBy(F.col("__place").alias("__own")).agg(F.count(F.lit(1)).alias("__n")))
    found = without(marked, counts.join(wanted, F.col("__own") == F.col("__kept"), "left_anti").select("__own"), F.col("__place") == F.col("__own"))
    repeated = cut(counts.where("__n > 1").select("__own"))
    if repeated.isEmpty():
        return found.drop("__place")
    few = repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    again = F.broadcast(repeated) if few else repeated
    same = F.col("__place") == F.col("__own")
    return found.join(again, same, "left_anti").unionByName(found.join(again, same, "left_semi").dropDuplicates(["__place"])).drop("__place")
