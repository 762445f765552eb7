"""Hashes of values, rows, arrays and files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def json_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def ordered_hash(values: Iterable[Any]) -> tuple[int, str]:
    """Count and hash of texts in order, each after its length as eight little-endian bytes."""
    digest, n = hashlib.sha256(), 0
    for n, value in enumerate(values, 1):  # noqa: B007
        data = str(value).encode("utf-8")
        digest.update(len(data).to_bytes(8, "little") + data)
    return n, digest.hexdigest()


def array_hash(values: Any) -> str:
    """Hash of an array's shape and its little-endian float32 bytes."""
    array = np.ascontiguousarray(values, dtype="<f4")
    return hashlib.sha256(canonical_json(list(array.shape)).encode() + array.tobytes()).hexdigest()


def tensors_hash(tensors: Mapping[str, np.ndarray]) -> str:
    """Hash of named arrays: name, type, shape and bytes, by name."""
    digest = hashlib.sha256()
    for name in sorted(tensors):
        array = np.ascontiguousarray(tensors[name])
        digest.update(canonical_json([name, str(array.dtype), list(array.shape)]).encode() + array.tobytes())
    return digest.hexdigest()


def file_hash(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name, n_bytes, sha256) of files in any store, hashed on the executors, one file a row. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot(root: str | Path, patterns: Sequence[str]) -> dict[str, Any]:
    """Hashes of the files below ``root`` that match, and one over all of them."""
    base = Path(root)
    files = sorted({p for pattern in patterns for p in base.glob(pattern) if p.is_file()})
    each = {p.relative_to(base).as_posix(): file_hash(p) for p in files}
    return {"files": each, "snapshot_sha256": json_hash(each)}


def row_hash(*columns: str | Column) -> Column:
    """SHA-256 of the columns' texts, joined by a bar."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def set_fingerprint(frame: DataFrame, *columns: str) -> DataFrame:
    """A hash of the rows as a set with repeats, whatever their order: count, sum and xor of row hashes, in one distributed pass."""
    h = F.xxhash64(*(columns or frame.columns))
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def seed_rows_hash(rows: Mapping[int, Iterable[str]]) -> str:
    """Hash of the rows of all seeds, one ``seed|row`` text each, in order."""
    return json_hash([f"{seed}|{row}" for seed in sorted(rows) for row in rows[seed]])
