"""Fail-closed checks: explicit aggregates, since a lazy assertion can be pruned away."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """Data that breaks a rule."""


def reject(frame: DataFrame, rules: Mapping[str, Column], label: Sequence[str] = ("station_id", "timestamp")) -> None:
    """Raise on the first rule that some row breaks. All rules are counted in one pass, with one offender each."""
    have = [c for c in label if c in frame.columns]
    who = F.struct(*[F.col(c) for c in have]) if have else F.struct(F.lit("").alias("row"))
    counts = []
    for i, bad in enumerate(rules.values()):
        broken = F.coalesce(bad, F.lit(False))
        counts += [F.count_if(broken).alias(f"n{i}"), F.min(F.when(broken, F.to_json(who))).alias(f"w{i}")]
    row = frame.agg(*counts).first()
    for i, message in enumerate(rules):
        if row[f"n{i}"]:
            raise DataError(f"{message}: {row[f'n{i}']} rows, such as {row[f'w{i}']}")


def repeated_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that more than one row has, and ``n``, how many have them."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated(frame: DataFrame, keys: Sequence[str], limit: int = 5) -> list[tuple]:
    """Up to ``limit`` key values that more than one row has."""
    rows = repeated_keys(frame, keys).orderBy(*keys).limit(limit).collect()
    return [tuple(r[k] for k in keys) for r in rows]


def require_unique(frame: DataFrame, keys: Sequence[str], what: str) -> None:
    if found := repeated(frame, keys):
        raise DataError(f"{what} repeat: {found}")


def require_rows(frame: DataFrame, what: str) -> None:
    if frame.isEmpty():
        raise DataError(f"{what} has no rows")


def missing_keys(frame: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``frame`` that ``known`` lacks."""
    return frame.select(key).distinct().join(known.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    """How many keys of ``a`` are also in ``b``."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct().count()
