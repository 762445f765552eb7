"""Preprocessing fitted on training rows only: quantile-to-normal features and label scaling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators.checks import DataError, overlap, reject, require_rows, require_unique
from sunloom.operators.fingerprints import array_hash, ordered_hash
from sunloom.settings import Settings

#: Cumulative probabilities are kept this far from 0 and 1.
EDGE = 1e-7
#: Training rows up to which knots are exact percentiles, and beyond which they come from sketches of a bounded size
#: whose ranks are off by at most one part in ``ACCURACY`` (knots are a thousandth apart or more).
EXACT_ROWS, ACCURACY = 2_000_000, 100_000


def quantile_count(rows: int, config: dict[str, Any]) -> int:
    most, least, each = (int(config.get(k, d)) for k, d in (("max_quantiles", 1000), ("min_quantiles", 10), ("samples_per_quantile", 30)))
    return max(1, min(rows, max(min(rows // each, most), least)))


def normal_inverse(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function (rational approximation, one Newton step)."""
    from math import erf, sqrt, tau

    # Acklam's coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    p = np.asarray(p, float)
    low, high = p < 0.02425, p > 1 - 0.02425
    q = np.sqrt(-2 * np.log(np.where(low, p, np.where(high, 1 - p, 0.5))))
    tails = np.polyval(c, q) / np.polyval(d, q) * np.where(high, -1, 1)
    r = p - 0.5
    x = np.where(low | high, tails, np.polyval(a, r * r) * r / np.polyval(b, r * r))
    cdf = 0.5 * (1 + np.vectorize(erf, otypes=[float])(x / sqrt(2)))
    return x - (cdf - p) * np.sqrt(tau) * np.exp(x * x / 2)


@dataclass(frozen=True)
class QuantileTransform:
    """Knots per feature: values[j, i] is feature i's quantile at probabilities[j]."""

    features: list[str]
    probabilities: np.ndarray
    values: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows x features; repeated knots are averaged from both sides."""
        out = np.empty_like(x, float)
        for i in range(x.shape[1]):
            knots = self.values[:, i]
            up = np.interp(x[:, i], knots, self.probabilities)
            down = -np.interp(-x[:, i], -knots[::-1], -self.probabilities[::-1])
            p = (up + down) / 2
            p[x[:, i] <= knots[0]] = 0.0
            p[x[:, i] >= knots[-1]] = 1.0
            out[:, i] = p
        return normal_inverse(np.clip(out, EDGE, 1 - EDGE))

    def manifest(self) -> dict[str, Any]:
        return {"n_features": len(self.features), "n_quantiles": len(self.probabilities), "features": self.features, "quantiles_sha256": array_hash(self.values), "probabilities_sha256": array_hash(self.probabilities)}


def noise(row_id: Column, feature: Column, seed: int, scale: float) -> Column:
    """A repeatable normal deviate for every cell, from the hash of its row and its feature's position."""
    u = (F.pmod(F.xxhash64(row_id, feature, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    v = (F.pmod(F.xxhash64(row_id, feature, F.lit(~seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * np.pi) * v) * scale


def fit_quantiles(train: DataFrame, vector: Column, names: Sequence[str], config: dict[str, Any], seed: int = 0, exact_rows: int = EXACT_ROWS) -> QuantileTransform:
    """Quantile knots of the training rows, all features in one grouped aggregation.

    Features are exploded to (feature, value), so no feature is a driver loop.
    Beyond ``exact_rows`` each task keeps one sketch of bounded size per feature,
    and only sketches are shuffled; an exact percentile would hold all distinct
    values of a feature in one task.
    """
    rows = train.count()
    n = quantile_count(rows, config)
    probabilities = np.linspace(0.0, 1.0, n)
    scale = float(config.get("noise_std", 0.0))
    exploded = train.select("row_id", F.posexplode(vector).alias("feature", "value"))
    if scale:
        exploded = exploded.withColumn("value", F.col("value") + noise(F.col("row_id"), F.col("feature"), seed, scale))
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    knots = F.percentile("value", points) if rows <= exact_rows else F.percentile_approx("value", points, ACCURACY)
    rows = exploded.groupBy("feature").agg(knots.alias("knots")).orderBy("feature").collect()
    values = np.array([r["knots"] for r in rows], float).T
    return QuantileTransform(list(names), probabilities, values)


def transform(frame: DataFrame, vector: Column, fitted: QuantileTransform, output: str = "features") -> DataFrame:
    """``frame`` with the transformed features as an array column."""
    shared = frame.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(shared.value.features)))
            yield pd.Series(list(shared.value.apply(rows)), dtype=object)

    return frame.withColumn(output, apply(vector))


@dataclass(frozen=True)
class LabelScale:
    """y -> (y - center) / scale and back."""

    mode: str
    center: float = 0.0
    scale: float = 1.0

    def forward(self, y: Column) -> Column:
        return (y - self.center) / self.scale

    def inverse(self, y: Column) -> Column:
        return y * self.scale + self.center


def fit_labels(train: DataFrame, settings: Settings, label: str = "target_ratio") -> LabelScale:
    """Modes none, scale (a fixed divisor) and standard (mean and population deviation of training labels)."""
    mode = settings["model"].get("label_normalization", "none")
    if mode == "none":
        return LabelScale(mode)
    if mode == "scale":
        return LabelScale(mode, 0.0, float(settings["model"].get("label_scale_value", 1.0)))
    if mode != "standard":
        raise DataError(f"unknown label normalization: {mode}")
    row = train.agg(F.avg(label), F.stddev_pop(label)).first()
    return LabelScale(mode, float(row[0]), float(row[1]) or 1.0)


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    validation: DataFrame
    features: QuantileTransform
    labels: LabelScale
    manifest: dict[str, Any]


def prepare(train: DataFrame, validation: DataFrame, vector: Column, names: Sequence[str], settings: Settings, fingerprint: bool = True, base: int | None = None) -> Prepared:
    """Checks, then features and labels fitted on ``train`` alone and applied to both.

    The manifest tells rows, the first ``base`` features' values, targets and
    capacities of both splits apart by hashes.
    """
    if len(set(names)) < len(names):
        raise DataError("feature names repeat")
    if {"station_id", "station"} & set(names):
        raise DataError("a station's id can't be a feature")
    for df, what in ((train, "training"), (validation, "validation")):
        require_rows(df, f"the {what} split")
        require_unique(df, ["row_id"], f"{what} row ids")
        reject(df, {f"a {what} feature isn't finite": ~F.forall(vector, finite), f"a {what} label isn't finite": ~finite(F.col("target_ratio"))}, ["row_id"])
    if n := overlap(train, validation, "row_id"):
        raise DataError(f"training and validation share {n} row ids")
    config, seed = settings["training"].get("preprocessing", {}), int(settings["training"].get("seed", 0))
    fitted, labels = fit_quantiles(train, vector, names, config, seed), fit_labels(train, settings)
    manifest: dict[str, Any] = {"features": fitted.manifest(), "label": {"mode": labels.mode, "center": labels.center, "scale": labels.scale}}
    if fingerprint:
        own = F.slice(vector, 1, base or len(names))
        manifest |= {f"{what}_{k}": v for df, what in ((train, "train"), (validation, "validation")) for k, v in split_values(df, own).items()}
    done = [transform(df, vector, fitted).withColumn("label", labels.forward(F.col("target_ratio").cast("double"))) for df in (train, validation)]
    return Prepared(*done, fitted, labels, manifest)


#: What a split's hashes are of, beside its row ids.
SPLIT_COLUMNS = ("target_ratio", "target_power", "capacity")


def split_values(frame: DataFrame, features: Column) -> dict[str, dict[str, Any]]:
    """Row count and order-free hashes of a split: of its rows, and of each row's features, target and capacity. One distributed pass."""
    cells = {"rows": F.xxhash64("row_id"), "features": F.xxhash64("row_id", features)}
    cells |= {c: F.xxhash64("row_id", c) for c in SPLIT_COLUMNS if c in frame.columns}
    aggregates = [a for k, h in cells.items() for a in (F.sum(h.cast("decimal(38,0)")).alias(f"{k}_sum"), F.bit_xor(h).alias(f"{k}_xor"))]
    row = frame.agg(F.count(F.lit(1)).alias("n"), *aggregates).first()
    return {k: {"rows": row["n"], "sum_hash": str(row[f"{k}_sum"]), "xor_hash": row[f"{k}_xor"]} for k in cells}


def split_fingerprint(frame: DataFrame) -> dict[str, Any]:
    """Row count and the hash of row ids in the frame's order, which passes every row id through the driver: for reports, on request."""
    ordered = frame.orderBy("timestamp", "station_id", "source_file", "row_id").select("row_id")
    n, digest = ordered_hash(r["row_id"] for r in ordered.toLocalIterator())
    return {"rows": n, "row_id_sha256": digest}
