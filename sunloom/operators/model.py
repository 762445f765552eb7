"""Estimators of the power ratio, and their saved artifacts.

``linear`` is Spark ML's linear regression and ``trees`` its gradient-boosted
trees. ``ensemble`` is a small batch-ensemble network in NumPy (shared weights,
per-member scales, mean of members); it isn't TabM and doesn't claim its scores.
"""

from __future__ import annotations

import json
import platform
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.operators.checks import DataError
from sunloom.operators.fingerprints import file_hash, json_hash, tensors_hash
from sunloom.settings import PREDICTION_CLIP, Settings

#: Rows that the driver-trained ensemble takes at most.
ENSEMBLE_ROWS = 200_000


class Fitted(Protocol):
    history: list[dict[str, float]]

    def predict(self, frame: DataFrame) -> DataFrame: ...

    def save(self, folder: str) -> None: ...


def seeds(seed: int) -> dict[str, int]:
    """One seed for each source of chance."""
    return {"python": seed, "numpy": seed + 1, "model": seed + 2}


@dataclass
class SparkModel:
    kind: str
    model: Any
    history: list[dict[str, float]] = field(default_factory=list)

    def predict(self, frame: DataFrame) -> DataFrame:
        """``frame`` with ``raw_prediction``."""
        return self.model.transform(frame.withColumn("__v", array_to_vector("features"))).withColumnRenamed("__p", "raw_prediction").drop("__v")

    def save(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/model")


@dataclass
class EnsembleModel:
    weights: dict[str, np.ndarray]
    history: list[dict[str, float]] = field(default_factory=list)
    kind: str = "ensemble"

    @staticmethod
    def forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden activations (rows x members x units) and outputs (rows x members)."""
        hidden = np.maximum(((x[:, None, :] * w["in_scale"]) @ w["first"]) * w["out_scale"] + w["first_bias"], 0.0)
        return hidden, (hidden * w["second"]).sum(axis=2) + w["second_bias"]

    def predict(self, frame: DataFrame) -> DataFrame:
        shared, forward = frame.sparkSession.sparkContext.broadcast(self.weights), EnsembleModel.forward

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(forward(shared.value, np.stack(batch.to_numpy()))[1].mean(axis=1) if len(batch) else [], dtype=float)

        return frame.withColumn("raw_prediction", run("features"))

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        np.savez(f"{folder}/model.npz", **self.weights)


def _fit_ensemble(train: DataFrame, validation: DataFrame, settings: Settings, seed: int) -> EnsembleModel:
    """AdamW on every member's squared error; stops after more bad epochs than the patience, keeps the best epoch."""
    config = settings["training"]

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.orderBy("row_id").select("features", "label").limit(ENSEMBLE_ROWS + 1).toPandas()
        if len(rows) > ENSEMBLE_ROWS:
            raise DataError(f"the ensemble takes {ENSEMBLE_ROWS} rows at most; use linear or trees")
        return np.stack(rows["features"].to_numpy()), rows["label"].to_numpy(float)

    (x, y), (vx, vy) = arrays(train), arrays(validation)
    r, members, units = np.random.default_rng(seeds(seed)["model"]), 8, 32
    w = {
        "in_scale": r.choice([-1.0, 1.0], (members, x.shape[1])), "first": r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], units)), "out_scale": np.ones((members, units)),
        "first_bias": np.zeros((members, units)), "second": r.normal(0, np.sqrt(1 / units), (members, units)), "second_bias": np.full(members, y.mean()),
    }
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    best, kept, bad, history, t = np.inf, w, 0, [], 0
    for epoch in range(1, int(config["epochs"]) + 1):
        for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // int(config["batch_size"]))):
            bx, t = x[rows], t + 1
            hidden, out = EnsembleModel.forward(w, bx)
            g = 2 * (out - y[rows, None]) / out.size
            inner = g[:, :, None] * w["second"] * (hidden > 0)
            scaled = bx[:, None, :] * w["in_scale"]
            grads = {"second_bias": g.sum(0), "second": (g[:, :, None] * hidden).sum(0), "first_bias": inner.sum(0), "out_scale": (inner * (scaled @ w["first"])).sum(0)}
            back = inner * w["out_scale"]
            grads["first"] = np.einsum("nmi,nmo->io", scaled, back)
            grads["in_scale"] = ((back @ w["first"].T) * bx[:, None, :]).sum(0)
            norm = np.sqrt(sum((v * v).sum() for v in grads.values()))
            cut = min(1.0, float(config["gradient_clipping_norm"]) / max(norm, 1e-12))
            for k, v in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * cut * v
                square[k] = 0.999 * square[k] + 0.001 * (cut * v) ** 2
                step = (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                w[k] = w[k] - float(config["learning_rate"]) * (step + float(config["weight_decay"]) * w[k])
        rmse = float(np.sqrt(np.mean((EnsembleModel.forward(w, vx)[1].mean(axis=1) - vy) ** 2)))
        history.append({"epoch": epoch, "rmse": rmse})
        if rmse < best:
            best, kept, bad = rmse, {k: v.copy() for k, v in w.items()}, 0
        else:
            bad += 1
            if bad > int(config["early_stopping_patience"]):
                break
    return EnsembleModel(kept, history)


def fit(train: DataFrame, validation: DataFrame, settings: Settings, seed: int = 0) -> Fitted:
    """The configured estimator on array column ``features`` and ``label``; validation scores are of unclipped ratios."""
    kind = settings["model"].get("estimator", "linear")
    if kind == "ensemble":
        return _fit_ensemble(train, validation, settings, seed)
    makers = {"linear": lambda: LinearRegression(maxIter=100, regParam=1e-4), "trees": lambda: GBTRegressor(seed=seeds(seed)["model"], maxIter=30)}
    if kind not in makers:
        raise DataError(f"unknown estimator: {kind}")
    estimator = makers[kind]().setFeaturesCol("__v").setLabelCol("label").setPredictionCol("__p")
    fitted = SparkModel(kind, estimator.fit(train.select(array_to_vector("features").alias("__v"), "label")))
    e = F.col("raw_prediction") - F.col("label")
    fitted.history.append({"epoch": 1, "rmse": fitted.predict(validation).agg(F.sqrt(F.avg(e * e))).first()[0]})
    return fitted


def restore(frame: DataFrame, labels, truth: bool = True) -> DataFrame:
    """Clipped ratios and powers of ``raw_prediction``: ratio within 0..1.2 times the row's capacity."""
    low, high = PREDICTION_CLIP
    ratio = F.least(F.greatest(labels.inverse(F.col("raw_prediction")), F.lit(low)), F.lit(high)).cast("float")
    out = frame.withColumn("prediction_ratio", ratio).withColumn("prediction", (F.col("prediction_ratio").cast("double") * F.col("capacity")).cast("float"))
    if truth:
        out = out.withColumn("groundtruth_ratio", F.col("target_ratio")).withColumn("groundtruth", F.col("target_power"))
    keep = ["row_id", "station_id", "source_file", "timestamp", "occurrence", "target_timestamp", "horizon_step", "capacity"]
    return out.select(*keep, *(["groundtruth", "groundtruth_ratio"] if truth else []), "prediction", "prediction_ratio")


def environment(spark) -> dict[str, Any]:
    return {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "master": spark.sparkContext.master}


def _folder_hash(folder: Path) -> str:
    """Hash of a saved model's files, by name; checksums and markers of the writer aside."""
    names = sorted(p for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    return json_hash([[p.relative_to(folder).as_posix(), file_hash(p)] for p in names])


def _learned(features) -> str:
    return tensors_hash({"probabilities": features.probabilities, "values": features.values})


def save(fitted: Fitted, features, labels, folder: str, contract: dict[str, Any], seed: int, step: int | None = None, stations: list[str] | None = None) -> dict[str, Any]:
    """Model, knots and history, then the manifest, which marks the folder as whole."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    fitted.save(folder)
    np.savez(path / "quantiles.npz", probabilities=features.probabilities, values=features.values)
    (path / "history.json").write_text(json.dumps(fitted.history))
    manifest = {
        "estimator": fitted.kind, "seeds": seeds(seed), "features": features.features, "n_features": len(features.features), "label": {"mode": labels.mode, "center": labels.center, "scale": labels.scale},
        "step": step, "trained_stations": stations, "contract_sha256": json_hash(contract), "quantiles_sha256": file_hash(path / "quantiles.npz"), "learned_sha256": _learned(features),
        "history_sha256": file_hash(path / "history.json"), "model_sha256": tensors_hash(fitted.weights) if isinstance(fitted, EnsembleModel) else _folder_hash(path / "model"),
    }
    manifest["manifest_sha256"] = json_hash(manifest)
    (path / "artifact_manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def load(folder: str, contract: dict[str, Any], step: int | None = None):
    """(fitted, quantiles, labels, manifest) of a saved folder; any difference from its manifest, the contract or the step is an error."""
    from sunloom.operators.preprocessing import LabelScale, QuantileTransform

    path = Path(folder)
    if not (path / "artifact_manifest.json").exists():
        raise DataError(f"{folder} isn't a finished artifact")
    manifest = json.loads((path / "artifact_manifest.json").read_text())
    said = contract.get("features", {})
    promised = [*said.get("base_features", []), *said.get("factor_features", [])]
    rules = {
        "its manifest was changed": manifest["manifest_sha256"] != json_hash({k: v for k, v in manifest.items() if k != "manifest_sha256"}),
        "it was trained under another contract": manifest["contract_sha256"] != json_hash(contract),
        f"it isn't of step {step}": step is not None and manifest["step"] != step,
        "its features aren't the contract's": bool(promised) and manifest["features"] != promised,
        "its features and their number differ": manifest["n_features"] != len(manifest["features"]),
        "its quantiles were changed": manifest["quantiles_sha256"] != file_hash(path / "quantiles.npz"),
        "its history was changed": manifest["history_sha256"] != file_hash(path / "history.json"),
    }
    if broken := [k for k, bad in rules.items() if bad]:
        raise DataError(f"{folder}: {broken}")
    stored = np.load(path / "quantiles.npz")
    features = QuantileTransform(manifest["features"], stored["probabilities"], stored["values"])
    if features.values.shape != (len(features.probabilities), manifest["n_features"]):
        raise DataError(f"{folder}: its quantiles aren't of {manifest['n_features']} features")
    if _learned(features) != manifest["learned_sha256"]:
        raise DataError(f"{folder}: its learned state differs")
    history = json.loads((path / "history.json").read_text())
    if manifest["estimator"] == "ensemble":
        fitted: Any = EnsembleModel(dict(np.load(path / "model.npz")), history)
        found = tensors_hash(fitted.weights)
    else:
        found = _folder_hash(path / "model")
        kind = {"linear": LinearRegressionModel, "trees": GBTRegressionModel}[manifest["estimator"]]
        fitted = SparkModel(manifest["estimator"], kind.load(f"{folder}/model"), history)
    if found != manifest["model_sha256"]:
        raise DataError(f"{folder}: its model was changed")
    return fitted, features, LabelScale(**manifest["label"]), manifest
