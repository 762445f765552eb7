"""Training, evaluation and prediction runs."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import features, fingerprints, metrics, model, preprocessing, splits
from sunloom.operators.checks import DataError, missing_keys
from sunloom.operators.factors import selection_manifest
from sunloom.operators.factors.base import STEP
from sunloom.settings import Settings, load_settings
from sunloom.sources import stations

#: What the command line asks for before the sealed test is opened.
FINAL_TEST_PHRASE = "RUN SEALED FINAL TEST"


def run_contract(settings: Settings, factor_ids: Sequence[str] | None) -> dict[str, Any]:
    return {"features": features.contract(settings, factor_ids), "split": splits.contract(settings), "evaluation": dict(settings["evaluation"]), "factors": selection_manifest(factor_ids)}


def run_id(contract: dict[str, Any], now: datetime | None = None) -> str:
    """UTC time and eight digits of the contract's hash."""
    moment = now or datetime.now(timezone.utc)
    return f"{moment:%Y%m%dT%H%M%SZ}-{fingerprints.json_hash(contract)[:8]}"


def write_json(path: str | Path, value: Any) -> None:
    """Whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, sort_keys=True, indent=1, default=str) + "\n", "utf-8")
    part.replace(target)


def write_tables(tables: dict[str, DataFrame], folder: str, suffix: str = "") -> None:
    """Metric tables as one CSV folder each."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("error").csv(f"{folder}/{name}{suffix}", header=True)


def _of_step(frame: DataFrame, step: int) -> DataFrame:
    return frame.where(F.col(STEP) == step)


def train(spark: SparkSession, config, data, seed: int | None = None, factor_ids: Sequence[str] | None = (), out: str | None = None) -> dict[str, Any]:
    """Fit every requested step and score the validation rows.

    The feature frame is built once for all stations and steps and cached; each
    step is a filtered view of it. Returns predictions, metric tables, manifest
    and artifacts' folders.
    """
    settings, began = load_settings(config), time.perf_counter()
    seed = int(settings["training"].get("seed", 0)) if seed is None else seed
    contract = run_contract(settings, factor_ids)
    folder = Path(out or settings["output"]["checkpoint_dir"]) / run_id(contract)
    if folder.exists():
        raise DataError(f"{folder} exists already")
    frame = features.load(spark, data, settings, True, factor_ids).cache()
    rows = frame.groupBy(STEP).count().collect()
    built = time.perf_counter() - began
    trained = [r[0] for r in frame.where(splits.in_period(settings.period("train"))).select("station_id").distinct().orderBy("station_id").collect()]
    vector, names = features.vector(settings, factor_ids), features.feature_names(settings, factor_ids)
    predictions, per_step, seconds = None, {}, {}
    for step in settings.horizons:
        parts = splits.train_validation(_of_step(frame, step), settings)
        moment = time.perf_counter()
        prepared = preprocessing.prepare(*parts, vector, names, settings, base=len(features.base_names(settings)))
        seconds[step] = time.perf_counter() - moment
        fitted = model.fit(prepared.train, prepared.validation, settings, seed)
        where = str(folder / f"h{step:02d}")
        artifact = model.save(fitted, prepared.features, prepared.labels, where, contract, seed, step, trained)
        own = model.restore(fitted.predict(prepared.validation), prepared.labels)
        predictions = own if predictions is None else predictions.unionByName(own)
        best = min(fitted.history, key=lambda h: (h["rmse"], h["epoch"]))
        per_step[step] = {"prepared": prepared.manifest, "artifact": artifact, "best": best, "folder": where}
    predictions = predictions.cache()
    tables = metrics.evaluate(predictions, settings.score_capacity, settings.minutes)
    manifest = {
        "run_id": folder.name, "seed": seed, "contract": contract, "contract_sha256": fingerprints.json_hash(contract), "rows_by_step": {r[STEP]: r["count"] for r in rows}, "steps": per_step,
        "feature_build_seconds": built, "prepare_seconds_by_step": seconds, "environment": model.environment(spark), "trained_stations": trained,
    }
    predictions.orderBy("station_id", "timestamp", STEP).write.parquet(str(folder / "validation_predictions"))
    write_tables(tables, str(folder / "metrics"))
    write_json(folder / "resolved_config.json", settings.config)
    write_json(folder / "run_manifest.json", manifest)  # last: its absence marks an unfinished run
    frame.unpersist()
    return {"folder": str(folder), "predictions": predictions, "tables": tables, "manifest": manifest}


def read_run(folder: str) -> dict[str, Any]:
    path = Path(folder, "run_manifest.json")
    if not path.exists():
        raise DataError(f"{folder} isn't a finished run")
    return json.loads(path.read_text("utf-8"))


def _score(spark: SparkSession, folder: str, frame: DataFrame, settings: Settings, factor_ids: Sequence[str] | None, truth: bool) -> DataFrame:
    contract, out = run_contract(settings, factor_ids), None
    for step in settings.horizons:
        fitted, knots, labels, _ = model.load(f"{folder}/h{step:02d}", contract, step)
        ready = preprocessing.transform(_of_step(frame, step), features.vector(settings, factor_ids), knots)
        own = model.restore(fitted.predict(ready), labels, truth)
        out = own if out is None else out.unionByName(own)
    return out


def _run_factors(manifest: dict[str, Any], factor_ids: Sequence[str] | None) -> list[str]:
    return list(manifest["contract"]["factors"]["factor_ids"] if factor_ids is None else factor_ids)


def unseen_stations(frame: DataFrame, manifest: dict[str, Any]) -> list[str]:
    """Stations of a frame that the run wasn't trained on."""
    trained = frame.sparkSession.createDataFrame([(s,) for s in manifest["trained_stations"]], "station_id string")
    return sorted(r[0] for r in missing_keys(frame, trained, "station_id").collect())


def evaluate(spark: SparkSession, folder: str, config, data, role: str = "test", factor_ids: Sequence[str] | None = None) -> dict[str, Any]:
    """Score a run's models on the test or confirmation rows; split and evaluation settings must be those of the run."""
    settings, manifest = load_settings(config), read_run(folder)
    ids = _run_factors(manifest, factor_ids)
    mine = run_contract(settings, ids)
    changed = [k for k in ("split", "evaluation") if fingerprints.json_hash(mine[k]) != fingerprints.json_hash(manifest["contract"][k])]
    if changed:
        raise DataError(f"settings differ from the run's: {changed}")
    frame = splits.evaluation(features.load(spark, data, settings, True, ids), settings, role)
    predictions = _score(spark, folder, frame, settings, ids, True).cache()
    return {"predictions": predictions, "tables": metrics.evaluate(predictions, settings.score_capacity, settings.minutes), "unseen_stations": unseen_stations(frame, manifest)}


def predict(spark: SparkSession, folder: str, config, data, factor_ids: Sequence[str] | None = None) -> DataFrame:
    """Power vectors per origin; the data needs no target."""
    settings, manifest = load_settings(config), read_run(folder)
    ids = _run_factors(manifest, factor_ids)
    mine, theirs = run_contract(settings, ids)["features"], manifest["contract"]["features"]
    absent = [n for n in (*theirs["base_features"], *theirs["factor_features"]) if n not in (*mine["base_features"], *mine["factor_features"])]
    if absent:
        raise DataError(f"features of the run that these settings don't make: {absent[:5]}")
    frame = features.load(spark, data, settings, False, ids)
    if unseen := unseen_stations(frame, manifest):
        warnings.warn(f"stations that the run hasn't seen: {unseen[:5]}", stacklevel=2)
    return metrics.prediction_vectors(_score(spark, folder, frame, settings, ids, False)).orderBy("station_id", "timestamp")


def station_report(spark: SparkSession, config, data) -> dict[str, Any]:
    settings = load_settings(config)
    return stations.manifest(stations.scan(spark, data, settings, False))
