"""Paired factor experiments: requests, guarded runs, results, and the ledger."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from importlib import import_module
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.operators import features, fingerprints, metrics, pairing, preprocessing
from sunloom.operators.checks import DataError
from sunloom.operators.factors import resolve, selection_manifest
from sunloom.operators.factors.base import LATITUDE, LONGITUDE
from sunloom.operators.factors.registry import CATALOG_PATH, check_outputs, output_names
from sunloom.plans import forecast
from sunloom.plans.forecast import write_json
from sunloom.settings import Settings, load_settings
from sunloom.sources import sites, stations

STAGES = {"smoke": "validation", "exploration": "validation", "confirmation": "confirmation", "final_test": "test"}
LEAKAGE_CHECKS = ("train_only_fit", "origin_time_split", "station_roles", "issue_time", "history_before_origin", "prefix_only_weather", "row_identity", "protected_files")
SLICES = ("overall", "by_station", "station_macro", "worst_station", "by_horizon", "horizon_groups", "by_month", "by_seed", "low_sun", "daylight", "stable", "ramp", "factor_coverage")
#: Sun elevations below which a target counts as low, and changes of the recent power above which an origin counts as ramping.
LOW_SUN_DEGREES, RAMP_SHARE = 10.0, 0.1
#: When a factor's data are there, and words of inputs that are out of scope.
AVAILABILITY = ("history", "future_known_at_origin", "not_available")
VISUAL = ("image", "camera", "satellite", "pixel")
RESULT_KEYS = ("experiment_id", "schema_version", "request_sha256", "protected_unchanged", "rows_identical", "leakage", "metrics")
VERSION = 1


def create_request(stage: str, factor_ids: Sequence[str], seeds: Sequence[int], settings, protected: dict[str, Any], phrase: str = "", now: datetime | None = None) -> dict[str, Any]:
    """A request; the sealed test needs its exact phrase."""
    if stage not in STAGES:
        raise DataError(f"unknown stage: {stage}")
    if stage == "final_test" and phrase != forecast.FINAL_TEST_PHRASE:
        raise DataError("the final test needs its exact phrase")
    resolve(factor_ids)
    if not factor_ids or not seeds or len(set(seeds)) < len(seeds):
        raise DataError("an experiment needs factors and distinct seeds")
    settings = load_settings(settings)
    body = {
        "schema_version": VERSION, "stage": stage, "factors": selection_manifest(factor_ids), "seeds": list(seeds), "horizons": settings.horizons,
        "prediction_mode": settings["features"].get("prediction_mode", "endpoint"), "minutes_per_point": settings.minutes,
        "leakage_checks": list(LEAKAGE_CHECKS), "slices": list(SLICES), "protected": protected,
    }
    moment = now or datetime.now(timezone.utc)
    return body | {"experiment_id": f"{moment:%Y%m%dT%H%M%SZ}-{fingerprints.json_hash(body)[:8]}"}


def match_request(request: dict[str, Any], settings, factor_ids: Sequence[str]) -> None:
    """The runtime has the request's steps, mode, resolution and factors."""
    settings = load_settings(settings)
    mine = {"horizons": settings.horizons, "prediction_mode": settings["features"].get("prediction_mode", "endpoint"), "minutes_per_point": settings.minutes, "factors": selection_manifest(factor_ids)}
    wrong = pairing.runs_match(request, mine, list(mine))
    if wrong:
        raise DataError(f"the runtime differs from the request: {wrong}")


def stage_predictions(spark: SparkSession, run: dict[str, Any], stage: str, settings, data) -> DataFrame:
    role = STAGES[stage]
    return run["predictions"] if role == "validation" else forecast.evaluate(spark, run["folder"], settings, data, role)["predictions"]


#: What both runs of a pair have in common.
RUN_EQUAL = ("seed", "rows_by_step", "trained_stations", "environment")


#: What a step's splits have in common: labels, and the hashes of rows, base features, targets and capacities.
SPLIT_EQUAL = ("label", *(f"{what}_{k}" for what in ("train", "validation") for k in ("rows", "features", *preprocessing.SPLIT_COLUMNS)))


def audit_pair(baseline: dict[str, Any], candidate: dict[str, Any]) -> list[str]:
    """Differences between two runs that should only differ in their factors."""
    found = pairing.runs_match(baseline, candidate, RUN_EQUAL)
    found += [f"contract.{n}" for n in pairing.runs_match(baseline["contract"], candidate["contract"], ("split", "evaluation"))]
    b, c = baseline["contract"]["features"], candidate["contract"]["features"]
    found += [f"features.{n}" for n in pairing.runs_match(b, c, ("base_features", "target", "history_length", "minutes_per_point", "horizons", "station_id_is_feature"))]
    for step, own in baseline["steps"].items():
        other = candidate["steps"].get(step, {"prepared": {}, "artifact": {}})
        found += [f"step {step}: {n}" for n in pairing.runs_match(own["prepared"], other["prepared"], SPLIT_EQUAL)]
        found += [f"step {step}: {n}" for n in pairing.runs_match(own["artifact"], other["artifact"], ("estimator", "seeds"))]
    return found


def by_horizon_group(paired: DataFrame, settings: Settings) -> list[dict[str, Any]]:
    grouped = paired.withColumn("horizon_group", metrics.horizon_label(settings.minutes))
    return [r.asDict() for r in pairing.compare(grouped, settings.score_capacity, [("horizon_group",)]).collect()]


def by_state(paired: DataFrame, origins: DataFrame, settings: Settings) -> dict[str, Any]:
    """Comparisons of targets at a low and a high sun, and of origins with a steady and a ramping power.

    The sun needs the site's position; without one its two slices are unavailable.
    """
    power = F.col(f"`{settings.columns['power_history']}`")
    change = F.abs(F.try_element_at(power, F.lit(-1)).cast("double") - F.try_element_at(power, F.lit(-5)).cast("double")) / F.col("capacity")
    site = [c for c in (LONGITUDE, LATITUDE) if c in origins.columns]
    states = origins.select("station_id", "source_file", "timestamp", (change > RAMP_SHARE).alias("ramping"), *site).dropDuplicates(["station_id", "source_file", "timestamp"])
    rows = paired.join(states, ["station_id", "source_file", "timestamp"], "left")

    def slices(frame: DataFrame, key: str, names: dict[bool, str]) -> dict[str, Any]:
        found = {r[key]: r.asDict() for r in pairing.compare(frame, settings.score_capacity, [(key,)]).collect()}
        return {name: found.get(value, {"sample_count": 0}) for value, name in names.items()}

    out = slices(rows, "ramping", {True: "ramp", False: "stable"})
    if len(site) < 2:
        return out | {"low_sun": {"available": False}, "daylight": {"available": False}}
    rows, sun = solar.stage(rows, F.col("target_timestamp"), F.col(LATITUDE).cast("double"), F.col(LONGITUDE).cast("double"), "__sun_")
    lit = rows.withColumn("low", sun.elevation_degrees < LOW_SUN_DEGREES)
    return out | slices(lit, "low", {True: "low_sun", False: "daylight"})


def run(spark: SparkSession, request: dict[str, Any], settings, data, out: str, snapshot=None) -> dict[str, Any]:
    """Train baseline and candidate for each seed, pair their predictions, and write the result."""
    settings = load_settings(settings)
    ids = request["factors"]["factor_ids"]
    match_request(request, settings, ids)
    before = snapshot() if snapshot else request["protected"]
    if before != request["protected"]:
        raise DataError("protected files changed since the request")
    origins = sites.attach(stations.scan(spark, data, settings, True, ids), sites.load_sites(spark, settings))
    leakage = pairing.issue_time_audit(origins, settings["data"].get("nwp_issue_time_column"))
    paired, audits, rows = None, {}, {}
    coverage = check_outputs(features.load(spark, data, settings, True, ids), output_names(ids, settings))
    for seed in request["seeds"]:
        runs = [forecast.train(spark, settings, data, seed, f, f"{out}/seed{seed}/{side}") for side, f in (("baseline", ()), ("candidate", ids))]
        audits[seed] = audit_pair(*[r["manifest"] for r in runs])
        if audits[seed]:
            raise DataError(f"the pair of seed {seed} differs in {audits[seed]}")
        sides = [stage_predictions(spark, r, request["stage"], settings, data) for r in runs]
        own = pairing.pair(*sides, seed=seed)
        rows[seed] = {k: str(v) for k, v in fingerprints.set_fingerprint(own, "row_id").first().asDict().items()}
        paired = own if paired is None else paired.unionByName(own)
    groups = pairing.compare(paired, settings.score_capacity).cache()
    tables = {g: [r.asDict() for r in groups.where(F.col("grouping") == g).collect()] for g in ("", "horizon_step", "station_id", "month", "seed")}
    macro = pairing.station_macro_delta(groups.where("grouping = 'station_id'")).first().asDict()
    unchanged = (snapshot() if snapshot else request["protected"]) == request["protected"]
    result = {
        "experiment_id": request["experiment_id"], "schema_version": VERSION, "request_sha256": fingerprints.json_hash(request), "stage": request["stage"], "protected_unchanged": unchanged,
        "rows_identical": len({fingerprints.json_hash(r) for r in rows.values()}) == 1, "rows_sha256": fingerprints.json_hash(rows), "leakage": {"status": "passed", "issue_time": leakage, "pair_audits": audits},
        "metrics": {"overall": tables[""], "by_horizon": tables["horizon_step"], "by_station": tables["station_id"], "by_month": tables["month"], "by_seed": tables["seed"], "station_macro": macro,
                    "worst_station": max(tables["station_id"], key=lambda r: (r["delta_rmse"], r["station_id"])), "horizon_groups": by_horizon_group(paired, settings), **by_state(paired, origins, settings),
                    "factor_coverage": coverage},
    }
    write_json(Path(out, "result.json"), result)
    return result


def mock_result(request: dict[str, Any]) -> dict[str, Any]:
    """A made-up result to exercise the workflow; never evidence."""
    metric = {"baseline_rmse": 0.125, "candidate_rmse": 0.125, "delta_rmse": 0.0}
    return {
        "experiment_id": request["experiment_id"], "schema_version": VERSION, "request_sha256": fingerprints.json_hash(request), "stage": request["stage"], "synthetic": True,
        "protected_unchanged": True, "rows_identical": True, "leakage": {"status": "passed"}, "metrics": {"overall": [metric]},
    }


def record(spark: SparkSession, ledger: str, request: dict[str, Any], result: dict[str, Any]) -> None:
    """Append a result to the ledger if it passes every gate and its id is new. Nothing is promoted."""
    absent = [k for k in RESULT_KEYS if k not in result]
    if absent:
        raise DataError(f"the result lacks {absent}")
    gates = {
        "another version": result["schema_version"] != VERSION,
        "another experiment": result["experiment_id"] != request["experiment_id"],
        "another request": result["request_sha256"] != fingerprints.json_hash(request),
        "protected files changed": result["protected_unchanged"] is not True,
        "the sides' rows differ": result["rows_identical"] is not True,
        "leakage checks didn't pass": result["leakage"].get("status") != "passed",
    }
    if broken := [k for k, bad in gates.items() if bad]:
        raise DataError(f"the result is refused: {broken}")
    path = Path(ledger)
    if path.exists() and path.stat().st_size and not spark.read.json(str(path)).where(F.col("experiment_id") == result["experiment_id"]).isEmpty():
        raise DataError(f"{result['experiment_id']} is in the ledger already")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(fingerprints.canonical_json(result | {"recorded_at": f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}", "result_sha256": fingerprints.json_hash(result)}) + "\n")


def catalog_tables(spark: SparkSession, path: str | Path = CATALOG_PATH) -> dict[str, DataFrame]:
    body = json.loads(Path(path).read_text("utf-8"))
    schema = {
        "factors": "factor_id string, name string, family string, mechanism_ids array<string>, status string, data_availability string, implementation string",
        "mechanisms": "mechanism_id string, name string, source_ids array<string>",
        "sources": "source_id string, title string",
    }
    return {k: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in s.split(", ")) for r in body[k]], s) for k, s in schema.items()}


def _callable(name: str) -> bool:
    """Whether ``module:function`` can be imported and called."""
    module, _, function = name.partition(":")
    try:
        return callable(getattr(import_module(module), function, None))
    except ImportError:
        return False


def catalog_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, detail) of repeated ids, dangling references, values out of range, blanks, and implementations that don't exist or can't be called."""
    f, m, s = tables["factors"], tables["mechanisms"], tables["sources"]

    def said(df: DataFrame, kind: str, key: str, detail: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(detail).cast("string").alias("detail"))

    found = None
    for df, key in ((f, "factor_id"), (m, "mechanism_id"), (s, "source_id")):
        again = said(df.groupBy(key).count().where("count > 1"), "repeated", key, "count")
        found = again if found is None else found.unionByName(again)
    uses = f.select("factor_id", F.explode("mechanism_ids").alias("mechanism_id")).join(m, "mechanism_id", "left_anti")
    cites = m.select("mechanism_id", F.explode("source_ids").alias("source_id")).join(s, "source_id", "left_anti")
    states = f.where(~F.col("status").isin("implemented", "hypothesis", "retired"))
    hollow = f.where((F.col("status") == "implemented") & F.col("implementation").isNull())
    away = f.where(~F.col("data_availability").isin(*AVAILABILITY) | F.col("data_availability").isNull())
    blank = f.where(F.coalesce(F.trim("name"), F.lit("")) == "").unionByName(f.where(F.coalesce(F.trim("family"), F.lit("")) == "")).distinct()
    ideas = f.where(F.size("mechanism_ids") < 1)
    pictured = f.where(F.lower(F.concat_ws(" ", "name", "family")).rlike("|".join(VISUAL)))
    named = {r[0] for r in f.select("implementation").where("implementation is not null").distinct().collect()}
    spark = f.sparkSession
    absent = f.join(F.broadcast(spark.createDataFrame([(n,) for n in sorted(named) if not _callable(n)], "implementation string")), "implementation", "left_semi")
    for df, kind, detail in ((away, "unknown availability", "data_availability"), (blank, "no name or family", "name"), (ideas, "no mechanism", "name"), (pictured, "an input from images", "name"), (absent, "implementation isn't callable", "implementation")):
        found = found.unionByName(said(df, kind, "factor_id", detail))
    for part in (said(uses, "no such mechanism", "factor_id", "mechanism_id"), said(cites, "no such source", "mechanism_id", "source_id"), said(states, "unknown status", "factor_id", "status"), said(hollow, "no implementation", "factor_id", "implementation")):
        found = found.unionByName(part)
    return found
