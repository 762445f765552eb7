"""Which factors there are, and how a selection becomes columns."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Sequence
from functools import cache
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.functions.arrays import finite
from sunloom.operators.factors import physics, series
from sunloom.operators.factors.base import LATITUDE, LONGITUDE, SITE_ZONE, STEP, Factor, Inputs
from sunloom.settings import TIMEZONE, Settings

REGISTRY: dict[str, Factor] = {f.id: f for f in (*series.FACTORS, *physics.FACTORS)}
CATALOG_PATH = Path(__file__).with_name("catalog.json")


class FactorError(ValueError):
    """A selection that can't be made, or a value that isn't finite."""


@cache
def catalog() -> dict[str, dict[str, Any]]:
    """The factor records: one for each executable factor, and those known without an implementation."""
    return {r["factor_id"]: r for r in json.loads(CATALOG_PATH.read_text("utf-8"))["factors"]}


def executable_ids() -> list[str]:
    return sorted(REGISTRY)


def resolve(ids: Sequence[str] | None) -> list[Factor]:
    """Factors in the order asked for; duplicates, unknown ids and ids without an implementation are errors."""
    wanted = list(ids or [])
    repeated = sorted({i for i in wanted if wanted.count(i) > 1})
    if repeated:
        raise FactorError(f"factors named twice: {repeated}")
    unknown = sorted(i for i in wanted if i not in catalog() and i not in REGISTRY)
    if unknown:
        raise FactorError(f"unknown factors: {unknown}")
    idle = {i: catalog()[i]["status"] for i in wanted if i not in REGISTRY}
    if idle:
        raise FactorError(f"known but not executable with the current data: {idle}")
    return [REGISTRY[i] for i in wanted]


def needs_irradiance_history(ids: Sequence[str] | None) -> bool:
    """Whether the scan has to read the irradiance history; None stands for the full contract."""
    return ids is None or any(f.irradiance_history for f in resolve(ids))


def column_name(factor_id: str, output: str) -> str:
    return f"{factor_id.replace('.', '__')}__{output}"


def _outputs(factor: Factor, inputs: Inputs) -> dict[str, Column]:
    built = factor.build(inputs)
    return {column_name(factor.id, k): built[k].cast("double") for k in sorted(built)}


def output_names(ids: Sequence[str] | None, settings: Settings) -> list[str]:
    """Factor columns in the frame's order: factors as asked for, outputs by name."""
    sun = solar.Position("__sun_")
    names = [n for f in resolve(ids) for n in _outputs(f, Inputs(settings, sun))]
    if len(names) != len(set(names)):
        raise FactorError("two factors make the same column")
    return names


def selection_manifest(ids: Sequence[str] | None) -> dict[str, Any]:
    """What identifies a selection: records and code of its factors."""
    records = [
        {
            "factor_id": f.id,
            "catalog_record_sha256": _sha(catalog().get(f.id, {})),
            "implementation": f"{f.build.__module__}:{f.build.__name__}",
            "implementation_sha256": hashlib.sha256(inspect.getsource(f.build).encode()).hexdigest(),
        }
        for f in resolve(ids)
    ]
    manifest = {"factor_ids": [r["factor_id"] for r in records], "records": records}
    return manifest | {"selection_sha256": _sha(manifest)}


def _sha(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _guards(factor: Factor, inputs: Inputs) -> Column | None:
    """Why a row can't have the factor, or null."""
    size = F.coalesce(F.size(inputs.power), F.lit(0))
    checks = [(size < factor.history, f"the power history has fewer than {factor.history} values")]
    if factor.site:
        checks.append((~(finite(inputs.capacity) & (F.coalesce(inputs.capacity, F.lit(0.0)) > 0)), "the site capacity isn't positive"))
    if factor.sun or factor.id in ("factor.solar.power-clear-sky-index", "factor.regime.clear-variable-overcast"):
        checks.append((~(finite(inputs.latitude) & finite(inputs.longitude)), "the site has no position"))
        checks.append((~F.coalesce(F.col(SITE_ZONE) == TIMEZONE, F.lit(False)), f"the site's time zone isn't {TIMEZONE}"))
    if factor.irradiance_history:
        checks.append((F.coalesce(F.size(inputs.irradiance), F.lit(0)) < F.lit(max(2, min(factor.history, 16))), "the irradiance history is too short"))
    out = None
    for bad, why in checks:
        message = F.lit(f"{factor.id}: {why}")
        out = F.when(bad, message) if out is None else out.when(bad, message)
    return out


def stage_helpers(frame: DataFrame, factors: Sequence[Factor], inputs: Inputs) -> DataFrame:
    staged = {f"__f_{n}": c for f in factors if f.helpers for n, c in f.helpers(inputs).items()}
    return frame.withColumns(staged) if staged else frame


def add_factors(frame: DataFrame, settings: Settings, ids: Sequence[str] | None, fan_out: bool = True) -> DataFrame:
    """``frame`` with the columns of the selected factors; rows and order stay.

    With ``fan_out`` the frame has one row per origin, and the result one per
    origin and requested horizon step; factors that don't depend on the step are
    computed before the rows multiply. Without, the frame already has
    ``horizon_step``.
    """
    factors = resolve(ids)
    names = output_names(ids, settings)
    clash = sorted(set(names) & set(frame.columns))
    if clash:
        raise FactorError(f"columns exist already: {clash}")
    inputs = Inputs(settings)
    kept = list(frame.columns)
    frame = stage_helpers(frame, [f for f in factors if f.per_origin], inputs)
    early = {n: c for f in factors if f.per_origin for n, c in _outputs(f, inputs).items()}
    if early:
        frame = frame.withColumns(early)
    if fan_out:
        frame = frame.withColumn(STEP, F.explode(F.array(*[F.lit(h) for h in settings.horizons])))
        kept.append(STEP)
    if any(f.sun for f in factors):
        target = F.timestamp_add("MINUTE", F.col(STEP) * settings.minutes, F.col("timestamp"))
        frame, sun = solar.stage(frame, target, F.col(LATITUDE).cast("double"), F.col(LONGITUDE).cast("double"), "__sun_")
        inputs = Inputs(settings, sun)
    frame = stage_helpers(frame, [f for f in factors if not f.per_origin], inputs)
    late = {n: c for f in factors if not f.per_origin for n, c in _outputs(f, inputs).items()}
    if late:
        frame = frame.withColumns(late)
    return frame.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{n}`") for n in names])


def check_inputs(frame: DataFrame, settings: Settings, ids: Sequence[str] | None) -> None:
    """One pass over the frame that raises on the first row a selected factor can't serve."""
    found = [g for f in resolve(ids) if (g := _guards(f, Inputs(settings))) is not None]
    if not found:
        return
    problem = F.coalesce(*found)
    row = frame.select("station_id", "timestamp", problem.alias("problem")).where("problem is not null").orderBy("timestamp", "station_id").limit(1).collect()
    if row:
        raise FactorError(f"{row[0]['problem']} (station {row[0]['station_id']}, origin {row[0]['timestamp']})")


def finite_shares(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, n_bad, finite_share) of every column, in one pass."""
    terms = [F.struct(F.lit(n).alias("name"), F.count_if(~finite(F.col(f"`{n}`"))).alias("n_bad"), F.avg(finite(F.col(f"`{n}`")).cast("double")).alias("finite_share")) for n in names]
    return frame.agg(F.array(*terms).alias("all")).select(F.inline("all"))


def check_outputs(frame: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The finite share of every factor column; raises on a value that isn't finite, naming column, station and origin."""
    if not names:
        return {}
    shares = {r["name"]: r for r in finite_shares(frame, names).collect()}
    bad = [n for n in names if shares[n]["n_bad"]]
    if bad:
        row = frame.where(~finite(F.col(f"`{bad[0]}`"))).orderBy("timestamp", "station_id", STEP).select("station_id", "timestamp", STEP).first()
        raise FactorError(f"{bad[0]} isn't finite in {shares[bad[0]]['n_bad']} rows, first at station {row[0]}, origin {row[1]}, step {row[2]}")
    return {n: 1.0 if shares[n]["finite_share"] is None else shares[n]["finite_share"] for n in names}
