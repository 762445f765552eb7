"""Configuration of a forecasting project: nested mappings, checked as a whole."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from copy import deepcopy
from dataclasses import dataclass
from datetime import datetime
from math import isfinite
from pathlib import Path
from typing import Any

SECTIONS = ("data", "features", "model", "training", "split", "evaluation", "output")

#: What the protected score definition demands of a configuration.
PROTECTED = {
    ("model", "label_normalization"): "none",
    ("model", "label_scale_value"): 1.0,
    ("training", "sampling_strategy"): "pooled_rows",
    ("evaluation", "primary_metric"): "mean_monthly_capacity_score",
    ("evaluation", "early_stopping_prediction"): "unclipped_ratio",
}
PREDICTION_CLIP = (0.0, 1.2)
TIMEZONE = "Asia/Shanghai"
#: That time zone's constant offset.
UTC_OFFSET_HOURS = 8.0

FACTOR_PARAMETERS = {
    "faiman_u0": 25.0,
    "faiman_u1": 6.84,
    "temperature_coefficient_per_c": -0.004,
    "reference_temperature_c": 25.0,
    "clear_sky_index_min_ghi": 20.0,
    "clear_sky_index_clip_lower": 0.0,
    "clear_sky_index_clip_upper": 1.5,
}


class SettingsError(ValueError):
    """A configuration that breaks a rule."""


def default_config() -> dict[str, Any]:
    """A complete configuration; stations and periods are placeholders to be set.

    Fixed values: keys, default column names and default numbers are the public contract's.
    """
    return {
        "data": {
            "parquet_root": None,
            "parquet_glob": "station=*.parquet",
            "station_id_column": "station",
            "station_id_as_feature": False,
            "capacity_column": "cap_power_on",
            "default_capacity": None,
            "nwp_issue_time_column": None,
            "site_metadata": {
                "path": None,
                "station_column": "plantid",
                "capacity_column": "GCCAPACITY",
                "longitude_column": "LONGITUDE",
                "latitude_column": "LATITUDE",
                "timezone": TIMEZONE,
                "aliases": {},
                "overrides": {},
            },
            "columns": {
                "timestamp": "timestamp_win",
                "power_history": "Power",
                "ghi_history": "GHI_real",
                "power_future": "Power_predict",
                "future_weather": ["GHI_SOLARGIS_predict", "TEMP_SOLARGIS_predict", "WS_SOLARGIS_predict", "WD_SOLARGIS_predict"],
            },
            "weather_roles": {
                "ghi": "GHI_SOLARGIS_predict",
                "temperature": "TEMP_SOLARGIS_predict",
                "wind_speed": "WS_SOLARGIS_predict",
                "wind_direction": "WD_SOLARGIS_predict",
            },
        },
        "factor_parameters": dict(FACTOR_PARAMETERS),
        "features": {"history_length": 96, "n_horizons": 16, "minutes_per_point": 15, "prediction_mode": "endpoint", "endpoint_horizon_step": 16, "horizons": "all"},
        "model": {"label_normalization": "none", "label_scale_value": 1.0, "prediction_clip": list(PREDICTION_CLIP), "estimator": "linear"},
        "training": {
            "seed": 0, "sampling_strategy": "pooled_rows", "epochs": 200, "batch_size": 512, "inference_batch_size": 512,
            "early_stopping_patience": 10, "learning_rate": 0.002, "weight_decay": 0.0003, "gradient_clipping_norm": 1.0,
            "preprocessing": {"noise_std": 1e-5, "min_quantiles": 10, "max_quantiles": 1000, "samples_per_quantile": 30},
        },
        "split": {
            "train_start": "2024-01-01 00:00:00", "train_end": "2024-10-31 23:59:59", "validation_strategy": "explicit", "validation_last_days": None,
            "validation_start": "2024-11-01 00:00:00", "validation_end": "2024-11-30 23:59:59", "confirmation_start": None, "confirmation_end": None,
            "confirmation_stations": None, "test_start": "2025-01-01 00:00:00", "test_end": "2025-12-31 23:59:59",
            "train_stations": None, "validation_stations": None, "test_stations": None,
        },
        "evaluation": {"score_capacity": 465.0, "primary_metric": "mean_monthly_capacity_score", "early_stopping_prediction": "unclipped_ratio"},
        "output": {"checkpoint_dir": "./checkpoints"},
    }


def moment(value: Any) -> datetime:
    """A date or time from text or a datetime; a date alone is its midnight."""
    if isinstance(value, datetime):
        return value
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError as error:
        raise SettingsError(f"not a date or time: {value!r}") from error


def station_list(value: Any, where: str) -> list[str] | None:
    """None, or a list of distinct station names that aren't blank."""
    if value is None:
        return None
    if not isinstance(value, list | tuple):
        raise SettingsError(f"split.{where} has to be a list or null")
    names = [str(v).strip() for v in value]
    if not names or "" in names or len(set(names)) < len(names):
        raise SettingsError(f"split.{where} has to name distinct stations, at least one")
    return names


@dataclass(frozen=True)
class Settings:
    """A checked configuration with the derived values the operators ask for."""

    config: Mapping[str, Any]

    def __getitem__(self, section: str) -> Mapping[str, Any]:
        return self.config[section]

    @property
    def columns(self) -> Mapping[str, Any]:
        return self.config["data"]["columns"]

    @property
    def weather(self) -> list[str]:
        return list(self.columns["future_weather"])

    def weather_of(self, role: str) -> str:
        roles = self.config["data"].get("weather_roles", {})
        if role not in roles:
            raise SettingsError(f"no weather column has the role {role}")
        return roles[role]

    @property
    def history_length(self) -> int:
        return int(self.config["features"]["history_length"])

    @property
    def n_horizons(self) -> int:
        return int(self.config["features"]["n_horizons"])

    @property
    def minutes(self) -> int:
        return int(self.config["features"]["minutes_per_point"])

    @property
    def score_capacity(self) -> float:
        return float(self.config["evaluation"]["score_capacity"])

    @property
    def factor_parameters(self) -> dict[str, float]:
        return FACTOR_PARAMETERS | {k: float(v) for k, v in (self.config.get("factor_parameters") or {}).items()}

    @property
    def horizons(self) -> list[int]:
        """Endpoint: one step. Curve: all steps, or those listed."""
        features = self.config["features"]
        if features.get("prediction_mode", "endpoint") == "endpoint":
            return [int(features.get("endpoint_horizon_step", 16))]
        listed = features.get("horizons", "all")
        return list(range(1, self.n_horizons + 1)) if listed == "all" else sorted({int(h) for h in listed})

    def stations(self, role: str) -> list[str] | None:
        """Stations of the role train, validation, test or confirmation; None is all of them."""
        split = self.config["split"]
        train = station_list(split.get("train_stations"), "train_stations")
        if role == "train":
            return train
        own = station_list(split.get(f"{role}_stations"), f"{role}_stations")
        if role == "validation":
            return train if own is None or split.get("validation_strategy", "explicit") == "monthly_tail" else own
        if role == "confirmation" and own is None:
            return self.stations("test")
        return own

    def role_union(self) -> list[str] | None:
        """All stations with any role, if every role names its stations; confirmation stations count."""
        roles = [self.stations(r) for r in ("train", "validation", "test", "confirmation")]
        return None if any(r is None for r in roles) else sorted({s for r in roles for s in r or []})

    def period(self, role: str) -> tuple[datetime, datetime] | None:
        split = self.config["split"]
        start, end = split.get(f"{role}_start"), split.get(f"{role}_end")
        return None if not start or not end else (moment(start), moment(end))


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SettingsError(message)


def _check_data(s: Settings) -> None:
    data = s["data"]
    for name in ("parquet_glob", "station_id_column"):
        _require(bool(str(data.get(name) or "").strip()), f"data.{name} is blank")
    _require(not data.get("station_id_as_feature", False), "a station's id is never a feature")
    site = data.get("site_metadata") or {}
    _require(site.get("timezone", TIMEZONE) == TIMEZONE, f"the time zone has to be {TIMEZONE}")
    stray = {r: c for r, c in (data.get("weather_roles") or {}).items() if c not in s.weather}
    _require(not stray, f"weather roles name columns that are not read: {stray}")


def _check_features(s: Settings) -> None:
    _require(s["features"].get("prediction_mode", "endpoint") in ("endpoint", "curve"), "features.prediction_mode is endpoint or curve")
    steps = s.horizons
    _require(bool(steps) and 1 <= steps[0] and steps[-1] <= s.n_horizons, f"horizon steps outside 1..{s.n_horizons}: {steps}")


def _check_protected(s: Settings) -> None:
    for (section, name), wanted in PROTECTED.items():
        found = s[section].get(name, wanted if name in ("label_scale_value", "sampling_strategy") else None)
        _require(found == wanted, f"{section}.{name} is fixed to {wanted!r}")
    _require(tuple(map(float, s["model"]["prediction_clip"])) == PREDICTION_CLIP, f"model.prediction_clip is fixed to {list(PREDICTION_CLIP)}")
    for name in ("epochs", "batch_size", "inference_batch_size", "early_stopping_patience"):
        _require(int(s["training"][name]) > 0, f"training.{name} has to be positive")
    _require(s.score_capacity > 0, "evaluation.score_capacity has to be positive")


def _check_parameters(s: Settings) -> None:
    """Rules of the factors' numbers: all finite, denominators positive, clipping bounds in order."""
    unknown = sorted(set(s.config.get("factor_parameters") or {}) - set(FACTOR_PARAMETERS))
    _require(not unknown, f"unknown factor parameters: {unknown}")
    values = s.factor_parameters
    wrong = sorted(k for k, v in values.items() if not isfinite(v))
    _require(not wrong, f"factor parameters that aren't finite: {wrong}")
    for name in ("clear_sky_index_min_ghi", "faiman_u0"):
        _require(values[name] > 0, f"factor_parameters.{name} has to be positive")
    _require(values["faiman_u1"] >= 0, "factor_parameters.faiman_u1 is negative")
    _require(values["clear_sky_index_clip_lower"] < values["clear_sky_index_clip_upper"], "the bounds of the clear-sky index have to increase")


def _check_split(s: Settings) -> None:
    split = s["split"]
    strategy = split.get("validation_strategy", "explicit")
    _require(strategy in ("explicit", "monthly_tail"), "split.validation_strategy is explicit or monthly_tail")
    for role in ("train", "test", *(["validation"] if strategy == "explicit" else [])):
        _require(s.period(role) is not None, f"split needs {role}_start and {role}_end")
    both = [bool(split.get(f"confirmation_{x}")) for x in ("start", "end")]
    _require(both[0] == both[1], "split.confirmation_start and confirmation_end come together")
    for role in ("train", "test", "validation", "confirmation"):
        period = s.period(role)
        _require(period is None or period[0] <= period[1], f"the {role} period ends before it starts")
    if strategy == "explicit":
        _require(split.get("validation_last_days") is None, "validation_last_days is for monthly_tail only")
    else:
        _require(int(split.get("validation_last_days") or 0) > 0, "monthly_tail needs a positive validation_last_days")
        _require(not split.get("validation_start") and not split.get("validation_end"), "monthly_tail takes no validation period")
        _require(split.get("validation_stations") is None, "monthly_tail validates on the training stations")
    for role in ("train", "validation", "test", "confirmation"):
        s.stations(role)


CHECKS: tuple[Callable[[Settings], None], ...] = (_check_data, _check_features, _check_parameters, _check_protected, _check_split)


def load_settings(source: Mapping[str, Any] | str | Path | Settings) -> Settings:
    """Checked settings from a mapping or a YAML file."""
    if isinstance(source, Settings):
        return source
    if isinstance(source, Mapping):
        config = deepcopy(dict(source))
    else:
        import yaml

        config = yaml.safe_load(Path(source).expanduser().read_text("utf-8")) or {}
    absent = sorted(set(SECTIONS) - set(config))
    _require(not absent, f"the configuration lacks {absent}")
    settings = Settings(config)
    for check in CHECKS:
        check(settings)
    return settings
