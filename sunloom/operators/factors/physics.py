"""Factors of solar geometry, module physics, weather regime and operation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom.functions import arrays as A
from sunloom.functions import solar
from sunloom.operators.factors.base import EPSILON, IRRADIANCE_SCALE, Factor, Inputs, helper

#: Thresholds and window lengths.
CLEAR_MINIMUM = 20.0
RATIO_CLIP = 2.0
LOW_IRRADIANCE, LOW_SUN_DEGREES = 200.0, 10.0
NEAR_CAPACITY, HIGH_IRRADIANCE, PLATEAU = 0.98, 800.0, 0.02
EXPECTED_CLIP = 1.2
CLEAR_LAGS = (1, 4, 16, 96)
REGIME_STEPS, OPERATION_STEPS, RESIDUAL_STEPS = 16, 8, 16


def flag(condition: Column) -> Column:
    return condition.cast("double")


def position(row: Inputs) -> Mapping[str, Column]:
    names = {"elevation_degrees": "solar_elevation_degrees", "zenith_degrees": "solar_zenith_degrees", "azimuth_degrees": "solar_azimuth_degrees", "cos_zenith": "solar_cos_zenith", "equation_of_time_minutes": "equation_of_time_minutes", "declination_radians": "solar_declination_radians"}
    return {out: getattr(row.sun, q) for q, out in names.items()}


def daylight(row: Inputs) -> Mapping[str, Column]:
    sun = row.sun
    length = solar.daylight_minutes(row.latitude, sun.declination_radians)
    noon = 720.0 - row.longitude * 4.0 - sun.equation_of_time_minutes + 60.0 * solar.UTC_OFFSET_HOURS
    sunrise, sunset = noon - length / 2.0, noon + length / 2.0
    progress = F.when(length <= 0, F.lit(0.0)).otherwise(A.clip((sun.minutes - sunrise) / F.greatest(length, F.lit(EPSILON)), 0.0, 1.0))
    return {
        "minutes_since_sunrise": sun.minutes - sunrise,
        "minutes_until_sunset": sunset - sun.minutes,
        "daylight_duration_minutes": length,
        "daylight_progress": progress,
        "is_daylight": flag(sun.elevation_degrees > 0),
    }


def clear_sky(row: Inputs) -> Mapping[str, Column]:
    return {"clear_sky_ghi": row.sun.clear_sky, "clear_sky_ghi_normalized": row.sun.clear_sky / IRRADIANCE_SCALE}


def clear_sky_index(row: Inputs) -> Mapping[str, Column]:
    least, low, high = (row.parameter(f"clear_sky_index_{n}") for n in ("min_ghi", "clip_lower", "clip_upper"))
    clear, forecast = row.sun.clear_sky, row.weather_at_target("ghi")
    valid, raw = clear >= least, forecast / F.greatest(clear, F.lit(EPSILON))
    return {
        "forecast_clear_sky_index": F.when(valid, A.clip(raw, low, high)).otherwise(F.lit(0.0)),
        "forecast_clear_sky_index_valid": flag(valid),
        "forecast_ghi_minus_clear_sky": forecast - clear,
        "forecast_clear_sky_index_clipped": flag(valid & ((raw < low) | (raw > high))),
    }


def lagged_clear_sky(row: Inputs) -> Mapping[str, Column]:
    return {"lagged_clear": solar.clear_sky_series(F.array(*[row.minutes_before(k) for k in CLEAR_LAGS]), row.latitude, row.longitude)}


def power_clear_sky_index(row: Inputs) -> Mapping[str, Column]:
    out = {}
    for i, k in enumerate(CLEAR_LAGS):
        at = F.element_at(helper("lagged_clear"), i + 1)
        index = (A.lag(row.power, k) / row.capacity) / (F.greatest(at, F.lit(EPSILON)) / IRRADIANCE_SCALE)
        out[f"power_clear_sky_index_lag_{k}"] = F.when(at < CLEAR_MINIMUM, F.lit(0.0)).otherwise(A.clip(index, 0.0, RATIO_CLIP))
    return out


def module_heat(row: Inputs) -> Column:
    wind = F.greatest(F.lit(EPSILON), F.lit(row.parameter("faiman_u0")) + F.lit(row.parameter("faiman_u1")) * F.greatest(row.weather_at_target("wind_speed"), F.lit(0.0)))
    return F.greatest(row.weather_at_target("ghi"), F.lit(0.0)) / wind


def module_temperature(row: Inputs) -> Mapping[str, Column]:
    heat = module_heat(row)
    return {"module_temperature_proxy": row.weather_at_target("temperature") + heat, "module_air_temperature_delta": heat}


def corrected_irradiance(row: Inputs) -> Mapping[str, Column]:
    module = row.weather_at_target("temperature") + module_heat(row)
    derating = 1.0 + F.lit(row.parameter("temperature_coefficient_per_c")) * (module - row.parameter("reference_temperature_c"))
    return {"temperature_corrected_irradiance": F.greatest(row.weather_at_target("ghi") * derating, F.lit(0.0)), "temperature_derating_multiplier": derating}


def low_irradiance(row: Inputs) -> Mapping[str, Column]:
    clear, ghi, up = row.sun.clear_sky, row.weather_at_target("ghi"), row.sun.elevation_degrees
    ratio = F.when(clear < CLEAR_MINIMUM, F.lit(0.0)).otherwise(A.clip(ghi / F.greatest(clear, F.lit(EPSILON)), 0.0, RATIO_CLIP))
    return {
        "irradiance_clear_sky_ratio": ratio,
        "low_irradiance_flag": flag((ghi > 0) & (ghi < LOW_IRRADIANCE)),
        "low_sun_flag": flag((up > 0) & (up < LOW_SUN_DEGREES)),
    }


def recent_clear_sky(row: Inputs) -> Mapping[str, Column]:
    times = F.array(*[row.minutes_before(k) for k in range(REGIME_STEPS, 0, -1)])
    clear = solar.clear_sky_series(times, row.latitude, row.longitude)

    def ratio(g: Column, c: Column) -> Column:
        return F.when(c < CLEAR_MINIMUM, F.lit(0.0)).otherwise(A.clip(g / F.greatest(c, F.lit(EPSILON)), 0.0, RATIO_CLIP))

    def stats(x: Column) -> Column:
        return F.struct(A.mean(x).alias("mean"), A.deviation(x).alias("std"), A.mean_step(x).alias("step"))

    return {"regime": A.let(F.zip_with(A.tail(row.irradiance, REGIME_STEPS), clear, ratio), stats)}


def regime(row: Inputs) -> Mapping[str, Column]:
    mean, std, step = (helper("regime")[n] for n in ("mean", "std", "step"))
    return {
        "recent_clear_sky_ratio_mean": mean,
        "recent_clear_sky_ratio_std": std,
        "recent_clear_sky_ratio_absdiff": step,
        "clear_regime_score": A.clip(mean, 0.0, 1.0) * F.greatest(F.lit(1.0) - std, F.lit(0.0)),
        "variable_regime_score": A.clip(std + step, 0.0, 1.0),
        "overcast_regime_score": A.clip(F.lit(1.0) - mean, 0.0, 1.0),
    }


def joint_ramp(row: Inputs) -> Mapping[str, Column]:
    return {
        "recent_power_ramp_capacity_ratio": (A.lag(row.power, 1) - A.lag(row.power, 2)) / row.capacity,
        "recent_ghi_ramp_normalized": (A.lag(row.irradiance, 1) - A.lag(row.irradiance, 2)) / IRRADIANCE_SCALE,
        "future_ghi_change_from_observation": (row.weather_at_target("ghi") - A.lag(row.irradiance, 1)) / IRRADIANCE_SCALE,
    }


def operating_window(row: Inputs) -> Mapping[str, Column]:
    ratios = F.transform(A.tail(row.power, OPERATION_STEPS), lambda x: x / row.capacity)

    def stats(x: Column) -> Column:
        near = F.size(F.filter(x, lambda v: v >= NEAR_CAPACITY)) / F.lit(float(OPERATION_STEPS))
        return F.struct(near.alias("near"), F.greatest(F.lit(1.0) - A.deviation(x) / PLATEAU, F.lit(0.0)).alias("plateau"))

    return {"operating": A.let(ratios, stats)}


def clipping(row: Inputs) -> Mapping[str, Column]:
    near, plateau = helper("operating")["near"], helper("operating")["plateau"]
    high = F.size(F.filter(A.tail(row.irradiance, OPERATION_STEPS), lambda x: x >= HIGH_IRRADIANCE)) / F.lit(float(OPERATION_STEPS))
    return {"near_capacity_fraction": near, "high_ghi_fraction": high, "power_plateau_score": plateau, "clipping_score": near * high * plateau}


def residual_gaps(row: Inputs) -> Mapping[str, Column]:
    return {"gaps": F.zip_with(A.tail(row.power, RESIDUAL_STEPS), A.tail(row.irradiance, RESIDUAL_STEPS), lambda p, g: p / row.capacity - A.clip(g / IRRADIANCE_SCALE, 0.0, EXPECTED_CLIP))}


def residual(row: Inputs) -> Mapping[str, Column]:
    gaps = helper("gaps")
    return {"weather_power_residual_latest": F.try_element_at(gaps, F.lit(-1)), "weather_power_residual_mean_16": A.mean(gaps), "weather_power_residual_std_16": A.deviation(gaps)}


FACTORS = (
    Factor("factor.solar.position", position, "solar", "Solar position at the target time", site=True, sun=True, mechanism="solar-geometry"),
    Factor("factor.solar.daylight-boundary", daylight, "solar", "Distance to sunrise and sunset", site=True, sun=True, mechanism="solar-geometry"),
    Factor("factor.solar.clear-sky-irradiance", clear_sky, "solar", "Clear-sky irradiance at the target time", site=True, sun=True, mechanism="clear-sky"),
    Factor("factor.weather.clear-sky-index-forecast", clear_sky_index, "weather", "Forecast irradiance by clear sky", site=True, sun=True, mechanism="clear-sky"),
    Factor("factor.solar.power-clear-sky-index", power_clear_sky_index, "solar", "Lagged power by clear sky", helpers=lagged_clear_sky, per_origin=True, site=True, history=96, mechanism="clear-sky"),
    Factor("factor.pv.module-temperature-proxy", module_temperature, "pv", "Faiman module temperature", mechanism="module-temperature"),
    Factor("factor.pv.temperature-corrected-irradiance", corrected_irradiance, "pv", "Irradiance with temperature derating", mechanism="module-temperature"),
    Factor("factor.pv.low-irradiance-state", low_irradiance, "pv", "Low irradiance and low sun", site=True, sun=True, mechanism="low-light"),
    Factor("factor.regime.clear-variable-overcast", regime, "regime", "Recent irradiance by clear sky", helpers=recent_clear_sky, per_origin=True, irradiance_history=True, site=True, mechanism="cloud-variability"),
    Factor("factor.regime.joint-weather-power-ramp", joint_ramp, "regime", "Ramps of power and irradiance", irradiance_history=True, site=True, history=2, mechanism="ramping"),
    Factor("factor.operation.clipping-score", clipping, "operation", "Inverter clipping", helpers=operating_window, per_origin=True, irradiance_history=True, site=True, history=8, mechanism="inverter-clipping"),
    Factor("factor.operation.weather-power-residual", residual, "operation", "Power against irradiance", helpers=residual_gaps, per_origin=True, irradiance_history=True, site=True, history=16, mechanism="operation-state"),
)
