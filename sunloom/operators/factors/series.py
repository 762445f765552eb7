"""Factors of the power history and of the weather series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom.functions import arrays as A
from sunloom.operators.factors.base import Factor, Inputs, helper

#: Windows and lags, in steps.
LAGS = (1, 2, 4, 8, 16, 96)
RAMPS = (1, 2, 4, 8, 16)
WINDOWS = (2, 4, 8, 16)
ACCELERATIONS = (1, 2, 4)


def lags(row: Inputs) -> Mapping[str, Column]:
    return {f"power_lag_{k}": F.coalesce(A.or_nan(A.lag(row.power, k)), F.lit(A.NAN)) for k in LAGS}


def ramps(row: Inputs) -> Mapping[str, Column]:
    return {f"power_ramp_{w}": A.lag(row.power, 1) - A.lag(row.power, 1 + w) for w in RAMPS}


def slopes(row: Inputs) -> Mapping[str, Column]:
    return {f"power_slope_{w}": F.when(F.size(row.power) >= w, A.slope(A.tail(row.power, w), w)) for w in WINDOWS}


def trailing_windows(row: Inputs) -> Mapping[str, Column]:
    return {f"last_{w}": F.when(F.size(row.power) >= w, A.tail(row.power, w)) for w in WINDOWS}


def variability(row: Inputs) -> Mapping[str, Column]:
    out = {}
    for w in WINDOWS:
        last = helper(f"last_{w}")
        for name, value in (("std", A.deviation(last)), ("absdiff", A.mean_step(last)), ("range", A.spread(last))):
            out[f"power_{name}_{w}"] = F.when(last.isNotNull(), value)
    return out


def acceleration(row: Inputs) -> Mapping[str, Column]:
    p = row.power
    return {f"power_acceleration_{s}": A.lag(p, 1) - A.lag(p, 1 + s) * 2.0 + A.lag(p, 1 + 2 * s) for s in ACCELERATIONS}


def stuck(row: Inputs) -> Mapping[str, Column]:
    whole = A.doubles(row.power)
    return {
        "stuck_longest_fraction": F.when(F.size(row.power) > 0, A.longest_run(whole) / F.size(row.power)),
        "mean_absolute_step": F.when(F.size(row.power) > 0, A.mean_step(whole)),
    }


def coverage(row: Inputs) -> Mapping[str, Column]:
    wanted, out, counts = row.settings.n_horizons, {}, []
    for name in row.settings.weather:
        values = F.coalesce(F.col(f"`{name}`"), F.array().cast("array<float>"))
        count = F.size(F.filter(F.slice(values, 1, wanted), A.finite))
        counts.append(count)
        out[f"{name}_coverage"] = count / F.lit(float(wanted))
        out[f"{name}_length_ratio"] = F.least(F.size(values), F.lit(wanted)) / F.lit(float(wanted))
    out["future_weather_joint_coverage"] = sum(counts[1:], counts[0]) / F.lit(float(wanted * len(counts)))
    return out


def capacity_ratios(row: Inputs) -> Mapping[str, Column]:
    return {f"power_capacity_ratio_lag_{k}": A.lag(row.power, k) / row.capacity for k in (1, 4, 16, 96)}


def previous_day(row: Inputs) -> Mapping[str, Column]:
    day = round(1440 / row.settings.minutes)
    ok = (row.step < day) & (F.size(row.power) >= day)
    return {"previous_day_same_target_power": F.when(ok, F.try_element_at(row.power, F.when(ok, row.step - day).otherwise(F.lit(1))).cast("double"))}


def weather_prefixes(row: Inputs) -> Mapping[str, Column]:
    return {f"prefix_{role}": A.doubles(F.slice(row.weather(role), F.lit(1), row.step)) for role in ("ghi", "temperature", "wind_speed")}


def weather_change(row: Inputs) -> Mapping[str, Column]:
    """Each weather series only up to the target step."""
    out = {}
    for role in ("ghi", "temperature", "wind_speed"):
        prefix = helper(f"prefix_{role}")
        first, last = F.try_element_at(prefix, F.lit(1)), F.try_element_at(prefix, row.step)
        anchor = A.lag(row.irradiance, 1) if role == "ghi" else first
        before = F.when(row.step == 1, anchor).otherwise(F.try_element_at(prefix, F.greatest(row.step - 1, F.lit(1))))
        out |= {
            f"{role}_target_change_from_anchor": last - anchor,
            f"{role}_target_step_change": last - before,
            f"{role}_prefix_slope": F.when(row.step == 1, F.lit(0.0)).otherwise((last - first) / F.greatest(row.step - 1, F.lit(1))),
            f"{role}_prefix_mean": A.mean(prefix),
            f"{role}_prefix_std": A.deviation(prefix),
            f"{role}_prefix_range": A.spread(prefix),
        }
    return out


FACTORS = (
    Factor("factor.power.multiscale-lags", lags, "power", "Power at fixed lags", per_origin=True, history=1, mechanism="persistence"),
    Factor("factor.power.multiscale-ramp", ramps, "power", "Differences to the last power", per_origin=True, history=17, mechanism="ramping"),
    Factor("factor.power.multiscale-slope", slopes, "power", "Least-squares slopes of trailing windows", per_origin=True, history=16, mechanism="ramping"),
    Factor("factor.power.variability", variability, "power", "Deviation, mean step and range of trailing windows", per_origin=True, helpers=trailing_windows, history=16, mechanism="cloud-variability"),
    Factor("factor.power.acceleration", acceleration, "power", "Second differences", per_origin=True, history=9, mechanism="ramping"),
    Factor("factor.quality.stuck-shift-score", stuck, "quality", "Longest constant run and mean step", per_origin=True, mechanism="telemetry-fault"),
    Factor("factor.quality.future-weather-coverage", coverage, "quality", "Finite share of the issued weather", per_origin=True, mechanism="forecast-availability"),
    Factor("factor.power.capacity-ratio", capacity_ratios, "power", "Lagged power by capacity", per_origin=True, site=True, history=96, mechanism="persistence"),
    Factor("factor.power.previous-day-profile", previous_day, "power", "Power a day before the target", history=96, mechanism="diurnal-cycle"),
    Factor("factor.weather.future-change", weather_change, "weather", "Change of issued weather up to the target", irradiance_history=True, helpers=weather_prefixes, mechanism="ramping"),
)
