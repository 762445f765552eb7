"""Apparent solar position and clear-sky irradiance for local civil time.

``Position`` holds one column per quantity. ``stage`` adds them to a DataFrame
in steps, so that Catalyst computes each trigonometric term once.
``clear_sky_series`` does the same for an array of times inside array
expressions, which needs neither an explode nor a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.settings import UTC_OFFSET_HOURS

#: Fourier coefficients (1, cos g, sin g, cos 2g, sin 2g, cos 3g, sin 3g) of the NOAA solar equations.
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
EQUATION_SCALE = 229.18
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
#: Haurwitz clear-sky model.
HAURWITZ_SCALE, HAURWITZ_FADE = 1098.0, -0.059

QUANTITIES = ("elevation_degrees", "zenith_degrees", "azimuth_degrees", "cos_zenith", "equation_of_time_minutes", "declination_radians")


def series(gamma: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        wave = (F.cos if i % 2 == 0 else F.sin)(F.lit(float(i // 2 + 1)) * gamma)
        out = out + F.lit(c) * wave
    return out


def day_minutes(ts: Column) -> Column:
    return F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0


def year_angle(ts: Column) -> Column:
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    return F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1 + (hours - 12.0) / 24.0)


def hour_angle(minutes: Column, equation: Column, longitude: Column, offset: float) -> Column:
    true_minutes = F.pmod(minutes + equation + F.lit(4.0) * longitude - F.lit(60.0 * offset), F.lit(1440.0))
    return F.radians(true_minutes / 4.0 - 180.0)


def zenith_cosine(latitude: Column, declination: Column, hour: Column) -> Column:
    raw = F.sin(F.radians(latitude)) * F.sin(declination) + F.cos(F.radians(latitude)) * F.cos(declination) * F.cos(hour)
    return F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))


def haurwitz(cosine: Column) -> Column:
    return F.when(cosine > 0, F.lit(HAURWITZ_SCALE) * cosine * F.exp(F.lit(HAURWITZ_FADE) / cosine)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Position:
    """Names of the staged columns of one time."""

    prefix: str

    def __getattr__(self, quantity: str) -> Column:
        return F.col(f"{self.prefix}{quantity}")


def stage(df: DataFrame, ts: Column, latitude: Column, longitude: Column, prefix: str, offset: float = UTC_OFFSET_HOURS) -> tuple[DataFrame, Position]:
    """``df`` with the solar quantities of ``ts`` in columns that start with ``prefix``."""
    p = Position(prefix)

    def add(**columns: Column) -> None:
        nonlocal df
        df = df.withColumns({f"{prefix}{k}": v for k, v in columns.items()})

    add(minutes=day_minutes(ts), angle=year_angle(ts))
    add(equation_of_time_minutes=F.lit(EQUATION_SCALE) * series(p.angle, EQUATION_OF_TIME), declination_radians=series(p.angle, DECLINATION))
    add(hour=hour_angle(p.minutes, p.equation_of_time_minutes, longitude, offset))
    add(cosine=zenith_cosine(latitude, p.declination_radians, p.hour))
    across = F.cos(p.hour) * F.sin(F.radians(latitude)) - F.tan(p.declination_radians) * F.cos(F.radians(latitude))
    add(
        zenith_degrees=F.degrees(F.acos(p.cosine)),
        azimuth_degrees=F.pmod(F.degrees(F.atan2(F.sin(p.hour), across)) + 180.0, F.lit(360.0)),
        cos_zenith=F.greatest(p.cosine, F.lit(0.0)),
        clear_sky=haurwitz(p.cosine),
    )
    add(elevation_degrees=F.lit(90.0) - p.zenith_degrees)
    return df, p


def daylight_minutes(latitude: Column, declination: Column) -> Column:
    cosine = -F.tan(F.radians(latitude)) * F.tan(declination)
    inside = F.lit(8.0) * F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    return F.when(cosine >= 1, F.lit(0.0)).when(cosine <= -1, F.lit(1440.0)).otherwise(inside)


def clear_sky_series(times: Column, latitude: Column, longitude: Column, offset: float = UTC_OFFSET_HOURS) -> Column:
    """Clear-sky irradiance at each time of an array, each term computed once per time."""

    def then(a: Column, **fields: Callable[[Column], Column]) -> Column:
        return F.transform(a, lambda x: F.struct(*[f(x).alias(k) for k, f in fields.items()]))

    a = then(times, m=day_minutes, g=year_angle)
    a = then(a, m=lambda x: x["m"], e=lambda x: F.lit(EQUATION_SCALE) * series(x["g"], EQUATION_OF_TIME), d=lambda x: series(x["g"], DECLINATION))
    a = then(a, h=lambda x: hour_angle(x["m"], x["e"], longitude, offset), d=lambda x: x["d"])
    a = F.transform(a, lambda x: zenith_cosine(latitude, x["d"], x["h"]))
    return F.transform(a, haurwitz)
