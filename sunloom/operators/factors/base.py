"""What a factor is: outputs as columns, and the inputs they need."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom.functions.solar import Position
from sunloom.settings import Settings

STEP = "horizon_step"
CAPACITY, LONGITUDE, LATITUDE, SITE_ZONE = "site_capacity", "site_longitude", "site_latitude", "site_timezone"
IRRADIANCE_SCALE = 1000.0
EPSILON = 1e-6


@dataclass(frozen=True)
class Inputs:
    """Columns of a row, by what they mean."""

    settings: Settings
    #: Solar quantities at the target time; only there for factors that ask for them.
    sun: Position | None = None

    @property
    def origin(self) -> Column:
        return F.col("timestamp")

    @property
    def step(self) -> Column:
        return F.col(STEP)

    @property
    def power(self) -> Column:
        return F.col(f"`{self.settings.columns['power_history']}`")

    @property
    def irradiance(self) -> Column:
        return F.col(f"`{self.settings.columns['ghi_history']}`")

    @property
    def capacity(self) -> Column:
        return F.col(CAPACITY).cast("double")

    @property
    def latitude(self) -> Column:
        return F.col(LATITUDE).cast("double")

    @property
    def longitude(self) -> Column:
        return F.col(LONGITUDE).cast("double")

    def weather(self, role: str) -> Column:
        return F.col(f"`{self.settings.weather_of(role)}`")

    def weather_at_target(self, role: str) -> Column:
        return F.try_element_at(self.weather(role), self.step).cast("double")

    def parameter(self, name: str) -> float:
        return self.settings.factor_parameters[name]

    def minutes_before(self, steps: int) -> Column:
        return F.timestamp_add("MINUTE", F.lit(-steps * self.settings.minutes), self.origin)


Builder = Callable[[Inputs], Mapping[str, Column]]


def helper(name: str) -> Column:
    """A staged intermediate value of a factor, see ``Factor.helpers``."""
    return F.col(f"__f_{name}")


@dataclass(frozen=True)
class Factor:
    id: str
    build: Builder
    family: str
    summary: str
    #: The result doesn't depend on the horizon step, so it is computed before the rows fan out.
    per_origin: bool = False
    irradiance_history: bool = False
    site: bool = False
    sun: bool = False
    #: Intermediate values that several outputs use; they are staged as columns first, so that each is computed once.
    helpers: Builder | None = None
    #: Elements that the power history needs.
    history: int = 1
    mechanism: str = ""
