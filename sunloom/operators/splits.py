"""Splits by forecast origin and station role."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.operators.checks import DataError, overlap, require_rows
from sunloom.settings import Settings


def in_period(period: tuple[datetime, datetime] | None, column: str = "timestamp") -> Column:
    """Start and end included; no period holds nothing."""
    if period is None:
        return F.lit(False)
    start, end = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in period)
    return F.col(column).between(start, end)


def of_stations(names: list[str] | None) -> Column:
    return F.lit(True) if names is None else F.col("station_id").isin(names)


def month_tail(days: int, column: str = "timestamp") -> Column:
    """The last ``days`` days of a month."""
    return F.dayofmonth(F.last_day(column)) - F.dayofmonth(column) < days


def train_validation(frame: DataFrame, settings: Settings, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; each has some, and they share none."""
    pool = frame.where(in_period(settings.period("train")) & of_stations(settings.stations("train")))
    if settings["split"].get("validation_strategy", "explicit") == "monthly_tail":
        tail = month_tail(int(settings["split"]["validation_last_days"]))
        train, validation = pool.where(~tail), pool.where(tail)
    else:
        train = pool
        validation = frame.where(in_period(settings.period("validation")) & of_stations(settings.stations("validation")))
    if check:
        require_rows(train, "the training split")
        require_rows(validation, "the validation split")
        if n := overlap(train, validation, "row_id"):
            raise DataError(f"training and validation share {n} rows")
    return train, validation


def evaluation(frame: DataFrame, settings: Settings, role: str = "test", check: bool = True) -> DataFrame:
    """Rows of the role test or confirmation."""
    out = frame.where(in_period(settings.period(role)) & of_stations(settings.stations(role)))
    if check:
        require_rows(out, f"the {role} split")
    return out


def contract(settings: Settings) -> dict:
    def text(role: str) -> list[str] | None:
        period = settings.period(role)
        return None if period is None else [t.isoformat(" ") for t in period]

    return {
        "split_by": "forecast_origin",
        "validation_strategy": settings["split"].get("validation_strategy", "explicit"),
        "validation_last_days": settings["split"].get("validation_last_days"),
        **{f"{r}_period": text(r) for r in ("train", "validation", "test", "confirmation")},
        **{f"{r}_stations": settings.stations(r) for r in ("train", "validation", "test", "confirmation")},
    }
