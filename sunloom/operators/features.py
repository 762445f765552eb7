"""The feature frame: one row per station, origin and requested horizon step.

Lags stay one array column (``lags``, oldest first); ``wide`` spreads them into
columns only where a model or an export needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators import checks
from sunloom.operators.factors import add_factors
from sunloom.operators.factors.base import STEP
from sunloom.operators.factors.registry import check_inputs, check_outputs, output_names
from sunloom.settings import Settings
from sunloom.sources import sites, stations

KEYS = ("row_id", "station_id", "source_file", "timestamp", "target_timestamp", STEP)


def with_occurrence(frame: DataFrame) -> DataFrame:
    """``occurrence``: number of the row among those of its file, station and origin, in file order."""
    same = Window.partitionBy("source_file", "station_id", "timestamp").orderBy("row_order")
    return frame.withColumn("occurrence", F.row_number().over(same) - 1)


def row_id(step: Column) -> Column:
    """``station__origin__n<occurrence>__h<step>``, the origin to the microsecond."""
    origin = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat("station_id", F.lit("__"), origin, F.lit("__n"), F.col("occurrence").cast("string"), F.lit("__h"), F.lpad(step.cast("string"), 2, F.lit("0")))


def lag_array(settings: Settings) -> Column:
    """The last history_length powers over the capacity, as floats."""
    n = settings.history_length
    return F.transform(F.slice(F.col(f"`{settings.columns['power_history']}`"), -n, n), lambda x: (x.cast("double") / F.col("capacity")).cast("float"))


def base_names(settings: Settings) -> list[str]:
    """The protected base features, in order."""
    lags = [f"power_lag_{k}" for k in range(settings.history_length, 0, -1)]
    return [f"{c}_target" for c in settings.weather] + lags + ["predict_hour", "predict_month"]


def feature_names(settings: Settings, factor_ids: Sequence[str] | None = ()) -> list[str]:
    return base_names(settings) + output_names(factor_ids, settings)


def build(frame: DataFrame, settings: Settings, require_target: bool = True, factor_ids: Sequence[str] | None = ()) -> DataFrame:
    """Feature rows of checked origin rows; rows with a value that isn't finite are dropped, factor values excepted."""
    check_inputs(frame, settings, factor_ids)
    frame = with_occurrence(frame).withColumn("lags", lag_array(settings))
    frame = add_factors(frame, settings, factor_ids)
    step, target = F.col(STEP), F.timestamp_add("MINUTE", F.col(STEP) * settings.minutes, F.col("timestamp"))
    frame = frame.withColumn("target_timestamp", target)
    columns = {f"{c}_target": F.element_at(F.col(f"`{c}`"), step).cast("float") for c in settings.weather}
    columns |= {"predict_hour": F.hour("target_timestamp"), "predict_month": F.month("target_timestamp"), "row_id": row_id(step)}
    if require_target:
        power = F.element_at(F.col(f"`{settings.columns['power_future']}`"), step).cast("float")
        columns |= {"target_power": power, "target_ratio": (power.cast("double") / F.col("capacity")).cast("float")}
    frame = frame.withColumns(columns)
    values = [f"{c}_target" for c in settings.weather] + (["target_power", "target_ratio"] if require_target else [])
    whole = F.forall("lags", finite)
    for v in values:
        whole = whole & finite(F.col(f"`{v}`"))
    site = [c for c in stations.SITE_COLUMNS if c in frame.columns]
    kept = [*KEYS, "occurrence", "capacity", *site, *values, "lags", "predict_hour", "predict_month", *output_names(factor_ids, settings)]
    return frame.where(whole).select(*[F.col(f"`{c}`") for c in kept])


def wide(frame: DataFrame, settings: Settings, factor_ids: Sequence[str] | None = ()) -> DataFrame:
    """Lags as the columns power_lag_N .. power_lag_1, features in the protected order."""
    n = settings.history_length
    lags = [F.element_at("lags", n - k + 1).alias(f"power_lag_{k}") for k in range(n, 0, -1)]
    names = feature_names(settings, factor_ids)
    spread = frame.select("*", *lags)
    rest = [c for c in frame.columns if c not in names and c != "lags"]
    return spread.select(*[F.col(f"`{c}`") for c in [*rest, *names]])


def vector(settings: Settings, factor_ids: Sequence[str] | None = ()) -> Column:
    """All features of a row as one array of doubles, in order, without 96 columns."""
    weather = F.array(*[F.col(f"`{c}_target`").cast("double") for c in settings.weather])
    calendar = F.array(F.col("predict_hour").cast("double"), F.col("predict_month").cast("double"))
    factors = [F.col(f"`{n}`").cast("double") for n in output_names(factor_ids, settings)]
    parts = [weather, F.transform("lags", lambda x: x.cast("double")), calendar]
    return F.concat(*parts, *([F.array(*factors)] if factors else []))


def load(spark: SparkSession, data, settings: Settings, require_target: bool = True, factor_ids: Sequence[str] | None = (), check_ids: bool = True) -> DataFrame:
    """From station files or a frame to the feature frame: scan, prune by role, attach sites, build, check row ids and that every factor value is finite."""
    origins = stations.prune_by_role(stations.scan(spark, data, settings, require_target, factor_ids), settings)
    origins = sites.attach(origins, sites.load_sites(spark, settings))
    frame = build(origins, settings, require_target, factor_ids)
    if check_ids:
        checks.require_unique(frame, ["row_id"], "row ids")
    check_outputs(frame, output_names(factor_ids, settings))
    return frame


def contract(settings: Settings, factor_ids: Sequence[str] | None = ()) -> dict:
    """What the feature frame promises."""
    return {
        "base_features": base_names(settings),
        "factor_features": output_names(factor_ids, settings),
        "target": "target_ratio",
        "history_length": settings.history_length,
        "minutes_per_point": settings.minutes,
        "horizons": settings.horizons,
        "station_id_is_feature": False,
    }
