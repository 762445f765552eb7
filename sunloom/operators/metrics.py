"""Scores of predictions. Evaluation days are those of the target time.

A prediction frame has row_id, station_id, timestamp, target_timestamp,
horizon_step, groundtruth and prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators.checks import reject, require_rows
from sunloom.operators.factors.base import STEP

METRICS = ("rmse", "mae", "bias", "nrmse", "capacity_score")


def error(prediction: str = "prediction", truth: str = "groundtruth") -> Column:
    return F.col(prediction).cast("double") - F.col(truth).cast("double")


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def regression(capacity: float, prediction: str = "prediction", prefix: str = "") -> list[Column]:
    """Aggregates: rmse, mae, bias (prediction less truth), nrmse and capacity score."""
    e = error(prediction)
    values = (rmse(e), F.avg(F.abs(e)), F.avg(e), rmse(e) / capacity, 1.0 - rmse(e) / capacity)
    return [v.alias(prefix + n) for n, v in zip(METRICS, values, strict=True)]


#: Additive terms of the metrics over a group of predictions: count, and sums of error, its size and its square.
MOMENTS = ("n", "e", "a", "s")


def moments(predictions: DataFrame, keys: Sequence[str] = (STEP, "station_id"), sides: Sequence[str] = ("",)) -> DataFrame:
    """Additive terms by the keys and the target's day: every metric table is a roll-up of this small one.

    ``sides`` are the endings of the prediction columns.
    """
    terms = [F.count(F.lit(1)).alias("__n")]
    for side in sides:
        e = error(f"prediction{side}")
        terms += [F.sum(v).alias(f"__{m}{side}") for m, v in zip(MOMENTS[1:], (e, F.abs(e), e * e), strict=True)]
    if "prediction_ratio" in predictions.columns:
        e = error("prediction_ratio", "groundtruth_ratio")
        terms.append(F.sum(e * e).alias("__r"))
    return predictions.groupBy(*keys, F.to_date("target_timestamp").alias("date")).agg(*terms)


def _are_moments(frame: DataFrame) -> bool:
    return "__n" in frame.columns


def rolled(capacity: float, side: str = "", prefix: str = "") -> list[Column]:
    """``regression`` over rows of ``moments``."""
    n = F.sum("__n")
    root = F.sqrt(F.sum(f"__s{side}") / n)
    values = (root, F.sum(f"__a{side}") / n, F.sum(f"__e{side}") / n, root / capacity, 1.0 - root / capacity)
    return [v.alias(prefix + name) for name, v in zip(METRICS, values, strict=True)]


def _scores(frame: DataFrame, capacity: float) -> list[Column]:
    """Metrics and sample count of predictions, or of their moments."""
    if _are_moments(frame):
        return [*rolled(capacity), F.sum("__n").alias("sample_count")]
    return [*regression(capacity), F.count(F.lit(1)).alias("sample_count")]


def guard(predictions: DataFrame, columns: Sequence[str] = ("groundtruth", "prediction")) -> None:
    """Predictions to be scored are there and finite."""
    require_rows(predictions, "the prediction frame")
    reject(predictions, {f"{c} isn't finite": ~finite(F.col(c)) for c in columns})


def horizon_label(minutes: int = 15) -> Column:
    ahead = F.col(STEP) * minutes
    return F.when(ahead <= 60, "0_1h").when(ahead <= 120, "1_2h").otherwise("2_4h")


def by_horizon(predictions: DataFrame, capacity: float) -> DataFrame:
    """One row per step, with sample and station counts and, if ratios are there, their rmse."""
    more = [F.count_distinct("station_id").alias("station_count")]
    if "__r" in predictions.columns:
        more.append(F.sqrt(F.sum("__r") / F.sum("__n")).alias("ratio_rmse"))
    elif "prediction_ratio" in predictions.columns:
        more.append(rmse(error("prediction_ratio", "groundtruth_ratio")).alias("ratio_rmse"))
    return predictions.groupBy(STEP).agg(*_scores(predictions, capacity), *more)


def by_station(predictions: DataFrame, capacity: float) -> DataFrame:
    return predictions.groupBy(STEP, "station_id").agg(*_scores(predictions, capacity))


def station_macro(stations: DataFrame) -> DataFrame:
    """Over the stations of each step, each weighing the same."""
    return stations.groupBy(STEP).agg(
        F.count(F.lit(1)).alias("station_count"),
        F.avg("rmse").alias("mean_rmse"),
        F.avg("mae").alias("mean_mae"),
        F.avg(F.abs("bias")).alias("mean_absolute_bias"),
        F.avg("capacity_score").alias("mean_capacity_score"),
        F.max("rmse").alias("worst_rmse"),
        F.min("capacity_score").alias("worst_capacity_score"),
    )


def daily(predictions: DataFrame, capacity: float) -> DataFrame:
    """By step, station and target day."""
    day = F.col("date") if _are_moments(predictions) else F.to_date("target_timestamp").alias("date")
    return predictions.groupBy(STEP, "station_id", day).agg(*_scores(predictions, capacity))


def monthly(days: DataFrame, capacity: float) -> DataFrame:
    """Means over days by step, station and calendar month (years are pooled)."""
    mean = F.avg("rmse")
    return days.groupBy(STEP, "station_id", F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("day_count"), mean.alias("mean_daily_rmse"), F.avg("mae").alias("mean_daily_mae"), F.avg("bias").alias("mean_daily_bias"), (1.0 - mean / capacity).alias("monthly_capacity_score")
    )


def monthly_summary(months: DataFrame) -> DataFrame:
    return months.groupBy(STEP, "station_id").agg(
        F.count(F.lit(1)).alias("month_count"), F.avg("monthly_capacity_score").alias("mean_monthly_capacity_score"), F.min("monthly_capacity_score").alias("worst_monthly_capacity_score")
    )


def pooled_monthly(predictions: DataFrame, capacity: float, keys: Sequence[str] = (STEP,), prediction: str = "prediction", prefix: str = "") -> DataFrame:
    """The primary score: rmse of each target day over all stations, mean over a month's days, score, mean over months."""
    if _are_moments(predictions):
        days = predictions.groupBy(*keys, F.col("date").alias("__date")).agg(F.sqrt(F.sum("__s") / F.sum("__n")).alias("__rmse"))
    else:
        days = predictions.groupBy(*keys, F.to_date("target_timestamp").alias("__date")).agg(rmse(error(prediction)).alias("__rmse"))
    months = days.groupBy(*keys, F.month("__date").alias("__month")).agg((1.0 - F.avg("__rmse") / capacity).alias("__score"))
    scores = [F.avg("__score").alias(f"{prefix}mean_monthly_capacity_score"), F.min("__score").alias(f"{prefix}worst_monthly_capacity_score"), F.count(F.lit(1)).alias(f"{prefix}month_count")]
    return months.groupBy(*keys).agg(*scores)


def by_horizon_group(predictions: DataFrame, capacity: float, minutes: int = 15) -> DataFrame:
    return predictions.groupBy(horizon_label(minutes).alias("horizon_group")).agg(*_scores(predictions, capacity), F.count_distinct("station_id").alias("station_count"), F.min(STEP).alias("first_step"))


def with_primary_score(steps: DataFrame, pooled: DataFrame) -> DataFrame:
    return steps.join(pooled.select(STEP, "mean_monthly_capacity_score"), STEP, "left")


def seed_summary(frame: DataFrame, keys: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean and population deviation over seeds of every numeric column that isn't a key."""
    numbers = [n for n, t in frame.dtypes if n not in (*keys, seed) and t in ("double", "float", "int", "bigint")]
    stats = [f(n).alias(f"{n}_{what}") for n in numbers for what, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return frame.groupBy(*keys).agg(F.count_distinct(seed).alias("seed_count"), *stats)


def best_epoch(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The epoch of the least validation rmse, the earliest on a tie."""
    return history.groupBy(*keys).agg(F.min_by("epoch", F.struct("rmse", "epoch")).alias("best_epoch"), F.min("rmse").alias("best_rmse"))


def prediction_vectors(predictions: DataFrame, value: str = "prediction") -> DataFrame:
    """Per station, file, origin and occurrence: the predictions by step, and the steps they are for."""
    keys = [k for k in ("station_id", "source_file", "timestamp", "occurrence") if k in predictions.columns]
    listed = predictions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(STEP, value))).alias("v"))
    return listed.select(*keys, F.col(f"v.{STEP}").alias("horizon_steps"), F.col(f"v.{value}").alias("predictions"))


def evaluate(predictions: DataFrame, capacity: float, minutes: int = 15) -> dict[str, DataFrame]:
    """Every metric table of an evaluation, rolled up from one pass over the predictions."""
    guard(predictions)
    predictions = moments(predictions).cache()
    stations, days = by_station(predictions, capacity), daily(predictions, capacity)
    months, pooled = monthly(days, capacity), pooled_monthly(predictions, capacity)
    return {
        "horizon_metrics": with_primary_score(by_horizon(predictions, capacity), pooled).orderBy(STEP),
        "station_metrics": stations.orderBy(STEP, "station_id"),
        "station_macro": station_macro(stations).orderBy(STEP),
        "daily_metrics": days.orderBy(STEP, "station_id", "date"),
        "monthly_metrics": months.orderBy(STEP, "station_id", "month"),
        "monthly_summary": monthly_summary(months).orderBy(STEP, "station_id"),
        "pooled_monthly_scores": pooled.orderBy(STEP),
        "horizon_group_metrics": by_horizon_group(predictions, capacity, minutes).orderBy("first_step").drop("first_step"),
    }
