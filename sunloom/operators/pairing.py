"""Baseline against candidate: pairing, deltas over several groupings, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators import metrics
from sunloom.operators.checks import DataError, reject, require_unique
from sunloom.operators.factors.base import STEP

KEYS = ("row_id", "station_id", "source_file", "timestamp", "target_timestamp", STEP)
SIDES = ("baseline", "candidate")
#: The groupings of a comparison; the empty one is overall.
GROUPINGS: tuple[tuple[str, ...], ...] = ((), (STEP,), ("station_id",), ("month",), ("seed",))


def outer(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join on the keys, with both sides' values and ``indicator`` (both, left_only, right_only)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("groundtruth").alias(f"groundtruth_{name}"), F.col("prediction").alias(f"prediction_{name}"), F.lit(1).alias(f"__{name}"))

    joined = side(baseline, SIDES[0]).join(side(candidate, SIDES[1]), list(keys), "full_outer")
    where = F.when(F.col("__candidate").isNull(), "left_only").when(F.col("__baseline").isNull(), "right_only").otherwise("both")
    return joined.withColumn("indicator", where).drop("__baseline", "__candidate")


def indicator_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))


def pair(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = KEYS, seed: int | None = None) -> DataFrame:
    """Predictions matched one to one, with equal and finite truth; anything else is an error."""
    for df, name in ((baseline, SIDES[0]), (candidate, SIDES[1])):
        require_unique(df, keys, f"keys of the {name} predictions")
    joined = outer(baseline, candidate, keys)
    reject(
        joined,
        {
            "predictions without a partner": F.col("indicator") != "both",
            "the sides' truths differ": ~F.col("groundtruth_baseline").eqNullSafe(F.col("groundtruth_candidate")),
            "a value isn't finite": ~(finite(F.col("groundtruth_baseline")) & finite(F.col("prediction_baseline")) & finite(F.col("prediction_candidate"))),
        },
        [k for k in ("row_id", "station_id") if k in keys],
    )
    paired = joined.drop("indicator", "groundtruth_candidate").withColumnRenamed("groundtruth_baseline", "groundtruth")
    return paired.withColumn("month", F.month("target_timestamp")).withColumn("seed", F.lit(seed).cast("int"))


def compare(paired: DataFrame, capacity: float, groupings: Sequence[Sequence[str]] = GROUPINGS) -> DataFrame:
    """baseline_*, candidate_* and delta_* of every metric, for all groupings, from one pass over the rows.

    Rows are first summed by all keys and the target's day. GROUPING SETS multiply
    that small table instead of the rows, and as its sums are additive, plain
    metrics and the monthly score come out of one chain of roll-ups without a
    join. Null keys stay groups, told from totals by ``grouping`` (the joined
    names of the grouping's keys).
    """
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    sides = [f"_{s}" for s in SIDES]
    terms = ["__n", *[f"__{m}{s}" for s in sides for m in metrics.MOMENTS[1:]]]
    base = metrics.moments(paired.drop("prediction_ratio"), keys, sides)
    inside = [F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]
    name = (F.concat_ws(",", *inside) if inside else F.lit("")).alias("grouping")
    sets = [[F.col(k) for k in [*g, "date"]] for g in groupings]
    days = base.groupingSets(sets, *keys, "date").agg(name, *[F.sum(t).alias(t) for t in terms])
    by = ["grouping", *keys]
    scores = [(1.0 - F.avg(F.sqrt(F.col(f"__s{s}") / F.col("__n"))) / capacity).alias(f"__score{s}") for s in sides]
    months = days.groupBy(*by, F.month("date").alias("__month")).agg(*scores, *[F.sum(t).alias(t) for t in terms])
    plain = [m for s, side in zip(SIDES, sides, strict=True) for m in metrics.rolled(capacity, side, f"{s}_")]
    whole = months.groupBy(*by).agg(F.sum("__n").alias("sample_count"), *plain, *[F.avg(f"__score_{s}").alias(f"{s}_mean_monthly_capacity_score") for s in SIDES])
    names = [*metrics.METRICS, "mean_monthly_capacity_score"]
    return whole.select(
        "grouping", *keys, "sample_count", *[f"{s}_{n}" for s in SIDES for n in names], *[(F.col(f"candidate_{n}") - F.col(f"baseline_{n}")).alias(f"delta_{n}") for n in names]
    )


def rmse_by_seed_and_step(paired: DataFrame) -> DataFrame:
    """Both sides' rmse, and their difference, of every seed and step."""
    sides = [metrics.rmse(metrics.error(f"prediction_{s}")).alias(f"{s}_rmse") for s in SIDES]
    return paired.groupBy("seed", STEP).agg(F.count(F.lit(1)).alias("sample_count"), *sides).withColumn("delta_rmse", F.col("candidate_rmse") - F.col("baseline_rmse"))


def station_macro_delta(stations: DataFrame) -> DataFrame:
    """Over the stations' rows of ``compare``: mean rmses, mean delta, improved share, worst delta."""
    return stations.agg(
        F.count(F.lit(1)).alias("station_count"), F.avg("baseline_rmse").alias("baseline_mean_rmse"), F.avg("candidate_rmse").alias("candidate_mean_rmse"),
        F.avg("delta_rmse").alias("mean_delta_rmse"), F.avg((F.col("delta_rmse") < 0).cast("double")).alias("improved_station_ratio"), F.max("delta_rmse").alias("worst_delta_rmse"),
    )


def issued_late(frame: DataFrame, column: str, origin: str = "timestamp") -> DataFrame:
    """Rows whose weather was issued after their origin."""
    return frame.where(F.col(f"`{column}`") > F.col(f"`{origin}`"))


def issue_time_audit(frame: DataFrame, column: str | None, origin: str = "timestamp") -> dict:
    """Whether no weather was issued after its origin. Rows without an issue time can't be verified and are counted."""
    if column is None or column not in frame.columns:
        return {"status": "contract_assumed", "violations": 0, "unverifiable_rows": None}
    late = F.col(f"`{column}`") > F.col(origin)
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.count_if(F.col(f"`{column}`").isNull()).alias("unknown"), F.min(F.when(late, F.col(origin))).alias("first")).first()
    if row["late"]:
        raise DataError(f"{row['late']} rows use weather issued after their origin, first at {row['first']}")
    return {"status": "verified" if not row["unknown"] else "partly_verified", "rows": row["n"], "violations": 0, "unverifiable_rows": row["unknown"]}


def runs_match(baseline: dict, candidate: dict, names: Sequence[str]) -> list[str]:
    """Names under which the two runs' manifests differ."""
    return [n for n in names if baseline.get(n) != candidate.get(n)]
