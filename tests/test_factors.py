import math

import pytest
from pyspark.sql import functions as F

from sunloom.functions import arrays as A
from sunloom.functions import solar
from sunloom.operators.factors import FactorError, add_factors, column_name, executable_ids, resolve, selection_manifest
from sunloom.operators.factors.registry import catalog, check_inputs, output_names
from sunloom.plans import experiment
from sunloom.sources import stations
from tests.stationdata import frame, row, settings


def values(spark, ids, *rows, step=16, s=None):
    s = s or settings(endpoint_horizon_step=step)
    origins = stations.with_capacity(stations.annotate(frame(spark, *rows), s), s)
    out = add_factors(origins, s, ids).collect()
    return [{n.rpartition("__")[2]: r[n] for n in output_names(ids, s)} for r in out]


def test_array_functions(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 2.0], [5.0])], "a array<double>, b array<double>, c array<double>")
    got = df.select(
        A.lag(F.col("a"), 1).alias("lag"), A.lag(F.col("a"), 9).alias("none"), A.slope(A.tail(F.col("a"), 4), 4).alias("slope"), A.deviation(F.col("a")).alias("std"),
        A.mean_step(F.col("a")).alias("step"), A.spread(F.col("a")).alias("spread"), A.longest_run(F.col("b")).alias("run"), A.longest_run(F.col("c")).alias("one"), A.mean_step(F.col("c")).alias("alone"),
    ).first()
    assert (got.lag, got.none, got.slope, got.step, got.spread, got.run, got.one, got.alone) == (4.0, None, 1.0, 1.0, 4.0, 3, 1, 0.0)
    assert got["std"] == pytest.approx(math.sqrt(2))


def test_series_factors(spark):
    v = values(spark, ["factor.power.multiscale-lags", "factor.power.multiscale-ramp", "factor.power.multiscale-slope", "factor.power.variability", "factor.power.acceleration"])[0]
    assert [v[f"power_lag_{k}"] for k in (1, 2, 96)] == [95.0, 94.0, 0.0]
    assert v["power_ramp_4"] == 4.0 and v["power_slope_8"] == 1.0 and v["power_absdiff_16"] == 1.0 and v["power_range_16"] == 15.0 and v["power_acceleration_1"] == 0.0
    assert v["power_std_2"] == 0.5


def test_short_history_gives_nan_lag(spark):
    s = settings()
    df = frame(spark, row(power=[1.0, 2.0]))
    from sunloom.operators.factors.base import Inputs
    from sunloom.operators.factors.series import lags

    got = df.select(*[c.alias(k) for k, c in lags(Inputs(s)).items()]).first()
    assert got.power_lag_1 == 2.0 and math.isnan(got.power_lag_4)


def test_quality_factors(spark):
    v = values(spark, ["factor.quality.stuck-shift-score"], row(power=[1.0] * 72 + [2.0] * 24))[0]
    assert v["stuck_longest_fraction"] == 0.75
    v = values(spark, ["factor.quality.future-weather-coverage"], row(future=[1.0, float("nan")] + [3.0] * 14))[0]
    assert v["GHI_SOLARGIS_predict_coverage"] == 15 / 16 and v["future_weather_joint_coverage"] == 15 / 16 and v["WD_SOLARGIS_predict_length_ratio"] == 1.0


def test_capacity_and_previous_day(spark):
    v = values(spark, ["factor.power.capacity-ratio", "factor.power.previous-day-profile"])[0]
    assert v["power_capacity_ratio_lag_1"] == 95 / 500 and v["power_capacity_ratio_lag_4"] == 92 / 500
    assert v["previous_day_same_target_power"] == 16.0


def test_future_change_reads_only_the_prefix(spark):
    one, two = row(), row(future=[0.0, 1.0, 2.0, 3.0] + [999.0] * 12)
    a, b = values(spark, ["factor.weather.future-change"], one, two, step=4)
    assert a == b
    assert a["ghi_target_change_from_anchor"] == 203 - 950 and a["ghi_target_step_change"] == 1.0 and a["temperature_prefix_slope"] == 1.0


def test_sun(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-06-21 12:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-06-21 00:00:00'")
    staged, p = solar.stage(df, F.col("t"), F.lit(31.2), F.lit(121.5), "x_")
    rows = staged.select("t", p.elevation_degrees, p.clear_sky, F.element_at(solar.clear_sky_series(F.array("t"), F.lit(31.2), F.lit(121.5)), 1).alias("again")).orderBy("t").collect()
    assert rows[0][2] == 0 and rows[1][1] > 60 and rows[1][2] > 700
    assert all(r[2] == pytest.approx(r.again) for r in rows)


def test_ramps_and_residual(spark):
    power = [0.0] * 94 + [10.0, 20.0]
    v = values(spark, ["factor.regime.joint-weather-power-ramp", "factor.operation.weather-power-residual", "factor.operation.clipping-score"], row(power=power, irradiance=[0.0] * 94 + [100.0, 200.0]))[0]
    assert v["recent_power_ramp_capacity_ratio"] == 0.02 and v["recent_ghi_ramp_normalized"] == pytest.approx(0.1) and v["future_ghi_change_from_observation"] == pytest.approx(0.015)
    assert v["weather_power_residual_latest"] == pytest.approx(20 / 500 - 0.2)


def test_all_factors_are_finite_and_append_only(spark):
    s = settings()
    assert len(executable_ids()) == 22
    assert len(output_names(executable_ids(), s)) == 108
    v = values(spark, executable_ids())[0]
    assert all(math.isfinite(x) for x in v.values())
    assert column_name("factor.solar.clear-sky-irradiance", "x") == "factor__solar__clear-sky-irradiance__x"


def test_selection_errors():
    for ids, what in ((["factor.solar.position"] * 2, "twice"), (["factor.no.such"], "unknown"), (["factor.weather.nwp-current-bias"], "not executable")):
        with pytest.raises(FactorError, match=what):
            resolve(ids)
    one, two = selection_manifest(["factor.solar.position"]), selection_manifest(["factor.solar.daylight-boundary"])
    assert one["selection_sha256"] != two["selection_sha256"]


def test_input_errors_name_the_row(spark):
    s = settings()
    short = stations.annotate(frame(spark, row(power=[1.0] * 5)), s)
    with pytest.raises(FactorError, match="s1"):
        check_inputs(short, s, ["factor.power.variability"])
    nowhere = stations.annotate(frame(spark), s).withColumn("site_latitude", F.lit(None).cast("double"))
    with pytest.raises(FactorError, match="position"):
        check_inputs(nowhere, s, ["factor.solar.position"])


def test_catalog_is_consistent(spark):
    assert {r["factor_id"] for r in catalog().values() if r["status"] == "implemented"} == set(executable_ids())
    tables = experiment.catalog_tables(spark)
    assert experiment.catalog_problems(tables).count() == 0
    broken = tables | {"mechanisms": tables["mechanisms"].limit(1), "factors": tables["factors"].unionByName(tables["factors"].limit(1))}
    kinds = {r.kind for r in experiment.catalog_problems(broken).collect()}
    assert {"repeated", "no such mechanism"} <= kinds
