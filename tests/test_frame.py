from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sunloom.operators import checks, features, metrics, pairing, preprocessing, splits
from sunloom.operators.fingerprints import array_hash, json_hash, ordered_hash, set_fingerprint
from sunloom.settings import Settings, default_config
from sunloom.sources import sites, stations
from tests.stationdata import frame, row, settings


def build(spark, *rows, **features_):
    s = settings(**features_)
    df = stations.with_capacity(stations.annotate(frame(spark, *rows), s), s)
    return features.build(df, s), s


def test_base_features(spark):
    power = [float(i) for i in range(100)]
    df, s = build(spark, row(when="2024-09-10 20:15:00", capacity=100.0, power=power))
    w = features.wide(df, s).first()
    assert w.power_lag_96 == pytest.approx(0.04) and w.power_lag_1 == pytest.approx(0.99)
    assert w.GHI_SOLARGIS_predict_target == 215 and w.target_power == 115 and w.target_ratio == pytest.approx(1.15)
    assert w.predict_hour == 0 and w.predict_month == 9
    assert len(features.base_names(s)) == 102
    assert w.row_id == "s1__2024-09-10T20:15:00.000000__n0__h16"
    month, _ = build(spark, row(when="2024-09-30 23:00:00"))
    assert month.first().predict_month == 10


def test_fan_out_and_invalid_rows(spark):
    bad = row(when="2024-09-11 12:00:00", power=[float("inf")] + [1.0] * 95)
    df, _ = build(spark, row(), row(), bad, prediction_mode="curve", horizons=[1, 4])
    assert sorted(r.row_id[-8:] for r in df.collect()) == ["__n0__h1"[:0] + x for x in ("_n0__h01", "_n0__h04", "_n1__h01", "_n1__h04")]


def test_files(spark, tmp_path):
    s = settings()
    for name, rows in (("station=b", [row("b"), row("b", when="2024-09-10 12:15:00", capacity=520.0)]), ("station=a", [row("a"), (None, *row("a")[1:])])):
        frame(spark, site=False).limit(0).unionByName(spark.createDataFrame(rows, frame(spark, site=False).schema)).coalesce(1).toPandas()
        spark.createDataFrame(rows, frame(spark, site=False).schema).coalesce(1).write.parquet(f"{tmp_path}/w-{name}")
        part = next((tmp_path / f"w-{name}").glob("part-*.parquet"))
        part.rename(tmp_path / f"{name}.parquet")
    paths = stations.discover(spark, tmp_path, s)
    assert [p.rpartition("/")[2] for p in paths] == ["station=a.parquet", "station=b.parquet"]
    df = stations.scan(spark, tmp_path, s)
    assert {(r.station_id, r.capacity) for r in df.collect()} == {("a", 500.0), ("b", 520.0)} and df.count() == 3
    assert "GHI_real" not in df.columns
    assert stations.manifest(df)["rows"] == {"a": 1, "b": 2}
    with pytest.raises(checks.DataError):
        stations.discover(spark, tmp_path / "none", s)
    assert "Power_predict" not in stations.required_columns(s, False) and "GHI_real" in stations.required_columns(s, True, None)


def test_station_rules(spark):
    s = settings()
    with pytest.raises(checks.DataError, match="blank"):
        stations.annotate(frame(spark, row(" ")), s)
    two = frame(spark, row("a"), row("b")).withColumn("source_file", F.lit("f"))
    with pytest.raises(checks.DataError, match="more than one"):
        stations.annotate(two, s)
    with pytest.raises(checks.DataError, match="capacity"):
        stations.with_capacity(stations.annotate(frame(spark, row(capacity=0.0)), s), s)
    with pytest.raises(checks.DataError, match="fewer"):
        stations.scan(spark, frame(spark, row(power=[1.0] * 95)), s)


def test_sites(spark, tmp_path):
    config = default_config()
    csv = tmp_path / "sites.csv"
    csv.write_text("plantid,GCCAPACITY,LONGITUDE,LATITUDE\nb-alias,500,121.5,31.2\nc,10,100,30\nc,10,100,30\n")
    config["data"]["site_metadata"] |= {"path": str(csv), "aliases": {"b-alias": "b"}, "overrides": {"c": {"capacity": 20, "longitude": 101, "latitude": 31}}}
    s = Settings(config)
    loaded = sites.load_sites(spark, s)
    assert {r.station_id: r.site_capacity for r in loaded.collect()} == {"b": 500.0, "c": 20.0}
    rows = stations.annotate(frame(spark, row("b-alias"), site=False), s)
    assert sites.attach(rows, loaded).first().site_longitude == 121.5
    with pytest.raises(checks.DataError, match="no site metadata"):
        sites.attach(stations.annotate(frame(spark, row("z"), site=False), s), loaded)
    csv.write_text("plantid,GCCAPACITY,LONGITUDE,LATITUDE\nb,500,121.5,31.2\nb,501,121.5,31.2\n")
    with pytest.raises(checks.DataError, match="differ"):
        sites.load_sites(spark, s)
    csv.write_text("plantid,GCCAPACITY,LONGITUDE,LATITUDE\nb,500,221.5,31.2\n")
    with pytest.raises(checks.DataError, match="longitude"):
        sites.load_sites(spark, s)


SPLIT = "row_id string, station_id string, timestamp timestamp_ntz"


def test_splits(spark):
    days = [datetime(2024, 1, 26), datetime(2024, 1, 27), datetime(2024, 1, 31), datetime(2024, 2, 24), datetime(2024, 2, 25), datetime(2024, 2, 29)]
    df = spark.createDataFrame([(str(i), "s1", d) for i, d in enumerate(days)], SPLIT)
    s = settings({"validation_strategy": "monthly_tail", "validation_last_days": 5, "validation_start": None, "validation_end": None})
    train, validation = splits.train_validation(df, s)
    assert sorted(r.row_id for r in train.collect()) == ["0", "3"] and sorted(r.row_id for r in validation.collect()) == ["1", "2", "4", "5"]
    explicit = settings({"train_end": "2024-01-31", "validation_start": "2024-02-01", "validation_end": "2024-02-25", "train_stations": ["s1"]})
    train, validation = splits.train_validation(df, explicit)
    assert train.count() == 3 and validation.count() == 2
    with pytest.raises(checks.DataError, match="no rows"):
        splits.evaluation(df, explicit)
    both = settings({"validation_start": "2024-01-01", "validation_end": "2024-12-01"})
    with pytest.raises(checks.DataError, match="share"):
        splits.train_validation(df, both)


PRED = "row_id string, station_id string, source_file string, timestamp timestamp_ntz, target_timestamp timestamp_ntz, horizon_step int, groundtruth float, prediction float"


def preds(spark, *rows):
    return spark.createDataFrame([(i, st, "f", datetime.fromisoformat(t), datetime.fromisoformat(t), h, y, p) for i, st, t, h, y, p in rows], PRED)


def test_primary_score_and_days(spark):
    df = preds(spark, ("1", "a", "2024-01-01 01:00:00", 16, 0.0, 3.0), ("2", "b", "2024-01-01 02:00:00", 16, 0.0, 4.0))
    assert metrics.pooled_monthly(df, 10.0).first().mean_monthly_capacity_score == pytest.approx(1 - 12.5**0.5 / 10)
    tables = metrics.evaluate(df, 10.0)
    assert tables["horizon_metrics"].first().station_count == 2 and tables["daily_metrics"].count() == 2
    with pytest.raises(checks.DataError, match="finite"):
        metrics.guard(preds(spark, ("1", "a", "2024-01-01 01:00:00", 16, float("nan"), 3.0)))
    with pytest.raises(checks.DataError, match="no rows"):
        metrics.guard(df.limit(0))


def test_pairing(spark):
    base = preds(spark, ("1", "a", "2024-01-01 01:00:00", 16, 0.0, 3.0), ("2", "b", "2024-02-01 02:00:00", 4, 0.0, 4.0))
    cand = preds(spark, ("1", "a", "2024-01-01 01:00:00", 16, 0.0, 2.0), ("2", "b", "2024-02-01 02:00:00", 4, 0.0, 5.0))
    rows = pairing.compare(pairing.pair(base, cand, seed=1), 10.0).collect()
    by = {(r.grouping, r.station_id): r for r in rows}
    assert by["station_id", "a"].delta_rmse == pytest.approx(-1) and by["station_id", "b"].delta_rmse == pytest.approx(1)
    assert {r.grouping for r in rows} == {"", "horizon_step", "station_id", "month", "seed"} and len(rows) == 8
    macro = pairing.station_macro_delta(pairing.compare(pairing.pair(base, cand), 10.0, [("station_id",)])).first()
    assert macro.improved_station_ratio == 0.5 and macro.worst_delta_rmse == pytest.approx(1)
    with pytest.raises(checks.DataError, match="partner"):
        pairing.pair(base, cand.limit(1))
    with pytest.raises(checks.DataError, match="truths"):
        pairing.pair(base, cand.withColumn("groundtruth", F.lit(1.0).cast("float")))
    with pytest.raises(checks.DataError, match="repeat"):
        pairing.pair(base.unionByName(base), cand)


def test_issue_times(spark):
    df = frame(spark).withColumn("timestamp", F.col("timestamp_win")).withColumn("issued", F.lit(None).cast("timestamp_ntz"))
    assert pairing.issue_time_audit(df, None)["status"] == "contract_assumed"
    assert pairing.issue_time_audit(df, "issued")["unverifiable_rows"] == 1
    with pytest.raises(checks.DataError, match="issued after"):
        pairing.issue_time_audit(df.withColumn("issued", F.timestamp_add("MINUTE", F.lit(1), "timestamp_win")), "issued")


def test_preprocessing_is_fitted_on_training_rows_only(spark):
    rows = [(f"r{i}", "s", datetime(2024, 1, 1 + i % 20), "f", [float(i), float(i % 3)], float(i) / 50) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, station_id string, timestamp timestamp_ntz, source_file string, v array<double>, target_ratio double")
    train, validation = df.where("target_ratio < 0.8"), df.where("target_ratio >= 0.8")
    done = preprocessing.prepare(train, validation, F.col("v"), ["x", "y"], settings())
    assert done.features.values[:, 0].max() < 40.1
    again = preprocessing.prepare(train, validation.withColumn("v", F.array(F.lit(1e6), F.lit(0.0))), F.col("v"), ["x", "y"], settings())
    assert again.manifest["features"] == done.manifest["features"]
    assert done.validation.select(F.max(F.element_at("features", 1))).first()[0] == pytest.approx(5.1993, abs=1e-3)
    with pytest.raises(checks.DataError, match="share"):
        preprocessing.prepare(train, df, F.col("v"), ["x", "y"], settings())
    with pytest.raises(checks.DataError, match="station"):
        preprocessing.prepare(train, validation, F.col("v"), ["x", "station_id"], settings())


def test_hashes(spark):
    assert ordered_hash(["a", "bc"])[1] != ordered_hash(["ab", "c"])[1] != ordered_hash(["c", "ab"])[1]
    assert array_hash([[1.0, 2.0]]) != array_hash([1.0, 2.0])
    assert json_hash({"a": 1, "b": 2}) == json_hash({"b": 2, "a": 1})
    df = spark.range(50)
    assert set_fingerprint(df).first() == set_fingerprint(df.orderBy(F.desc("id"))).first() != set_fingerprint(df.limit(49)).first()


def test_row_order_does_not_matter(spark):
    rows = [row("a", f"2024-09-1{i} 12:00:00") for i in range(4)]
    one, two = (sorted(map(str, build(spark, *r)[0].collect())) for r in (rows, rows[::-1]))
    assert one == two
