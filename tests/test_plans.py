import json

import pytest

from sunloom.operators.checks import DataError
from sunloom.plans import __main__ as cli
from sunloom.plans import experiment, forecast
from sunloom.settings import default_config
from sunloom.sources.synthetic import demo_origins
from sunloom.streaming import origins
from tests.stationdata import SCHEMA, frame, settings, with_site


def config(estimator="linear"):
    c = default_config()
    c["split"] |= {"train_start": "2024-03-01", "train_end": "2024-03-20", "validation_start": "2024-03-21", "validation_end": "2024-03-25", "test_start": "2024-03-26", "test_end": "2024-03-31"}
    c["model"]["estimator"] = estimator
    c["training"] |= {"epochs": 4, "early_stopping_patience": 2, "batch_size": 128}
    c["evaluation"]["score_capacity"] = 100.0
    return c


@pytest.fixture(scope="module")
def demo(spark):
    return with_site(demo_origins(spark)).cache()


@pytest.mark.parametrize("estimator", ["linear", "ensemble"])
def test_train_evaluate_predict(spark, demo, tmp_path, estimator):
    run = forecast.train(spark, config(estimator), demo, out=str(tmp_path), factor_ids=["factor.solar.clear-sky-irradiance"])
    assert run["tables"]["pooled_monthly_scores"].first().mean_monthly_capacity_score > 0.7
    assert (tmp_path / run["manifest"]["run_id"] / "run_manifest.json").exists()
    result = forecast.evaluate(spark, run["folder"], config(estimator), demo)
    assert result["unseen_stations"] == [] and result["predictions"].count() > 0
    ratios = [r.prediction_ratio for r in result["predictions"].collect()]
    assert 0 <= min(ratios) and max(ratios) <= 1.2
    vectors = forecast.predict(spark, run["folder"], config(estimator), demo.drop("Power_predict"))
    assert vectors.first().horizon_steps == [16]
    other = config(estimator)
    other["evaluation"]["score_capacity"] = 99.0
    with pytest.raises(DataError, match="differ"):
        forecast.evaluate(spark, run["folder"], other, demo)
    with pytest.raises(DataError, match="finished"):
        forecast.read_run(str(tmp_path / "none"))


def test_experiment_and_ledger(spark, demo, tmp_path):
    ids = ["factor.power.multiscale-ramp"]
    request = experiment.create_request("exploration", ids, [0], config(), {"files": {}})
    result = experiment.run(spark, request, config(), demo, str(tmp_path / "x"))
    assert result["protected_unchanged"] and result["rows_identical"] and len(result["metrics"]["overall"]) == 1
    ledger = str(tmp_path / "ledger.jsonl")
    experiment.record(spark, ledger, request, result)
    with pytest.raises(DataError, match="already"):
        experiment.record(spark, ledger, request, result)
    assert json.loads((tmp_path / "ledger.jsonl").read_text())["experiment_id"] == request["experiment_id"]
    for bad in ({"rows_identical": False}, {"protected_unchanged": False}, {"leakage": {"status": "failed"}}, {"schema_version": 0}):
        with pytest.raises(DataError, match="refused"):
            experiment.record(spark, ledger + "2", request, result | bad)


def test_requests(spark):
    with pytest.raises(DataError, match="phrase"):
        experiment.create_request("final_test", ["factor.solar.position"], [0], config(), {})
    request = experiment.create_request("smoke", ["factor.solar.position"], [0, 1], config(), {})
    with pytest.raises(DataError, match="factors"):
        experiment.match_request(request, config(), ["factor.solar.daylight-boundary"])
    assert experiment.mock_result(request)["metrics"]["overall"][0]["baseline_rmse"] == 0.125


def test_command_line_guards_the_test_split(spark):
    with pytest.raises(DataError, match="phrase"):
        cli.main(["evaluate", "--config", "c", "--data", "d", "--run", "r", "--out", "o"], spark)


def test_stream_gives_the_batch_rows(spark, tmp_path):
    s = settings()
    rows = frame(spark, site=False)
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    folder = tmp_path / "in"
    folder.mkdir()
    next((tmp_path / "w").glob("part-*.parquet")).rename(folder / "station=s1.parquet")
    sites = spark.createDataFrame([("s1", 500.0, 121.5, 31.2, "Asia/Shanghai")], "station_id string, site_capacity double, site_longitude double, site_latitude double, site_timezone string")
    ids = ["factor.solar.position", "factor.power.multiscale-ramp"]
    stream = origins.project(origins.read(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, s), sites, s, ids)
    q = stream.writeStream.format("memory").queryName("stream_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = origins.project(rows, sites, s, ids)
    assert spark.table("stream_rows").collect() == batch.select(*spark.table("stream_rows").columns).collect()
