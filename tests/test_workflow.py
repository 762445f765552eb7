"""The experiment workflow, audits by value, and rules of files and parameters."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import checks, fingerprints, metrics, pairing, preprocessing
from sunloom.operators.factors.registry import FactorError, check_outputs, finite_shares
from sunloom.plans import __main__ as cli
from sunloom.plans import experiment, forecast, workflow
from sunloom.settings import SettingsError, default_config, load_settings
from sunloom.sources import stations
from tests.test_plans import config

IDS = ["factor.power.multiscale-ramp"]


@pytest.fixture
def project(tmp_path):
    (tmp_path / "model.py").write_text("SEED = 7\nBATCH_SIZE: int = 4 * 2\nOTHER = 1\n")
    (tmp_path / "runtime.json").write_text(json.dumps(default_config()))
    body = {"runtime_config": "runtime.json", "protected_files": ["*.py"], "experiment": {"command_timeout_seconds": 60}}
    body["adapter_command"] = ["{python}", "{root}/adapter_tool", "{request}", "{output}"]
    (tmp_path / "project.json").write_text(json.dumps(body))
    (tmp_path / "adapter_tool").write_text(
        "import json, sys\nr = json.load(open(sys.argv[1]))\n"
        "json.dump({'schema_version': 1, 'experiment_id': r['experiment_id'], 'request_sha256': '', 'stage': r['stage'], 'protected_unchanged': True,"
        " 'rows_identical': True, 'leakage': {'status': 'passed'}, 'metrics': {}}, open(sys.argv[2] + '/result.json', 'w'))\n"
    )
    return workflow.Project.read(tmp_path / "project.json")


def test_inspect_create_run_record(spark, project, capsys):
    arguments = ["--project", str(project.path)]
    with pytest.raises(checks.DataError, match="inspect"):
        cli.main(["create", *arguments, "--factor", *IDS])
    assert cli.main(["inspect", *arguments]) == 0
    report = json.loads((project.state / "project_snapshot.json").read_text())
    assert report["constants"] == {"model.py": {"SEED": 7, "BATCH_SIZE": "<computed>"}}
    assert cli.main(["create", *arguments, "--factor", *IDS, "--seed", "3"]) == 0
    (request,) = (project.state / "requests").glob("*.json")
    assert len(json.loads(request.read_text())["slices"]) == 13
    assert cli.main(["run", *arguments, "--request", str(request)]) == 0
    result = project.state / "results" / request.stem / "result.json"
    body = json.loads(result.read_text())
    body["request_sha256"] = fingerprints.json_hash(json.loads(request.read_text()))
    result.write_text(json.dumps(body))
    assert cli.main(["record", *arguments, "--request", str(request), "--result", str(result)], spark) == 0
    with pytest.raises(checks.DataError, match="already"):
        cli.main(["record", *arguments, "--request", str(request), "--result", str(result)], spark)


def test_runs_are_guarded(project):
    workflow.inspect(project)
    request = workflow.create(project, "smoke", IDS, [0])

    def with_tool(text):
        (project.root / "adapter_tool").write_text(text)
        return workflow.run(project, request)

    for text, why in (
        ("import sys; sys.exit(3)", "failed with 3"),
        ("pass", "wrote no"),
        ("import time; time.sleep(30)", "more than"),
        ("import json, sys; json.dump({'experiment_id': 'x'}, open(sys.argv[2] + '/result.json', 'w'))", "absent"),
        ("open('model.py', 'a').write('# touched')", "changed during"),
        ("pass", "differ from the request"),
    ):
        project.body["experiment"]["command_timeout_seconds"] = 2 if "sleep" in text else 60
        with pytest.raises(checks.DataError, match=why):
            with_tool(text)


def test_default_adapter_writes_a_mock_result(spark, project):
    workflow.inspect(project)
    request = workflow.create(project, "smoke", IDS, [0])
    body = {k: v for k, v in project.body.items() if k != "adapter_command"}
    own = workflow.Project(project.path, project.root, body)
    assert workflow.adapter_command(own, request, project.root / "o")[:4] == [sys.executable, "-m", "sunloom.plans", "adapter"]
    assert cli.main(["adapter", "--project", str(project.path), "--request", str(request), "--out", str(project.root / "m"), "--mock"], spark) == 0
    assert json.loads((project.root / "m" / "result.json").read_text())["synthetic"] is True


def test_shapes_and_paths(project, tmp_path):
    assert workflow.shape_problems({"a": 1, "c": "x"}, {"a": str, "b": int, "d": [int]}) == ["b is absent", "c is unknown", "a isn't of type str"]
    assert workflow.shape_problems({"a": True}, {"a": int}) == ["a isn't of type int"]
    (tmp_path / "bad.json").write_text("[1]")
    for name in ("bad.json", "none.json"):
        with pytest.raises(checks.DataError):
            workflow.read_json(tmp_path / name)
    assert project.settings_path == project.root / "runtime.json"
    with pytest.raises(checks.DataError, match="has no"):
        project.resolve("nothing")
    with pytest.raises(checks.DataError, match="doesn't exist"):
        workflow.Project(project.path, project.root, {"runtime_config": "gone.yaml"}).settings_path
    assert workflow.static_constants(tmp_path / "bad.json") == {}
    assert workflow.absent_modules(("sys", "no_such_module_here")) == ["no_such_module_here"]


def test_demo_reports(spark, tmp_path):
    summary = workflow.demo(spark, str(tmp_path), IDS, [0, 1])
    assert summary["synthetic"] and summary["overall"]["sample_count"] > 0
    rows = spark.read.csv(str(tmp_path / "reports" / "paired_rmse"), header=True, inferSchema=True).collect()
    assert sorted((r.seed, r.horizon_step) for r in rows) == [(0, 16), (1, 16)]
    assert json.loads((tmp_path / "reports" / "summary.json").read_text())["factor_ids"] == IDS


def test_catalog_is_sound_and_problems_are_found(spark):
    assert workflow.catalog_report(spark) == []
    tables = experiment.catalog_tables(spark)
    wrong = spark.createDataFrame(
        [("factor.x", " ", "power", ["mechanism.ramping"], "implemented", "soon", "sunloom.nowhere:f"), ("factor.y", "Sky image", "power", [], "hypothesis", "history", None)], tables["factors"].schema
    )
    found = {(r["kind"], r["id"]) for r in experiment.catalog_problems(tables | {"factors": wrong}).collect()}
    assert found == {("unknown availability", "factor.x"), ("no name or family", "factor.x"), ("implementation isn't callable", "factor.x"), ("no mechanism", "factor.y"), ("an input from images", "factor.y")}


def test_a_changed_value_fails_the_pair_audit(spark):
    df = spark.createDataFrame([(f"r{i}", [1.0 * i, 2.0], 0.1 * i, 1.0 * i, 100.0) for i in range(20)], "row_id string, v array<double>, target_ratio double, target_power double, capacity double")
    whole = preprocessing.split_values(df, F.col("v"))
    assert whole == preprocessing.split_values(df.repartition(7), F.col("v"))

    def manifest(values):
        prepared = {"label": {}, **{f"{w}_{k}": v for w in ("train", "validation") for k, v in values.items()}}
        return {"seed": 0, "rows_by_step": {}, "trained_stations": [], "environment": {}, "contract": {"split": 1, "evaluation": 1, "features": {}}, "steps": {16: {"prepared": prepared, "artifact": {}}}}

    assert experiment.audit_pair(manifest(whole), manifest(whole)) == []
    for column, name in (("capacity", "capacity"), ("target_ratio", "target_ratio"), ("target_power", "target_power")):
        other = preprocessing.split_values(df.withColumn(column, F.when(F.col("row_id") == "r3", F.lit(5.5)).otherwise(F.col(column))), F.col("v"))
        assert experiment.audit_pair(manifest(whole), manifest(other)) == [f"step 16: train_{name}", f"step 16: validation_{name}"]
    moved = preprocessing.split_values(df.withColumn("v", F.when(F.col("row_id") == "r3", F.array(F.lit(3.0), F.lit(2.5))).otherwise(F.col("v"))), F.col("v"))
    assert experiment.audit_pair(manifest(whole), manifest(moved)) == ["step 16: train_features", "step 16: validation_features"]


def test_experiment_slices(spark, tmp_path):
    from sunloom.sources.synthetic import demo_origins
    from tests.stationdata import with_site

    request = experiment.create_request("exploration", IDS, [0], config(), {"files": {}})
    result = experiment.run(spark, request, config(), with_site(demo_origins(spark)), str(tmp_path))
    assert workflow.shape_problems(result, workflow.RESULT_SHAPE) == []
    found = result["metrics"]
    assert set(experiment.SLICES) <= set(found)
    whole = found["overall"][0]["sample_count"]
    assert sum(found[k]["sample_count"] for k in ("ramp", "stable")) == whole
    assert sum(found[k]["sample_count"] for k in ("low_sun", "daylight")) == whole
    assert set(found["factor_coverage"].values()) == {1.0}
    assert found["worst_station"]["delta_rmse"] == max(r["delta_rmse"] for r in found["by_station"])


def test_noise_is_of_every_cell(spark):
    df = spark.range(4000).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), F.posexplode(F.array(F.lit(0.0), F.lit(0.0))).alias("feature", "v"))
    rows = df.withColumn("e", preprocessing.noise(F.col("row_id"), F.col("feature"), 3, 2.0)).groupBy("row_id").pivot("feature", [0, 1]).agg(F.first("e")).orderBy("row_id").toPandas()
    a, b = rows["0"].to_numpy(), rows["1"].to_numpy()
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and not np.any(a == b)
    assert a.std() == pytest.approx(2.0, rel=0.06) and abs(a.mean()) < 0.15
    train = spark.range(600).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("v"))
    knots = preprocessing.fit_quantiles(train, F.col("v"), ["x", "y"], {"noise_std": 0.5}).values
    assert not np.any(knots[:, 0] == knots[:, 1])


def test_knots_of_sketches_are_near_the_exact_ones(spark):
    train = spark.range(20_000).select(F.col("id").cast("string").alias("row_id"), F.array((F.col("id") % 9973).cast("double"), F.sqrt(F.col("id").cast("double"))).alias("v"))
    exact, sketched = (preprocessing.fit_quantiles(train, F.col("v"), ["x", "y"], {}, exact_rows=n).values for n in (10**6, 0))
    assert exact.shape == sketched.shape and np.abs(exact - sketched).max() <= 1.0


def predictions(spark, n=400):
    e = F.sin(F.col("id").cast("double")) * 5
    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 5).cast("string").alias("station_id"), F.lit("f").alias("source_file"), F.timestamp_add("HOUR", (F.col("id") * 7).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("timestamp"),
        F.timestamp_add("HOUR", (F.col("id") * 7 + 4).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("target_timestamp"), (1 + F.col("id") % 16).cast("int").alias("horizon_step"),
        (F.col("id") % 50).cast("double").alias("groundtruth"), (F.col("id") % 50 + e).alias("prediction"), (F.col("id") % 50 / 50.0).alias("groundtruth_ratio"), ((F.col("id") % 50 + e) / 50.0).alias("prediction_ratio"),
    )


def test_evaluation_rolls_up_to_the_direct_tables(spark):
    p = predictions(spark)
    rolled = metrics.evaluate(p, 50.0)
    direct = {
        "horizon_metrics": metrics.with_primary_score(metrics.by_horizon(p, 50.0), metrics.pooled_monthly(p, 50.0)), "station_metrics": metrics.by_station(p, 50.0),
        "daily_metrics": metrics.daily(p, 50.0), "horizon_group_metrics": metrics.by_horizon_group(p, 50.0).drop("first_step"),
    }
    for name, table in direct.items():
        keys = [c for c in ("horizon_step", "station_id", "date", "horizon_group") if c in table.columns]
        a, b = (t.orderBy(*keys).toPandas()[table.columns] for t in (rolled[name], table))
        for c in table.columns:
            if c in keys:
                assert a[c].tolist() == b[c].tolist()
            else:
                assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=1e-9), (name, c)


def test_compare_keeps_null_keys_apart_from_totals(spark):
    p = predictions(spark)
    sides = p.select("row_id", "station_id", "horizon_step", "target_timestamp", "groundtruth", F.col("prediction").alias("prediction_baseline"), (F.col("prediction") * 0.9).alias("prediction_candidate")).withColumn("month", F.month("target_timestamp"))
    rows = pairing.compare(sides.withColumn("seed", F.when(F.col("station_id") == "1", F.lit(4))), 50.0).collect()
    seeds = {r.seed: r.sample_count for r in rows if r.grouping == "seed"}
    assert seeds == {None: 320, 4: 80}
    assert [r.sample_count for r in rows if r.grouping == ""] == [400]
    assert sum(r.sample_count for r in rows if r.grouping == "station_id") == 400


def test_factor_values_have_to_be_finite(spark):
    df = spark.createDataFrame([("s", 1, 16, 0.5, float("nan")), ("s", 2, 16, None, 1.0)], "station_id string, timestamp int, horizon_step int, a double, b double")
    assert {r["name"]: (r["n_bad"], r["finite_share"]) for r in finite_shares(df, ["a", "b"]).collect()} == {"a": (1, 0.5), "b": (1, 0.5)}
    with pytest.raises(FactorError, match="a isn't finite in 1 rows, first at station s, origin 2"):
        check_outputs(df, ["a"])


@pytest.mark.parametrize(
    ("change", "why"),
    [
        ({"clear_sky_index_min_ghi": 0.0}, "positive"), ({"clear_sky_index_clip_lower": 2.0}, "increase"), ({"faiman_u0": float("inf")}, "finite"),
        ({"faiman_u1": -1.0}, "negative"), ({"no_such": 1.0}, "unknown"),
    ],
)
def test_parameter_rules(change, why):
    c = default_config()
    c["factor_parameters"] |= change
    with pytest.raises(SettingsError, match=why):
        load_settings(c)


def test_files_and_site_records(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(bytes(range(256)) * 99)
    got = {r["name"]: (r["n_bytes"], r["sha256"]) for r in fingerprints.file_hashes(spark, [str(tmp_path / n) for n in ("a.bin", "b.bin")]).collect()}
    assert got == {n: ((tmp_path / n).stat().st_size, fingerprints.file_hash(tmp_path / n)) for n in ("a.bin", "b.bin")}
    df = spark.createDataFrame([("s", 1.0, 1), ("s", 1.0, 2)], "station_id string, site_capacity double, x int")
    assert stations.distinct_sites(df).collect() == [("s", 1.0)]


def test_rows_come_in_order(spark):
    from tests.stationdata import frame, settings

    rows = frame(spark, site=False)
    times = [r[0] for r in stations.load_in_order(spark, rows.repartition(3), settings()).select("timestamp").collect()]
    assert times == sorted(times) and len(times) == rows.count()


def test_unseen_stations(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "station_id string")
    assert forecast.unseen_stations(df, {"trained_stations": ["a", "c"]}) == ["b"]


def test_changed_artifacts_are_refused(spark, tmp_path):
    """Each file of a saved step, its manifest, its step and its contract."""
    from sunloom.operators import model

    names = ["x", "y"]
    train = spark.range(300).select(F.concat(F.lit("r"), "id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("v"))
    knots = preprocessing.fit_quantiles(train, F.col("v"), names, {"noise_std": 0.0})
    weights = {"first": np.ones((2, 3))}
    contract = {"features": {"base_features": names, "factor_features": []}}
    fresh = lambda n: model.save(model.EnsembleModel(weights, [{"epoch": 1, "rmse": 0.5}]), knots, preprocessing.LabelScale("none"), str(tmp_path / n), contract, 3, 16, ["s"])
    fresh("good")
    fitted, again, labels, manifest = model.load(str(tmp_path / "good"), contract, 16)
    assert np.array_equal(again.values, knots.values) and manifest["trained_stations"] == ["s"] and fitted.history == [{"epoch": 1, "rmse": 0.5}]
    for step, other, why in ((8, contract, "step 8"), (16, {"features": {"base_features": ["y", "x"], "factor_features": []}}, "contract")):
        with pytest.raises(checks.DataError, match=why):
            model.load(str(tmp_path / "good"), other, step)
    changes = {
        "history": lambda d: (d / "history.json").write_text("[]"), "quantiles": lambda d: np.savez(d / "quantiles.npz", probabilities=knots.probabilities, values=knots.values + 1),
        "model": lambda d: np.savez(d / "model.npz", first=np.zeros((2, 3))), "manifest": lambda d: (d / "artifact_manifest.json").write_text((d / "artifact_manifest.json").read_text().replace('"step": 16', '"step": 15')),
    }
    for what, change in changes.items():
        fresh(what)
        change(tmp_path / what)
        with pytest.raises(checks.DataError, match=what):
            model.load(str(tmp_path / what), contract)
    with pytest.raises(checks.DataError, match="finished"):
        model.load(str(tmp_path / "none"), contract)
