"""The experiment workflow as commands: project files, requests, guarded adapter runs, records, and reports.

A project file (JSON) names the runtime's configuration, the data, the protected
files and where the state lies. An experiment's adapter is another process: its
command may hold the tokens ``{python}``, ``{project}``, ``{request}``,
``{output}`` and ``{root}``. The default command runs this package.
"""

from __future__ import annotations

import ast
import json
import subprocess
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from importlib.util import find_spec
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import fingerprints, pairing
from sunloom.operators.checks import DataError
from sunloom.plans import experiment, forecast
from sunloom.settings import Settings, default_config, load_settings
from sunloom.sources.synthetic import demo_origins

ADAPTER = ["{python}", "-m", "sunloom.plans", "adapter", "--project", "{project}", "--request", "{request}", "--out", "{output}"]
TIMEOUT_SECONDS = 86_400
#: Names of constants worth recording from a project's Python files.
CONSTANT_NAMES = frozenset(
    "HISTORY_LENGTH N_HORIZONS HORIZONS MINUTES_PER_POINT SCORE_CAPACITY PREDICTION_CLIP TARGET_INDEX N_EPOCHS EPOCHS BATCH_SIZE LEARNING_RATE SEED RANDOM_STATE".split()
)
#: Modules that the demo needs.
NEEDED = ("pyspark", "numpy", "pandas", "pyarrow")
#: Pairs of the demo come without their file's name.
DEMO_KEYS = tuple(k for k in pairing.KEYS if k != "source_file")

#: What a request and a result hold: type of every key. A type in a list is optional.
REQUEST_SHAPE: dict[str, Any] = {
    "schema_version": int, "experiment_id": str, "stage": str, "factors": dict, "seeds": list, "horizons": list, "prediction_mode": str, "minutes_per_point": int,
    "leakage_checks": list, "slices": list, "protected": dict,
}
RESULT_SHAPE: dict[str, Any] = {
    "schema_version": int, "experiment_id": str, "request_sha256": str, "stage": str, "protected_unchanged": bool, "rows_identical": bool, "leakage": dict, "metrics": dict,
    "rows_sha256": [str], "synthetic": [bool],
}


def shape_problems(value: Mapping[str, Any], shape: Mapping[str, Any]) -> list[str]:
    """Keys that are absent, unknown, or of another type."""
    out = [f"{k} is absent" for k, kind in shape.items() if k not in value and not isinstance(kind, list)]
    out += [f"{k} is unknown" for k in value if k not in shape]
    for k, kind in shape.items():
        wanted = kind[0] if isinstance(kind, list) else kind
        if k in value and (not isinstance(value[k], wanted) or (wanted is int and isinstance(value[k], bool))):
            out.append(f"{k} isn't of type {wanted.__name__}")
    return out


def read_json(path: str | Path, shape: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """An object from a JSON file, of the given shape."""
    try:
        value = json.loads(Path(path).expanduser().read_text("utf-8"))
    except (OSError, json.JSONDecodeError) as error:
        raise DataError(f"{path} can't be read: {error}") from error
    if not isinstance(value, dict):
        raise DataError(f"{path} doesn't hold an object")
    if shape and (wrong := shape_problems(value, shape)):
        raise DataError(f"{path}: {wrong}")
    return value


@dataclass(frozen=True)
class Project:
    """A project file and the folder that its relative paths start from."""

    path: Path
    root: Path
    body: Mapping[str, Any]

    @classmethod
    def read(cls, path: str | Path) -> Project:
        file = Path(path).expanduser().resolve()
        body = read_json(file)
        return cls(file, (file.parent / body.get("project_root", ".")).resolve(), body)

    def resolve(self, name: str, must_exist: bool = True) -> Path:
        """The path under a key; relative ones start at the project's root."""
        value = self.body.get(name)
        if not value:
            raise DataError(f"{self.path} has no {name}")
        found = Path(str(value)).expanduser()
        found = (found if found.is_absolute() else self.root / found).resolve()
        if must_exist and not found.exists():
            raise DataError(f"{name} doesn't exist: {found}")
        return found

    @property
    def settings_path(self) -> Path:
        return self.resolve("runtime_config")

    @property
    def state(self) -> Path:
        return (self.root / self.body.get("state_dir", "state")).resolve()

    @property
    def data(self) -> list[str]:
        given = self.body.get("data") or []
        return [str(x) for x in ([given] if isinstance(given, str) else given)]

    def snapshot(self) -> dict[str, Any]:
        return fingerprints.snapshot(self.root, self.body.get("protected_files") or [])


def static_constants(path: str | Path, names: frozenset[str] = CONSTANT_NAMES) -> dict[str, Any]:
    """Constants of a Python file, without running it; one that isn't a literal is ``<computed>``. Other files have none."""
    file = Path(path)
    if file.suffix != ".py":
        return {}
    try:
        tree = ast.parse(file.read_text("utf-8"))
    except (OSError, SyntaxError, UnicodeDecodeError):
        return {}
    found: dict[str, Any] = {}
    for node in ast.walk(tree):
        named = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value is not None else []
        for target in named:
            if isinstance(target, ast.Name) and target.id.upper() in names:
                try:
                    found[target.id] = ast.literal_eval(node.value)
                except ValueError:
                    found[target.id] = "<computed>"
    return found


def inspect(project: Project) -> dict[str, Any]:
    """Hashes of the protected files and the constants in those that are Python; written to the state."""
    report = project.snapshot()
    report["constants"] = {name: c for name in report["files"] if (c := static_constants(project.root / name))}
    forecast.write_json(project.state / "project_snapshot.json", report)
    return report


def _protected(report: Mapping[str, Any]) -> dict[str, Any]:
    return {k: report[k] for k in ("files", "snapshot_sha256")}


def create(project: Project, stage: str, factor_ids: Sequence[str], seeds: Sequence[int], phrase: str = "", out: str | None = None) -> Path:
    """Writes a request on the last inspection's snapshot."""
    known = project.state / "project_snapshot.json"
    if not known.exists():
        raise DataError(f"{known} is absent: inspect the project first")
    request = experiment.create_request(stage, factor_ids, seeds, project.settings_path, _protected(read_json(known)), phrase)
    path = Path(out) if out else project.state / "requests" / f"{request['experiment_id']}.json"
    forecast.write_json(path, request)
    return path


def adapter_command(project: Project, request: Path, output: Path) -> list[str]:
    tokens = {"{python}": sys.executable, "{project}": str(project.path), "{request}": str(request), "{output}": str(output), "{root}": str(project.root)}
    command = [str(part) for part in project.body.get("adapter_command") or ADAPTER]
    for token, value in tokens.items():
        command = [part.replace(token, value) for part in command]
    return command


def run(project: Project, request_path: str | Path, out: str | None = None) -> Path:
    """Runs the adapter in a process of its own, under the snapshot's hash and a timeout; returns the result's path."""
    request_file = Path(request_path).expanduser().resolve()
    request = read_json(request_file, REQUEST_SHAPE)
    before = _protected(project.snapshot())
    if before != request["protected"]:
        raise DataError("protected files differ from the request's")
    output = Path(out).resolve() if out else project.state / "results" / request["experiment_id"]
    output.mkdir(parents=True, exist_ok=True)
    seconds = float((project.body.get("experiment") or {}).get("command_timeout_seconds", TIMEOUT_SECONDS))
    try:
        done = subprocess.run(adapter_command(project, request_file, output), cwd=project.root, check=False, timeout=seconds)
    except subprocess.TimeoutExpired as error:
        raise DataError(f"the adapter took more than {seconds:g} seconds") from error
    if _protected(project.snapshot()) != before:
        raise DataError("protected files changed during the experiment")
    if done.returncode:
        raise DataError(f"the adapter failed with {done.returncode}")
    result = output / "result.json"
    if not result.exists():
        raise DataError(f"the adapter wrote no {result}")
    if read_json(result, RESULT_SHAPE)["experiment_id"] != request["experiment_id"]:
        raise DataError("the result is of another experiment")
    return result


def adapter(spark: SparkSession, project: Project, request_path: str | Path, out: str, mock: bool = False) -> dict[str, Any]:
    """The default adapter: a paired experiment over the project's data, or a made-up result to try the workflow."""
    request = read_json(request_path, REQUEST_SHAPE)
    if mock:
        result = experiment.mock_result(request)
        forecast.write_json(Path(out, "result.json"), result)
        return result
    return experiment.run(spark, request, project.settings_path, project.data, out, lambda: _protected(project.snapshot()))


def record(spark: SparkSession, project: Project, request_path: str | Path, result_path: str | Path) -> Path:
    ledger = project.state / "experiments.jsonl"
    experiment.record(spark, str(ledger), read_json(request_path, REQUEST_SHAPE), read_json(result_path, RESULT_SHAPE))
    return ledger


def absent_modules(names: Sequence[str] = NEEDED) -> list[str]:
    return [n for n in names if find_spec(n) is None]


def demo_settings(stations: Sequence[str], mode: str = "endpoint") -> Settings:
    """Settings of the demo: a month of origins, the last days for validation and test; ``mode`` is endpoint or curve."""
    config = default_config()
    config["features"]["prediction_mode"] = mode
    config["split"] |= {
        "train_start": "2024-03-01", "train_end": "2024-03-20 23:59:59", "validation_start": "2024-03-21", "validation_end": "2024-03-25 23:59:59",
        "test_start": "2024-03-26", "test_end": "2024-03-31 23:59:59", "test_stations": list(stations),
    }
    config["evaluation"]["score_capacity"] = 100.0
    return load_settings(config)


def factor_report(paired: DataFrame, capacity: float) -> dict[str, DataFrame]:
    """Tables of a factor's paired runs: by seed and step, and all groupings."""
    return {"paired_rmse": pairing.rmse_by_seed_and_step(paired).orderBy("seed", "horizon_step"), "comparison": pairing.compare(paired, capacity)}


def demo(spark: SparkSession, out: str, factor_ids: Sequence[str] = ("factor.power.multiscale-ramp",), seeds: Sequence[int] = (0,), mode: str = "endpoint") -> dict[str, Any]:
    """Trains baseline and candidate on made-up stations and writes the reports. Its scores are no evidence."""
    if absent := absent_modules():
        raise DataError(f"the demo needs {absent}")
    origins = demo_origins(spark).withColumns({"site_capacity": F.lit(500.0), "site_longitude": F.lit(121.5), "site_latitude": F.lit(31.2), "site_timezone": F.lit("Asia/Shanghai")})
    settings = demo_settings([r[0] for r in origins.select("station").distinct().orderBy("station").collect()], mode)
    paired, runs = None, {}
    for seed in seeds:
        sides = [forecast.train(spark, settings, origins, seed, ids, f"{out}/seed{seed}/{name}") for name, ids in (("baseline", ()), ("candidate", factor_ids))]
        own = pairing.pair(*[s["predictions"] for s in sides], keys=DEMO_KEYS, seed=seed)
        paired = own if paired is None else paired.unionByName(own)
        runs[str(seed)] = [s["folder"] for s in sides]
    tables = factor_report(paired, settings.score_capacity)
    forecast.write_tables(tables, f"{out}/reports")
    overall = tables["comparison"].where("grouping = ''").first().asDict()
    summary = {"factor_ids": list(factor_ids), "seeds": list(seeds), "mode": mode, "runs": runs, "synthetic": True, "overall": {k: v for k, v in overall.items() if k.partition("_")[0] in ("baseline", "candidate", "delta", "sample")}}
    forecast.write_json(Path(out, "reports", "summary.json"), summary)
    return summary


def catalog_report(spark: SparkSession) -> list[str]:
    """What is wrong with the catalog, as one line each."""
    rows = experiment.catalog_problems(experiment.catalog_tables(spark)).orderBy("kind", "id").collect()
    return [f"{r['kind']}: {r['id']} ({r['detail']})" for r in rows]

