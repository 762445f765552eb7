"""Command line: train, evaluate, predict and list stations; inspect a project, create, run and record experiments; check the catalog; run the demo."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sunloom.operators.checks import DataError
from sunloom.plans import experiment, forecast, workflow


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sunloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "evaluate", "predict", "stations"):
        c = sub.add_parser(name)
        c.add_argument("--config", required=True)
        c.add_argument("--data", required=True, nargs="+")
        if name == "train":
            c.add_argument("--seed", type=int)
            c.add_argument("--factor", action="append", default=[])
        if name in ("train", "evaluate", "predict"):
            c.add_argument("--out", required=name != "train")
        if name in ("evaluate", "predict"):
            c.add_argument("--run", required=True)
        if name == "evaluate":
            c.add_argument("--role", choices=("test", "confirmation"), default="test")
            c.add_argument("--phrase", default="")
    for name in ("inspect", "create", "run", "adapter", "record"):
        c = sub.add_parser(name)
        c.add_argument("--project", required=True)
        if name == "create":
            c.add_argument("--stage", choices=sorted(experiment.STAGES), default="exploration")
            c.add_argument("--factor", action="append", required=True)
            c.add_argument("--seed", action="append", type=int)
            c.add_argument("--phrase", default="")
        if name in ("run", "adapter", "record"):
            c.add_argument("--request", required=True)
        if name in ("create", "run", "adapter"):
            c.add_argument("--out", required=name == "adapter")
        if name == "adapter":
            c.add_argument("--mock", action="store_true")
        if name == "record":
            c.add_argument("--result", required=True)
    sub.add_parser("catalog")
    c = sub.add_parser("demo")
    c.add_argument("--out", required=True)
    c.add_argument("--factor", action="append")
    c.add_argument("--seed", action="append", type=int)
    c.add_argument("--mode", choices=("endpoint", "curve"), default="endpoint")
    return p


def _workflow(args: argparse.Namespace, spark: SparkSession | None) -> int:
    """Commands of the experiment workflow; only those that compute start a session."""
    if args.command in ("inspect", "create", "run"):
        project = workflow.Project.read(args.project)
        if args.command == "inspect":
            print(workflow.inspect(project)["snapshot_sha256"])
        elif args.command == "create":
            print(workflow.create(project, args.stage, args.factor, args.seed or [0], args.phrase, args.out))
        else:
            print(workflow.run(project, args.request, args.out))
        return 0
    spark = spark or SparkSession.builder.appName("sunloom").getOrCreate()
    if args.command == "adapter":
        workflow.adapter(spark, workflow.Project.read(args.project), args.request, args.out, args.mock)
    elif args.command == "record":
        print(workflow.record(spark, workflow.Project.read(args.project), args.request, args.result))
    elif args.command == "catalog":
        problems = workflow.catalog_report(spark)
        print("\n".join(problems) or "the catalog is sound")
        return 1 if problems else 0
    else:
        print(workflow.demo(spark, args.out, args.factor or ("factor.power.multiscale-ramp",), args.seed or (0,), args.mode)["overall"])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "evaluate" and args.role == "test" and args.phrase != forecast.FINAL_TEST_PHRASE:
        raise DataError(f"opening the test split needs --phrase '{forecast.FINAL_TEST_PHRASE}'")
    if args.command not in ("train", "evaluate", "predict", "stations"):
        return _workflow(args, spark)
    spark = spark or SparkSession.builder.appName("sunloom").getOrCreate()
    if args.command == "train":
        print(forecast.train(spark, args.config, args.data, args.seed, args.factor, args.out)["folder"])
    elif args.command == "evaluate":
        result = forecast.evaluate(spark, args.run, args.config, args.data, args.role)
        result["predictions"].write.parquet(f"{args.out}/predictions")
        forecast.write_tables(result["tables"], f"{args.out}/metrics")
    elif args.command == "predict":
        forecast.predict(spark, args.run, args.config, args.data).write.parquet(args.out)
    else:
        print(forecast.station_report(spark, args.config, args.data))
    return 0


if __name__ == "__main__":
    sys.exit(main())
