"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import arrays as A
from sunloom.operators import checks, features, fingerprints, metrics, model, pairing, preprocessing, splits
from sunloom.operators.factors import add_factors
from sunloom.operators.factors.base import STEP, Inputs
from sunloom.operators.factors.registry import REGISTRY, column_name, finite_shares, output_names, stage_helpers
from sunloom.operators.factors.series import FACTORS as SERIES
from sunloom.settings import Settings, default_config, load_settings
from sunloom.sources import sites, stations
from sunloom.sources.synthetic import origins_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CAPACITY = 50.0
NUDGE = 1e-9
SITE = (500.0, 121.5, 31.2)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats to a fixed number of digits, without negative zero. The nudge keeps exact ties on one side in both engines."""
    return df.select(*[(F.round(F.col(f"`{n}`").cast("double") + NUDGE, digits) + 0.0).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def r(expression: str, name: str) -> str:
    return f'round(({expression}) + 1e-9, 6) + 0.0 AS "{name}"'


def settings_for(**features_: object) -> Settings:
    config = default_config()
    config["features"] |= features_
    config["split"] |= {
        "train_start": "2024-01-02", "train_end": "2024-01-20 23:59:59", "validation_start": "2024-01-21", "validation_end": "2024-01-25 23:59:59",
        "test_start": "2024-01-26", "test_end": "2024-01-30 23:59:59", "test_stations": ["click", "purchase"],
    }
    config["evaluation"]["score_capacity"] = CAPACITY
    return load_settings(config)


# Predictions shaped from lineitem ------------------------------------------------------------------------------------

PREDICTIONS_SQL = """
WITH p AS (
  SELECT l_orderkey || '-' || l_linenumber AS row_id, CAST(l_suppkey AS VARCHAR) AS station_id, l_shipdate AS t, CAST(1 + l_orderkey % 16 AS INTEGER) AS h,
    l_linenumber AS seed, l_quantity AS y, l_quantity * (1 - l_discount) AS b, l_quantity * (1 - l_discount * l_tax) AS c
  FROM lineitem
)"""


def predictions(spark: SparkSession, sf_dir: str, candidate: bool = False) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    factor = F.col("l_discount") * F.col("l_tax") if candidate else F.col("l_discount")
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.col("l_suppkey").cast("string").alias("station_id"), F.lit("lineitem").alias("source_file"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_shipdate").alias("target_timestamp"), (1 + F.col("l_orderkey") % 16).cast("int").alias(STEP),
        F.col("l_quantity").alias("groundtruth"), (F.col("l_quantity") * (1 - factor)).alias("prediction"), F.col("l_linenumber").cast("int").alias("seed"),
    )


def _metric_sql(prefix: str = "", p: str = "b") -> str:
    e = f"({p} - y)"
    rmse = f"sqrt(avg({e} * {e}))"
    parts = (("rmse", rmse), ("mae", f"avg(abs({e}))"), ("bias", f"avg({e})"), ("nrmse", f"{rmse} / {CAPACITY}"), ("capacity_score", f"1.0 - {rmse} / {CAPACITY}"))
    return ", ".join(r(x, prefix + n) for n, x in parts)


@query("horizon_metrics", f"{PREDICTIONS_SQL} SELECT h AS horizon_step, {_metric_sql()}, count(*) AS sample_count, count(DISTINCT station_id) AS station_count FROM p GROUP BY h")
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_horizon(predictions(spark, sf_dir), CAPACITY))


@query("station_metrics", f"{PREDICTIONS_SQL} SELECT h AS horizon_step, station_id, {_metric_sql()}, count(*) AS sample_count FROM p GROUP BY h, station_id")
def station_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_station(predictions(spark, sf_dir), CAPACITY))


STATION_CTE = """, s AS (SELECT h, station_id, sqrt(avg((b - y) * (b - y))) AS rmse, avg(abs(b - y)) AS mae, avg(b - y) AS bias FROM p GROUP BY h, station_id)"""


@query(
    "station_macro",
    f"""{PREDICTIONS_SQL}{STATION_CTE} SELECT h AS horizon_step, count(*) AS station_count, {r("avg(rmse)", "mean_rmse")}, {r("avg(mae)", "mean_mae")}, {r("avg(abs(bias))", "mean_absolute_bias")},
    {r(f"avg(1 - rmse / {CAPACITY})", "mean_capacity_score")}, {r("max(rmse)", "worst_rmse")}, {r(f"min(1 - rmse / {CAPACITY})", "worst_capacity_score")} FROM s GROUP BY h""",
)
def station_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.station_macro(metrics.by_station(predictions(spark, sf_dir), CAPACITY)))


@query("daily_metrics", f"{PREDICTIONS_SQL} SELECT h AS horizon_step, station_id, CAST(t AS DATE) AS date, {_metric_sql()}, count(*) AS sample_count FROM p GROUP BY ALL")
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.daily(predictions(spark, sf_dir), CAPACITY))


MONTH_CTE = f"""
, d AS (SELECT h, station_id, CAST(t AS DATE) AS date, sqrt(avg((b - y) * (b - y))) AS rmse, avg(abs(b - y)) AS mae, avg(b - y) AS bias FROM p GROUP BY ALL)
, m AS (SELECT h, station_id, CAST(month(date) AS INTEGER) AS month, count(*) AS n, avg(rmse) AS rmse, avg(mae) AS mae, avg(bias) AS bias, 1 - avg(rmse) / {CAPACITY} AS score FROM d GROUP BY ALL)"""


@query(
    "monthly_metrics",
    f"""{PREDICTIONS_SQL}{MONTH_CTE} SELECT h AS horizon_step, station_id, month, n AS day_count, {r("rmse", "mean_daily_rmse")}, {r("mae", "mean_daily_mae")}, {r("bias", "mean_daily_bias")}, {r("score", "monthly_capacity_score")} FROM m""",
)
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.monthly(metrics.daily(predictions(spark, sf_dir), CAPACITY), CAPACITY))


@query(
    "monthly_summary",
    f"""{PREDICTIONS_SQL}{MONTH_CTE} SELECT h AS horizon_step, station_id, count(*) AS month_count, {r("avg(score)", "mean_monthly_capacity_score")}, {r("min(score)", "worst_monthly_capacity_score")} FROM m GROUP BY ALL""",
)
def monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.monthly_summary(metrics.monthly(metrics.daily(predictions(spark, sf_dir), CAPACITY), CAPACITY)))


POOLED_SQL = f"""
, d AS (SELECT h, CAST(t AS DATE) AS date, sqrt(avg((b - y) * (b - y))) AS rmse FROM p GROUP BY ALL)
, m AS (SELECT h, month(date) AS month, 1 - avg(rmse) / {CAPACITY} AS score FROM d GROUP BY ALL)"""


@query(
    "pooled_monthly_score",
    f"""{PREDICTIONS_SQL}{POOLED_SQL} SELECT h AS horizon_step, {r("avg(score)", "mean_monthly_capacity_score")}, {r("min(score)", "worst_monthly_capacity_score")}, count(*) AS month_count FROM m GROUP BY h""",
)
def pooled_monthly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pooled_monthly(predictions(spark, sf_dir), CAPACITY))


@query(
    "horizon_with_primary_score",
    f"""{PREDICTIONS_SQL}{POOLED_SQL}, k AS (SELECT h, count(*) AS sample_count FROM p GROUP BY h), q AS (SELECT h, avg(score) AS s FROM m GROUP BY h)
    SELECT h AS horizon_step, sample_count, {r("s", "mean_monthly_capacity_score")} FROM k LEFT JOIN q USING (h)""",
)
def horizon_with_primary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return rounded(metrics.with_primary_score(metrics.by_horizon(p, CAPACITY), metrics.pooled_monthly(p, CAPACITY)).select(STEP, "sample_count", "mean_monthly_capacity_score"))


@query(
    "evaluation_rollup",
    f"""{PREDICTIONS_SQL}{POOLED_SQL}, q AS (SELECT h, avg(score) AS s FROM m GROUP BY h), a AS (SELECT h AS horizon_step, {_metric_sql()}, count(DISTINCT station_id) AS station_count, count(*) AS sample_count FROM p GROUP BY h)
    SELECT a.*, {r("q.s", "mean_monthly_capacity_score")} FROM a JOIN q ON q.h = a.horizon_step""",
)
def evaluation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon table of a whole evaluation, which rolls all tables up from daily sums."""
    return rounded(metrics.evaluate(predictions(spark, sf_dir), CAPACITY)["horizon_metrics"])


@query(
    "horizon_groups",
    f"""{PREDICTIONS_SQL} SELECT CASE WHEN h * 15 <= 60 THEN '0_1h' WHEN h * 15 <= 120 THEN '1_2h' ELSE '2_4h' END AS horizon_group, {_metric_sql()}, count(*) AS sample_count, count(DISTINCT station_id) AS station_count, min(h) AS first_step FROM p GROUP BY 1""",
)
def horizon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_horizon_group(predictions(spark, sf_dir), CAPACITY))


@query(
    "seed_summary",
    f"""{PREDICTIONS_SQL}, s AS (SELECT h, seed, sqrt(avg((b - y) * (b - y))) AS rmse, avg(b - y) AS bias FROM p GROUP BY ALL)
    SELECT h AS horizon_step, count(*) AS seed_count, {r("avg(rmse)", "rmse_mean")}, {r("stddev_pop(rmse)", "rmse_std")}, {r("avg(bias)", "bias_mean")}, {r("stddev_pop(bias)", "bias_std")} FROM s GROUP BY h""",
)
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.error()
    each = predictions(spark, sf_dir).groupBy(STEP, "seed").agg(metrics.rmse(e).alias("rmse"), F.avg(e).alias("bias"))
    return rounded(metrics.seed_summary(each, [STEP]))


@query(
    "best_epoch",
    f"""{PREDICTIONS_SQL}, e AS (SELECT h, seed AS epoch, round(sqrt(avg((b - y) * (b - y))), 1) AS rmse FROM p GROUP BY ALL)
    SELECT h AS horizon_step, CAST(first(epoch ORDER BY rmse, epoch) AS INTEGER) AS best_epoch, {r("min(rmse)", "best_rmse")} FROM e GROUP BY h""",
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.error()
    history = predictions(spark, sf_dir).groupBy(STEP, F.col("seed").alias("epoch")).agg(F.round(metrics.rmse(e), 1).alias("rmse"))
    return rounded(metrics.best_epoch(history, [STEP]))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides with their seeds, joined on all keys and the seed."""
    keys = [*pairing.KEYS, "seed"]
    joined = pairing.outer(predictions(spark, sf_dir), predictions(spark, sf_dir, True), keys)
    return joined.where("indicator = 'both'").withColumnRenamed("groundtruth_baseline", "groundtruth").withColumn("month", F.month("target_timestamp").cast("int"))


def _compare_sql(grouping: str, keys: tuple[str, ...]) -> str:
    own = {"horizon_step": "h", "station_id": "station_id", "month": "CAST(month(t) AS INTEGER)", "seed": "CAST(seed AS INTEGER)"}
    key = own.get(grouping, "1")
    shown = ", ".join(f"{'k' if n == grouping else 'CAST(NULL AS ' + ('VARCHAR' if n == 'station_id' else 'INTEGER') + ')'} AS {n}" for n in keys)
    names = ("rmse", "mae", "bias", "nrmse", "capacity_score", "mean_monthly_capacity_score")
    side = lambda s: f"sqrt(avg(({s} - y) * ({s} - y)))"
    values = lambda s: (side(s), f"avg(abs({s} - y))", f"avg({s} - y)", f"{side(s)} / {CAPACITY}", f"1 - {side(s)} / {CAPACITY}")
    plain = ", ".join(f"{v} AS {s}_{n}" for s in "bc" for v, n in zip(values(s), names, strict=False))
    out = ", ".join([r(f"b_{n}", f"baseline_{n}") for n in names] + [r(f"c_{n}", f"candidate_{n}") for n in names] + [r(f"c_{n} - b_{n}", f"delta_{n}") for n in names])
    return f"""SELECT '{grouping}' AS "grouping", {shown}, sample_count, {out} FROM (
      SELECT {key} AS k, count(*) AS sample_count, {plain} FROM p GROUP BY 1) x JOIN (
      SELECT k, 1 - avg(bb) / {CAPACITY} AS bm, 1 - avg(cc) / {CAPACITY} AS cm, mon FROM (
        SELECT {key} AS k, CAST(t AS DATE) AS d, month(CAST(t AS DATE)) AS mon, {side("b")} AS bb, {side("c")} AS cc FROM p GROUP BY 1, 2, 3) GROUP BY k, mon) z USING (k)"""


def compare_sql() -> str:
    keys = ("horizon_step", "station_id", "month", "seed")
    parts = []
    for g in ("", *keys):
        body = _compare_sql(g, keys)
        # The monthly level is one row per month; average it before the join.
        body = body.replace("JOIN (\n      SELECT k, 1 - avg(bb)", "JOIN (\n      SELECT k, avg(bm) AS b_mean_monthly_capacity_score, avg(cm) AS c_mean_monthly_capacity_score FROM (SELECT k, 1 - avg(bb)").replace("GROUP BY k, mon) z", "GROUP BY k, mon) GROUP BY k) z")
        parts.append(body)
    return f"{PREDICTIONS_SQL} " + " UNION ALL ".join(parts)


@query("paired_compare", compare_sql())
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.compare(paired(spark, sf_dir), CAPACITY))


@query(
    "paired_rmse_by_seed",
    f"""{PREDICTIONS_SQL}, s AS (SELECT seed, h, count(*) AS n, sqrt(avg((b - y) * (b - y))) AS b, sqrt(avg((c - y) * (c - y))) AS c FROM p GROUP BY ALL)
    SELECT CAST(seed AS INTEGER) AS seed, h AS horizon_step, n AS sample_count, {r("b", "baseline_rmse")}, {r("c", "candidate_rmse")}, {r("c - b", "delta_rmse")} FROM s""",
)
def paired_rmse_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.rmse_by_seed_and_step(paired(spark, sf_dir)))


@query(
    "station_macro_delta",
    f"""{PREDICTIONS_SQL}, s AS (SELECT station_id, sqrt(avg((b - y) * (b - y))) AS b, sqrt(avg((c - y) * (c - y))) AS c FROM p GROUP BY 1)
    SELECT count(*) AS station_count, {r("avg(b)", "baseline_mean_rmse")}, {r("avg(c)", "candidate_mean_rmse")}, {r("avg(c - b)", "mean_delta_rmse")}, {r("avg(CASE WHEN c < b THEN 1.0 ELSE 0.0 END)", "improved_station_ratio")}, {r("max(c - b)", "worst_delta_rmse")} FROM s""",
)
def station_macro_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.station_macro_delta(pairing.compare(paired(spark, sf_dir), CAPACITY, [("station_id",)])))


@query(
    "pair_indicator",
    f"""{PREDICTIONS_SQL}, a AS (SELECT DISTINCT row_id, seed FROM p WHERE h <> 3), z AS (SELECT DISTINCT row_id, seed FROM p WHERE h <> 5)
    SELECT CASE WHEN z.row_id IS NULL THEN 'left_only' WHEN a.row_id IS NULL THEN 'right_only' ELSE 'both' END AS "indicator", count(*) AS n FROM a FULL JOIN z ON a.row_id = z.row_id AND a.seed = z.seed GROUP BY 1""",
)
def pair_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [predictions(spark, sf_dir, c).where(F.col(STEP) != h).dropDuplicates(["row_id", "seed"]) for c, h in ((False, 3), (True, 5))]
    return pairing.indicator_counts(pairing.outer(*sides, keys=["row_id", "seed"]))


# Rows, keys, sets --------------------------------------------------------------------------------------------------


@query("dup_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("intersect_row_ids", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def intersect_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return spark.createDataFrame([(checks.overlap(table(spark, sf_dir, "orders"), big, "o_orderkey"),)], "n long")


@query("unseen_stations", "SELECT CAST(c_custkey AS VARCHAR) AS station_id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice > 300000")
def unseen_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t, c: table(spark, sf_dir, t).select("*", F.col(c).cast("string").alias("station_id"))
    return checks.missing_keys(ids("customer", "c_custkey"), ids("orders", "o_custkey").where("o_totalprice > 300000"), "station_id")


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("station_id"), (F.abs("s_acctbal") + 1.0).alias("site_capacity"), (F.col("s_suppkey") % 180).cast("double").alias("site_longitude"),
        (F.col("s_suppkey") % 90).cast("double").alias("site_latitude"), F.lit("Asia/Shanghai").alias("site_timezone"),
    )


SITES_SQL = """WITH s AS (SELECT 's' || s_nationkey AS station_id, abs(s_acctbal) + 1.0 AS site_capacity, CAST(s_suppkey % 180 AS DOUBLE) AS site_longitude, CAST(s_suppkey % 90 AS DOUBLE) AS site_latitude, 'Asia/Shanghai' AS site_timezone FROM supplier)"""


@query("distinct_metadata", f"{SITES_SQL} SELECT DISTINCT * FROM s")
def distinct_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_sites(spark, sf_dir)
    return stations.distinct_sites(rows.unionByName(rows).withColumn("source_file", F.lit("twice")))


@query("metadata_conflicts", f"{SITES_SQL} SELECT station_id, count(DISTINCT (site_capacity, site_longitude, site_latitude)) AS n_records FROM s GROUP BY 1 HAVING count(DISTINCT (site_capacity, site_longitude, site_latitude)) > 1")
def metadata_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.conflicts(supplier_sites(spark, sf_dir))


@query(
    "metadata_override",
    f"""{SITES_SQL} SELECT station_id, {r("site_capacity", "site_capacity")}, site_longitude, site_latitude, site_timezone FROM s WHERE station_id NOT IN ('s1', 's2')
    UNION ALL SELECT * FROM (VALUES ('s1', 10.0::DOUBLE, 100.0::DOUBLE, 30.0::DOUBLE, 'Asia/Shanghai'), ('s2', 20.0, 110.0, 31.0, 'Asia/Shanghai'))""",
)
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("s1", 10.0, 100.0, 30.0, "Asia/Shanghai"), ("s2", 20.0, 110.0, 31.0, "Asia/Shanghai")], sites.SITES)
    return rounded(sites.replace_sites(supplier_sites(spark, sf_dir), own))


@query(
    "metadata_left_join",
    """SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS station_id, round(abs(s_acctbal) + 1.0, 6) AS site_capacity, n_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    meta = s.select(F.col("s_suppkey").cast("string").alias("station_id"), (F.abs("s_acctbal") + 1.0).alias("site_capacity"), "n_name", F.lit(0.0).alias("site_longitude"), F.lit(0.0).alias("site_latitude"), F.lit("Asia/Shanghai").alias("site_timezone"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("station_id"))
    return rounded(sites.attach(rows, meta).select("l_orderkey", "l_linenumber", "station_id", "site_capacity", "n_name"))


@query("metadata_missing", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS station_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def metadata_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("station_id"))
    return checks.missing_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("station_id")), have, "station_id")


@query("issue_time_violations", "SELECT l_orderkey, l_linenumber, l_shipdate AS origin, o_orderdate AS issued FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def issue_time_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairing.issued_late(j.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("origin"), F.col("o_orderdate").alias("issued")), "issued", "origin")


@query("label_standard", f"SELECT {r('avg(l_extendedprice)', 'center')}, {r('stddev_pop(l_extendedprice)', 'scale')} FROM lineitem")
def label_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = default_config()
    config["model"]["label_normalization"] = "standard"
    found = preprocessing.fit_labels(table(spark, sf_dir, "lineitem"), Settings(config), "l_extendedprice")
    return rounded(spark.createDataFrame([(found.center, found.scale)], "center double, scale double"))


@query("quantile_knots", f"SELECT i / 10.0 AS p, {r('quantile_cont(l_extendedprice, i / 10.0)', 'price')}, {r('quantile_cont(l_quantity, i / 10.0)', 'quantity')} FROM lineitem, range(0, 11) t(i) GROUP BY i".replace("quantile_cont(l_extendedprice, i / 10.0)", "list_extract(quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]), i + 1)").replace("quantile_cont(l_quantity, i / 10.0)", "list_extract(quantile_cont(l_quantity, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]), i + 1)").replace("i / 10.0 AS p", "CAST(i AS DOUBLE) / 10 AS p"))
def quantile_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.array("l_extendedprice", "l_quantity").alias("v"))
    fitted = preprocessing.fit_quantiles(rows, F.col("v"), ["price", "quantity"], {"noise_std": 0.0, "min_quantiles": 11, "max_quantiles": 11})
    return rounded(spark.createDataFrame([(i / 10, *map(float, v)) for i, v in enumerate(fitted.values)], "p double, price double, quantity double"))


@query("file_fingerprint")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, bytes and SHA-256 of two table files. No SQL: a query engine's views hide the files."""
    return fingerprints.file_hashes(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"])


@query("row_hash", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS digest FROM orders")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fingerprints.row_hash(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("digest"))


@query("set_fingerprint")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.set_fingerprint(table(spark, sf_dir, "orders"))


@query(
    "ratio_restore",
    f"""WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS row_id, CAST(least(greatest(l_quantity * (1 - l_discount) / 40, 0), 1.2) AS FLOAT) AS ratio, 400 + l_suppkey % 7 AS cap, l_quantity AS y FROM lineitem)
    SELECT row_id, {r("CAST(ratio AS DOUBLE)", "prediction_ratio")}, {r("CAST(CAST(CAST(ratio AS DOUBLE) * cap AS FLOAT) AS DOUBLE)", "prediction")}, {r("y", "groundtruth")} FROM x""",
)
def ratio_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.col("l_suppkey").cast("string").alias("station_id"), F.lit("lineitem").alias("source_file"), F.col("l_shipdate").alias("timestamp"), F.lit(0).alias("occurrence"),
        F.col("l_shipdate").alias("target_timestamp"), F.lit(16).alias(STEP), (F.lit(400.0) + F.col("l_suppkey") % 7).alias("capacity"), F.col("l_quantity").alias("target_power"), F.col("l_quantity").alias("target_ratio"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) / 40).alias("raw_prediction"),
    )
    return rounded(model.restore(rows, preprocessing.LabelScale("none")).select("row_id", "prediction_ratio", "prediction", "groundtruth"))


# Array functions over embeddings -----------------------------------------------------------------------------------

SHORT = {f.id: f for f in SERIES}


def _array_query(name: str, factor_id: str, sql: str, keep: tuple[str, ...] | None = None) -> None:
    @query(name, f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT vec_id, {sql} FROM e")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("Power"))
        factor, inputs = REGISTRY[factor_id], Inputs(settings_for())
        rows, built = stage_helpers(rows, [factor], inputs), factor.build(inputs)
        return rounded(rows.select("vec_id", *[built[k].alias(k) for k in built if keep is None or k in keep]))


def _slope_sql(a: str, w: int) -> str:
    return f"list_sum(list_transform({a}[-{w}:], lambda y, i: (i - 1 - {(w - 1) / 2}) * y)) / {w * (w * w - 1) / 12}"


def _absdiff_sql(a: str, w: int) -> str:
    return f"list_avg(list_transform(range(1, {w}), lambda i: abs({a}[-i] - {a}[-i - 1])))"


def _series_sql(a: str) -> dict[str, str]:
    """SQL of the power-history factors for the array expression ``a``."""
    runs = f"list_reduce(list_prepend([1, 1], list_transform(range(2, len({a}) + 1), lambda i: [CASE WHEN abs({a}[i] - {a}[i - 1]) <= 1e-9 THEN 1 ELSE 0 END, 0])), lambda s, x: [CASE WHEN x[1] = 1 THEN s[1] + 1 ELSE 1 END, greatest(s[2], CASE WHEN x[1] = 1 THEN s[1] + 1 ELSE 1 END)])[2]"
    return {
        "factor.power.multiscale-ramp": ", ".join(r(f"{a}[-1] - {a}[-{1 + w}]", f"power_ramp_{w}") for w in (1, 2, 4, 8, 16)),
        "factor.power.multiscale-slope": ", ".join(r(_slope_sql(a, w), f"power_slope_{w}") for w in (2, 4, 8, 16)),
        "factor.power.variability": ", ".join(
            f"{r(f'list_stddev_pop({a}[-{w}:])', f'power_std_{w}')}, {r(_absdiff_sql(a, w), f'power_absdiff_{w}')}, {r(f'list_max({a}[-{w}:]) - list_min({a}[-{w}:])', f'power_range_{w}')}" for w in (2, 4, 8, 16)
        ),
        "factor.power.acceleration": ", ".join(r(f"({a}[-1] - {a}[-{1 + s}]) - ({a}[-{1 + s}] - {a}[-{1 + 2 * s}])", f"power_acceleration_{s}") for s in (1, 2, 4)),
        "factor.quality.stuck-shift-score": f"{r(f'{runs} / CAST(len({a}) AS DOUBLE)', 'stuck_longest_fraction')}, {r(f'list_avg(list_transform(range(2, len({a}) + 1), lambda i: abs({a}[i] - {a}[i - 1])))', 'mean_absolute_step')}",
    }


for _name, _id in (("array_ramp", "multiscale-ramp"), ("array_slope", "multiscale-slope"), ("array_variability", "variability"), ("array_acceleration", "acceleration")):
    _array_query(_name, f"factor.power.{_id}", _series_sql("a")[f"factor.power.{_id}"])
_array_query("array_stuck", "factor.quality.stuck-shift-score", _series_sql("a")["factor.quality.stuck-shift-score"])
_array_query("array_lags", "factor.power.multiscale-lags", ", ".join(r(f"a[-{k}]", f"power_lag_{k}") for k in (1, 2, 4, 8, 16)), tuple(f"power_lag_{k}" for k in (1, 2, 4, 8, 16)))


@query(
    "coverage_finite_fraction",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
    x AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 'nan'::DOUBLE ELSE a[1] END AS first, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE a[2] END AS second, a[3] AS third FROM e)
    SELECT 'first' AS name, count(*) FILTER (NOT isfinite(first)) AS n_bad, {r("avg(CASE WHEN isfinite(first) THEN 1.0 ELSE 0.0 END)", "finite_share")} FROM x
    UNION ALL SELECT 'second', count(*) FILTER (second IS NULL OR NOT isfinite(second)), {r("avg(CASE WHEN isfinite(second) THEN 1.0 ELSE 0.0 END)", "finite_share")} FROM x
    UNION ALL SELECT 'third', count(*) FILTER (NOT isfinite(third)), {r("avg(CASE WHEN isfinite(third) THEN 1.0 ELSE 0.0 END)", "finite_share")} FROM x""",
)
def coverage_finite_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(e[0]).alias("first"), F.when(F.col("vec_id") % 11 != 0, e[1]).alias("second"), e[2].alias("third")
    )
    return rounded(finite_shares(rows, ["first", "second", "third"]))


# Origin rows from events -------------------------------------------------------------------------------------------

ORIGINS_SQL = """
WITH g AS (SELECT * FROM (SELECT DISTINCT event_type AS station FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTES)) AS slot)),
b AS (SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2024-01-01') AS slot, sum(value) AS p FROM events GROUP BY 1, 2),
d AS (SELECT g.station, g.slot, CAST(coalesce(b.p, 0) AS FLOAT) AS p, (day(g.slot) - 1) * 96 + hour(g.slot) * 4 + CAST(floor(minute(g.slot) / 15e0) AS INT) AS idx,
  CAST(greatest(0e0, 1000e0 * (1e0 - ((hour(g.slot) * 60 + minute(g.slot) - 720) / 360e0) * ((hour(g.slot) * 60 + minute(g.slot) - 720) / 360e0))) AS FLOAT) AS irr
  FROM g LEFT JOIN b ON g.station = b.station AND g.slot = b.slot),
e AS (SELECT *, CAST(16e0 + 12e0 * irr / 1000e0 AS FLOAT) AS temp, CAST(25e-1 + 25e-2 * (idx % 7) AS FLOAT) AS ws, CAST((160 + 5 * (idx % 40)) % 360 AS FLOAT) AS wd,
  CASE WHEN idx % 97 = 0 THEN 0e0 ELSE 400e0 + (idx % 5) END AS cap FROM d),
a AS (SELECT station, slot, cap, list(p) OVER h AS pw, list(irr) OVER h AS gh, list(p) OVER f AS fut, list(irr) OVER f AS ghi, list(temp) OVER f AS temp, list(ws) OVER f AS ws, list(wd) OVER f AS wd FROM e
  WINDOW h AS (PARTITION BY station ORDER BY slot ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY station ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING)),
kept AS (SELECT * FROM a WHERE len(pw) = 96 AND len(fut) = 16),
pv AS (SELECT station, slot, CAST(slot AS VARCHAR) AS origin, CAST(pw AS DOUBLE[]) AS p, CAST(gh AS DOUBLE[]) AS g, CAST(fut AS DOUBLE[]) AS y, CAST(ghi AS DOUBLE[]) AS ghi, CAST(temp AS DOUBLE[]) AS temp,
  CAST(ws AS DOUBLE[]) AS ws, CAST(wd AS DOUBLE[]) AS wd, max(CASE WHEN cap > 0 THEN cap END) OVER (PARTITION BY station) AS cap FROM kept)"""


def origins(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    """Checked origin rows with a site for every station."""
    raw = origins_from_events(table(spark, sf_dir, "events")).withColumn("row_order", F.lit(0).cast("long")).withColumn("source_file", F.col("station"))
    rows = stations.with_capacity(stations.annotate(raw, settings), settings)
    # Few bytes but much arithmetic for each row: spread by station and origin, which also serves the occurrence window.
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "station_id", "timestamp")
    return rows.withColumns({"site_capacity": F.lit(SITE[0]), "site_longitude": F.lit(SITE[1]), "site_latitude": F.lit(SITE[2]), "site_timezone": F.lit("Asia/Shanghai")})


def feature_rows(spark: SparkSession, sf_dir: str, settings: Settings, ids: tuple[str, ...] = ()) -> DataFrame:
    return features.build(origins(spark, sf_dir, settings), settings, True, ids)


def origin_text() -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("origin")


@query("capacity_max_positive", f"{ORIGINS_SQL} SELECT station AS station_id, CAST(max(cap) AS DOUBLE) AS capacity, count(*) AS n FROM pv GROUP BY 1")
def capacity_max_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(spark, sf_dir, settings_for()).groupBy("station_id").agg(F.max("capacity").cast("double").alias("capacity"), F.count(F.lit(1)).alias("n"))


def _base_sql(h: str) -> str:
    f32 = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    return f"""{r(f32(f"ghi[{h}]"), "ghi_target")}, {r(f32(f"temp[{h}]"), "temperature_target")}, {r(f32(f"ws[{h}]"), "wind_speed_target")}, {r(f32(f"wd[{h}]"), "wind_direction_target")},
    {r(f32("p[-1] / cap"), "power_lag_1")}, {r(f32("p[-96] / cap"), "power_lag_96")}, {r(f32("p[-2] / cap"), "power_lag_2")}, {r(f32("p[-48] / cap"), "power_lag_48")},
    {r(f32(f"y[{h}]"), "target_power")}, {r(f32(f"y[{h}] / cap"), "target_ratio")}"""


@query(
    "base_features_h16",
    f"""{ORIGINS_SQL} SELECT station || '__' || strftime(slot, '%Y-%m-%dT%H:%M:%S.%f') || '__n0__h16' AS row_id, {_base_sql("16")}, CAST(hour(slot + INTERVAL 240 MINUTES) AS INTEGER) AS predict_hour, CAST(month(slot + INTERVAL 240 MINUTES) AS INTEGER) AS predict_month FROM pv""",
)
def base_features_h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = settings_for()
    wide = features.wide(feature_rows(spark, sf_dir, settings), settings)
    names = dict(zip(settings.weather, ("ghi", "temperature", "wind_speed", "wind_direction"), strict=True))
    return rounded(wide.select("row_id", *[F.col(f"{c}_target").alias(f"{n}_target") for c, n in names.items()], "power_lag_1", "power_lag_2", "power_lag_48", "power_lag_96", "target_power", "target_ratio", "predict_hour", "predict_month"))


@query(
    "curve_targets",
    f"""{ORIGINS_SQL} SELECT station AS station_id, origin, CAST(h AS INTEGER) AS horizon_step, {r("CAST(CAST(y[h] / cap AS FLOAT) AS DOUBLE)", "target_ratio")}, CAST(hour(slot + h * INTERVAL 15 MINUTES) AS INTEGER) AS predict_hour FROM pv, range(1, 17) t(h)""",
)
def curve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_rows(spark, sf_dir, settings_for(prediction_mode="curve")).select("station_id", origin_text(), STEP, "target_ratio", "predict_hour"))


@query("row_ids", f"""{ORIGINS_SQL} SELECT station || '__' || strftime(slot, '%Y-%m-%dT%H:%M:%S.%f') || '__n0__h' || lpad(CAST(h AS VARCHAR), 2, '0') AS row_id FROM pv, (VALUES (1), (4), (16)) t(h)""")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir, settings_for(prediction_mode="curve", horizons=[16, 1, 4])).select("row_id")


@query(
    "occurrences",
    f"""{ORIGINS_SQL}, z AS (SELECT *, 0 AS n FROM pv UNION ALL SELECT *, 1 AS n FROM pv WHERE minute(slot) < 30 UNION ALL SELECT *, 2 AS n FROM pv WHERE minute(slot) = 0)
    SELECT station || '__' || strftime(slot, '%Y-%m-%dT%H:%M:%S.%f') || '__n' || n || '__h16' AS row_id, CAST(n AS INTEGER) AS occurrence FROM z""",
)
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that a file holds up to three times."""
    settings = settings_for()
    rows = origins(spark, sf_dir, settings)
    again = rows.where(F.minute("timestamp") < 30).withColumn("row_order", F.lit(7).cast("long"))
    third = rows.where(F.minute("timestamp") == 0).withColumn("row_order", F.lit(3).cast("long"))
    return features.build(rows.unionByName(again).unionByName(third), settings).select("row_id", "occurrence")


@query(
    "calendar",
    f"""{ORIGINS_SQL} SELECT station AS station_id, origin, CAST(slot + INTERVAL 240 MINUTES AS VARCHAR) AS target, CAST(dayofyear(slot) AS INTEGER) AS day_of_year, CAST(day(last_day(slot)) - day(slot) AS INTEGER) AS days_left FROM pv""",
)
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir, settings_for()).select(
        "station_id", origin_text(), F.date_format("target_timestamp", "yyyy-MM-dd HH:mm:ss").alias("target"), F.dayofyear("timestamp").alias("day_of_year"), (F.dayofmonth(F.last_day("timestamp")) - F.dayofmonth("timestamp")).alias("days_left")
    )


def _split_counts(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        own = df.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("first"), F.max(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("last")).withColumn("part", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def _split_sql(parts: dict[str, str]) -> str:
    return ORIGINS_SQL + " " + " UNION ALL ".join(f"SELECT station AS station_id, count(*) AS n, min(origin) AS first, max(origin) AS last, '{k}' AS part FROM pv WHERE {w} GROUP BY 1" for k, w in parts.items())


@query("split_explicit", _split_sql({"train": "slot BETWEEN '2024-01-02' AND '2024-01-20 23:59:59'", "validation": "slot BETWEEN '2024-01-21' AND '2024-01-25 23:59:59'"}))
def split_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = settings_for()
    train, validation = splits.train_validation(feature_rows(spark, sf_dir, settings), settings, check=False)
    return _split_counts({"train": train, "validation": validation})


@query("split_monthly_tail", _split_sql({"train": "slot BETWEEN '2024-01-02' AND '2024-01-30 23:59:59' AND day(last_day(slot)) - day(slot) >= 5", "validation": "slot BETWEEN '2024-01-02' AND '2024-01-30 23:59:59' AND day(last_day(slot)) - day(slot) < 5"}))
def split_monthly_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = dict(settings_for().config)
    config["split"] = dict(config["split"]) | {"train_end": "2024-01-30 23:59:59", "validation_strategy": "monthly_tail", "validation_last_days": 5, "validation_start": None, "validation_end": None}
    settings = load_settings(config)
    train, validation = splits.train_validation(feature_rows(spark, sf_dir, settings), settings, check=False)
    return _split_counts({"train": train, "validation": validation})


@query("split_test_stations", _split_sql({"test": "slot BETWEEN '2024-01-26' AND '2024-01-30 23:59:59' AND station IN ('click', 'purchase')"}))
def split_test_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = settings_for()
    return _split_counts({"test": splits.evaluation(feature_rows(spark, sf_dir, settings), settings, "test", check=False)})


@query("prediction_vector", f"{ORIGINS_SQL} SELECT station AS station_id, origin, array_to_string(list_transform([4, 8, 16], lambda h: CAST(h AS VARCHAR) || ':' || CAST(CAST(round(y[h]) AS BIGINT) AS VARCHAR)), ' ') AS vector FROM pv")
def prediction_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir, settings_for(prediction_mode="curve", horizons=[4, 8, 16])).withColumnRenamed("target_power", "prediction")
    vectors = metrics.prediction_vectors(rows)
    text = F.array_join(F.zip_with("horizon_steps", "predictions", lambda h, p: F.concat_ws(":", h.cast("string"), F.round(p.cast("double")).cast("long").cast("string"))), " ")
    return vectors.select("station_id", origin_text(), text.alias("vector"))


# Factors over origin rows ------------------------------------------------------------------------------------------


def _sun_sql(ts: str, source: str, keep: str) -> str:
    """CTEs with the solar quantities of the timestamp expression ``ts`` for each row of ``source``."""
    g = "2 * pi() / 365e0 * (dayofyear(ts) - 1 + (hour(ts) + minute(ts) / 60e0 + second(ts) / 3600e0 - 12) / 24e0)"
    return f""", u0 AS (SELECT {keep}, {ts} AS ts FROM {source}), u1 AS (SELECT *, {g} AS gm, hour(ts) * 60e0 + minute(ts) + second(ts) / 60e0 AS mins FROM u0),
    u2 AS (SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(gm) - 0.032077e0 * sin(gm) - 0.014615e0 * cos(2 * gm) - 0.040849e0 * sin(2 * gm)) AS eqt,
      0.006918e0 - 0.399912e0 * cos(gm) + 0.070257e0 * sin(gm) - 0.006758e0 * cos(2 * gm) + 0.000907e0 * sin(2 * gm) - 0.002697e0 * cos(3 * gm) + 0.00148e0 * sin(3 * gm) AS decl FROM u1),
    u3 AS (SELECT *, radians((((mins + eqt + 4 * 121.5e0 - 480) % 1440 + 1440) % 1440) / 4 - 180) AS ha, radians(31.2e0) AS la FROM u2),
    u4 AS (SELECT *, greatest(-1, least(1, sin(la) * sin(decl) + cos(la) * cos(decl) * cos(ha))) AS cz FROM u3),
    sun AS (SELECT *, 90 - degrees(acos(cz)) AS elev, CASE WHEN cz > 0 THEN 1098e0 * cz * exp(-0.059e0 / cz) ELSE 0 END AS clear FROM u4)"""


_TARGET_SUN = _sun_sql("slot + INTERVAL 240 MINUTES", "pv", "*")
_LAG_SUN = _sun_sql("slot - k * INTERVAL 15 MINUTES", "pv, unnest([{lags}]) t(k)", "station, slot, origin, p, g, cap, k")
_HEAT = "greatest(0, ghi[16]) / greatest(1e-6, 25e0 + 6.84e0 * greatest(0, ws[16]))"
_DAY = "CASE WHEN -tan(la) * tan(decl) >= 1 THEN 0e0 WHEN -tan(la) * tan(decl) <= -1 THEN 1440e0 ELSE 8 * degrees(acos(-tan(la) * tan(decl))) END"
_NOON = "(720 - 4 * 121.5e0 - eqt + 480)"
_WEATHER_SQL = (("GHI_SOLARGIS_predict", "ghi"), ("TEMP_SOLARGIS_predict", "temp"), ("WS_SOLARGIS_predict", "ws"), ("WD_SOLARGIS_predict", "wd"))


def _change_sql(role: str, c: str) -> str:
    anchor = "g[-1]" if role == "ghi" else f"{c}[1]"
    parts = (("target_change_from_anchor", f"{c}[16] - {anchor}"), ("target_step_change", f"{c}[16] - {c}[15]"), ("prefix_slope", f"({c}[16] - {c}[1]) / 15"), ("prefix_mean", f"list_avg({c})"), ("prefix_std", f"list_stddev_pop({c})"), ("prefix_range", f"list_max({c}) - list_min({c})"))
    return ", ".join(r(x, f"{role}_{n}") for n, x in parts)


def _finite_sql(c: str) -> str:
    return f"len(list_filter({c}, lambda x: isfinite(x)))"


def _factor_sql() -> dict[str, str]:
    """Of each factor (CTEs after the origins, source, columns)."""
    site = "CAST(500 AS DOUBLE)"
    ratio = "CASE WHEN clear < 20 THEN 0e0 ELSE greatest(0e0, least(2e0, {x})) END"
    plain = {k: ("", "pv", v) for k, v in _series_sql("p").items()}
    csi = "ghi[16] / greatest(clear, 1e-6)"
    lag4 = [1, 4, 16, 96]
    return plain | {
        "factor.power.multiscale-lags": ("", "pv", ", ".join(r(f"p[-{k}]", f"power_lag_{k}") for k in (1, 2, 4, 8, 16, 96))),
        "factor.quality.future-weather-coverage": ("", "pv", ", ".join(f'{r(f"{_finite_sql(c)} / 16e0", f"{n}_coverage")}, {r(f"least(len({c}), 16) / 16e0", f"{n}_length_ratio")}' for n, c in _WEATHER_SQL) + ", " + r("(" + " + ".join(_finite_sql(c) for _, c in _WEATHER_SQL) + ") / 64e0", "future_weather_joint_coverage")),
        "factor.power.capacity-ratio": ("", "pv", ", ".join(r(f"p[-{k}] / {site}", f"power_capacity_ratio_lag_{k}") for k in lag4)),
        "factor.power.previous-day-profile": ("", "pv", r("p[-96 + 16]", "previous_day_same_target_power")),
        "factor.weather.future-change": ("", "pv", ", ".join(_change_sql(n, c) for n, c in (("ghi", "ghi"), ("temperature", "temp"), ("wind_speed", "ws")))),
        "factor.solar.position": (_TARGET_SUN, "sun", ", ".join((r("elev", "solar_elevation_degrees"), r("degrees(acos(cz))", "solar_zenith_degrees"), r("((degrees(atan2(sin(ha), cos(ha) * sin(la) - tan(decl) * cos(la))) + 180) % 360 + 360) % 360", "solar_azimuth_degrees"), r("greatest(0, cz)", "solar_cos_zenith"), r("eqt", "equation_of_time_minutes"), r("decl", "solar_declination_radians")))),
        "factor.solar.daylight-boundary": (_TARGET_SUN, "sun", ", ".join((r(f"mins - ({_NOON} - ({_DAY}) / 2)", "minutes_since_sunrise"), r(f"{_NOON} + ({_DAY}) / 2 - mins", "minutes_until_sunset"), r(_DAY, "daylight_duration_minutes"), r(f"greatest(0, least(1, (mins - ({_NOON} - ({_DAY}) / 2)) / ({_DAY})))", "daylight_progress"), r("CASE WHEN elev > 0 THEN 1e0 ELSE 0e0 END", "is_daylight")))),
        "factor.solar.clear-sky-irradiance": (_TARGET_SUN, "sun", f'{r("clear", "clear_sky_ghi")}, {r("clear / 1000", "clear_sky_ghi_normalized")}'),
        "factor.weather.clear-sky-index-forecast": (_TARGET_SUN, "sun", ", ".join((r(f"CASE WHEN clear >= 20 THEN greatest(0e0, least(1.5e0, {csi})) ELSE 0e0 END", "forecast_clear_sky_index"), r("CASE WHEN clear >= 20 THEN 1e0 ELSE 0e0 END", "forecast_clear_sky_index_valid"), r("ghi[16] - clear", "forecast_ghi_minus_clear_sky"), r(f"CASE WHEN clear >= 20 AND ({csi} < 0 OR {csi} > 1.5e0) THEN 1e0 ELSE 0e0 END", "forecast_clear_sky_index_clipped")))),
        "factor.solar.power-clear-sky-index": (_LAG_SUN.format(lags="1, 4, 16, 96"), "sun GROUP", ", ".join(r(f"max(CASE WHEN k = {k} THEN {ratio.format(x=f'(p[-{k}] / {site}) / (clear / 1000)')} END)", f"power_clear_sky_index_lag_{k}") for k in lag4)),
        "factor.pv.module-temperature-proxy": ("", "pv", f'{r(f"temp[16] + {_HEAT}", "module_temperature_proxy")}, {r(_HEAT, "module_air_temperature_delta")}'),
        "factor.pv.temperature-corrected-irradiance": ("", "pv", f'{r(f"greatest(0, ghi[16] * (1 - 0.004e0 * (temp[16] + {_HEAT} - 25)))", "temperature_corrected_irradiance")}, {r(f"1 - 0.004e0 * (temp[16] + {_HEAT} - 25)", "temperature_derating_multiplier")}'),
        "factor.pv.low-irradiance-state": (_TARGET_SUN, "sun", f'{r(ratio.format(x="ghi[16] / clear"), "irradiance_clear_sky_ratio")}, {r("CASE WHEN ghi[16] > 0 AND ghi[16] < 200 THEN 1e0 ELSE 0e0 END", "low_irradiance_flag")}, {r("CASE WHEN elev > 0 AND elev < 10 THEN 1e0 ELSE 0e0 END", "low_sun_flag")}'),
        "factor.regime.clear-variable-overcast": (
            _LAG_SUN.format(lags=", ".join(map(str, range(1, 17)))) + f", q AS (SELECT station, origin, list({ratio.format(x='g[-k] / clear')} ORDER BY k DESC) AS x FROM sun GROUP BY 1, 2), st AS (SELECT station, origin, list_avg(x) AS m, list_stddev_pop(x) AS s, list_avg(list_transform(range(2, 17), lambda i: abs(x[i] - x[i - 1]))) AS v FROM q)",
            "st", ", ".join((r("m", "recent_clear_sky_ratio_mean"), r("s", "recent_clear_sky_ratio_std"), r("v", "recent_clear_sky_ratio_absdiff"), r("greatest(0, least(1, m)) * greatest(0, 1 - s)", "clear_regime_score"), r("greatest(0, least(1, s + v))", "variable_regime_score"), r("greatest(0, least(1, 1 - m))", "overcast_regime_score")))),
        "factor.regime.joint-weather-power-ramp": ("", "pv", f'{r(f"(p[-1] - p[-2]) / {site}", "recent_power_ramp_capacity_ratio")}, {r("(g[-1] - g[-2]) / 1000", "recent_ghi_ramp_normalized")}, {r("(ghi[16] - g[-1]) / 1000", "future_ghi_change_from_observation")}'),
        "factor.operation.clipping-score": (
            f", cl AS (SELECT station, origin, len(list_filter(p[-8:], lambda x: x / {site} >= 0.98e0)) / 8e0 AS n, len(list_filter(g[-8:], lambda x: x >= 800)) / 8e0 AS hi, greatest(0, 1 - list_stddev_pop(list_transform(p[-8:], lambda x: x / {site})) / 0.02e0) AS pl FROM pv)",
            "cl", f'{r("n", "near_capacity_fraction")}, {r("hi", "high_ghi_fraction")}, {r("pl", "power_plateau_score")}, {r("n * hi * pl", "clipping_score")}'),
        "factor.operation.weather-power-residual": (
            f", rs AS (SELECT station, origin, list_transform(range(1, 17), lambda i: p[-i] / {site} - greatest(0, least(1.2e0, g[-i] / 1000))) AS x FROM pv)",
            "rs", f'{r("x[1]", "weather_power_residual_latest")}, {r("list_avg(x)", "weather_power_residual_mean_16")}, {r("list_stddev_pop(x)", "weather_power_residual_std_16")}'),
    }


def _factor_query(factor_id: str, ctes: str, source: str, columns: str) -> None:
    name = "factor_" + factor_id.removeprefix("factor.").replace(".", "_").replace("-", "_")
    body = f"SELECT station AS station_id, origin, {columns} FROM sun GROUP BY station, origin" if source == "sun GROUP" else f"SELECT station AS station_id, origin, {columns} FROM {source}"

    @query(name, f"{ORIGINS_SQL}{ctes} {body}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings = settings_for()
        frame = add_factors(origins(spark, sf_dir, settings), settings, [factor_id])
        names = output_names([factor_id], settings)
        return rounded(frame.select("station_id", origin_text(), *[F.col(f"`{n}`").alias(n.rpartition("__")[2]) for n in names]))


for _id, _parts in _factor_sql().items():
    _factor_query(_id, *_parts)


def _all_factors_sql() -> str:
    """Of every factor output and station, the mean of its rounded values."""
    parts = []
    for factor_id, (ctes, source, columns) in _factor_sql().items():
        group = " GROUP BY station, origin" if source == "sun GROUP" else ""
        one = f"(WITH only_one AS (SELECT 1){ctes} SELECT station, origin, {columns} FROM {source.removesuffix(' GROUP')}{group})"
        prefix = column_name(factor_id, "")
        parts.append(f"SELECT station AS station_id, '{prefix}' || name AS feature, count(*) AS n_rows, round(avg(value), 4) + 0.0 AS mean FROM (UNPIVOT {one} ON COLUMNS(* EXCLUDE (station, origin)) INTO NAME name VALUE value) GROUP BY 1, 2")
    return f"{ORIGINS_SQL} " + " UNION ALL ".join(parts)


@query("feature_frame_all_factors", _all_factors_sql())
def feature_frame_all_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 22 factors at once: of every output and station, the mean of its values to six digits."""
    settings = settings_for()
    shown = {column_name(f, n) for f, (_, _, columns) in _factor_sql().items() for n in re.findall(r'AS "(\w+)"', columns)}
    names = [n for n in output_names(list(REGISTRY), settings) if n in shown]
    rows = rounded(feature_rows(spark, sf_dir, settings, tuple(REGISTRY)).select("station_id", *names))
    means = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(n).alias(n) for n in names])
    return means.unpivot(["station_id", "n_rows"], names, "feature", "mean").withColumn("mean", F.round("mean", 4) + 0.0)


def _fitted(spark: SparkSession, sf_dir: str):
    settings = settings_for()
    frame = feature_rows(spark, sf_dir, settings).cache()  # the checks pass over it several times
    train, validation = splits.train_validation(frame, settings)
    prepared = preprocessing.prepare(train, validation, features.vector(settings), features.feature_names(settings), settings, fingerprint=False)
    return settings, prepared


@query("quantile_transform")
def quantile_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir)[1].validation.select("row_id", "label", F.element_at("features", 5).alias("first_lag"))


@query("predict_scores")
def predict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted estimator's validation scores: train-only preprocessing, fit, clipped prediction, primary score."""
    settings, prepared = _fitted(spark, sf_dir)
    fitted = model.fit(prepared.train, prepared.validation, settings)
    return metrics.pooled_monthly(model.restore(fitted.predict(prepared.validation), prepared.labels), 404.0)
