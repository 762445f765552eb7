"""Station files: discovery, scan, annotation, capacity and checks.

The result of ``scan`` has one row per forecast origin: ``station_id``,
``source_file``, ``timestamp``, ``row_order`` (position in its file), the array
columns, and ``capacity``. All stations are one lazy, partitioned frame; nothing
is read file by file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators.checks import DataError, reject
from sunloom.operators.factors import needs_irradiance_history
from sunloom.settings import Settings

IN_MEMORY = "<dataframe>"
#: Files whose capacities are broadcast at most (about 10 MB).
BROADCAST_FILES = 100_000
SITE_COLUMNS = ("site_capacity", "site_longitude", "site_latitude", "site_timezone")


def discover(spark: SparkSession, roots: str | Path | Sequence[str | Path], settings: Settings) -> list[str]:
    """Files, sorted and without repeats: a folder gives its direct children that match the glob, a file itself.

    Listing goes through Hadoop's file systems, so any store that Spark reads will do.
    """
    items = [roots] if isinstance(roots, str | Path) else list(roots)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = str(settings["data"]["parquet_glob"]).strip()
    found: set[str] = set()
    for item in items:
        path = jvm.org.apache.hadoop.fs.Path(str(item))
        store = path.getFileSystem(conf)
        if store.exists(path) and store.getFileStatus(path).isFile():
            found.add(store.makeQualified(path).toString())
            continue
        listed = store.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) if store.exists(path) else None
        found.update(s.getPath().toString() for s in listed or [])
    if not found:
        raise DataError(f"no station files match {pattern} below {[str(i) for i in items]}")
    return sorted(found)


def required_columns(settings: Settings, require_target: bool = True, factor_ids: Sequence[str] | None = ()) -> list[str]:
    """Columns that the scan reads, in order. ``factor_ids=None`` is the full contract."""
    data, columns = settings["data"], settings.columns
    names = [columns["timestamp"], data["station_id_column"], data["capacity_column"], columns["power_history"]]
    if needs_irradiance_history(factor_ids):
        names.append(columns["ghi_history"])
    if require_target:
        names.append(columns["power_future"])
    names += settings.weather
    if data.get("nwp_issue_time_column"):
        names.append(data["nwp_issue_time_column"])
    return list(dict.fromkeys(names))


def canonical_station(name: Column, aliases: Mapping[str, str]) -> Column:
    """Trimmed, by alias, trimmed again."""
    trimmed = F.trim(name.cast("string"))
    if not aliases:
        return trimmed
    pairs = F.create_map(*[F.lit(str(x).strip()) for kv in aliases.items() for x in kv])
    return F.trim(F.coalesce(F.try_element_at(pairs, trimmed), trimmed))


def read_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], drop_null_rows: bool = True) -> DataFrame:
    """The columns of the files, with source_file and row_order; rows with a null cell are dropped, files left empty are an error."""
    raw = spark.read.parquet(*paths)
    absent = [c for c in columns if c not in raw.columns]
    if absent:
        raise DataError(f"station files lack the columns {absent}")
    extra = [c for c in SITE_COLUMNS if c in raw.columns]
    frame = raw.select(*[F.col(f"`{c}`") for c in [*columns, *extra]], F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("row_order"))
    if drop_null_rows:
        frame = frame.na.drop(subset=list(columns))
        full = {r[0].rpartition("/")[2] for r in frame.select("__path").distinct().collect()}
        empty = [p for p in paths if p.rpartition("/")[2] not in full]
        if empty:
            raise DataError(f"no rows without nulls in {empty}")
    return frame.drop("__path")


def annotate(frame: DataFrame, settings: Settings) -> DataFrame:
    """station_id, source_file, timestamp and row_order; each file has one station, and its name isn't blank."""
    data = settings["data"]
    raw = F.trim(F.col(f"`{data['station_id_column']}`").cast("string"))
    if "source_file" not in frame.columns:
        frame = frame.withColumn("source_file", F.lit(IN_MEMORY))
    frame = frame.withColumn("source_file", F.coalesce("source_file", F.lit(IN_MEMORY)))
    if "row_order" not in frame.columns:
        frame = frame.withColumn("row_order", F.monotonically_increasing_id())
    aliases = (data.get("site_metadata") or {}).get("aliases") or {}
    out = frame.withColumn("__raw_station", raw).withColumn("station_id", canonical_station(raw, aliases))
    reject(out, {"a station name is blank": F.coalesce(F.col("station_id") == "", F.lit(True))}, ("source_file",))
    mixed = out.where(F.col("source_file") != IN_MEMORY).groupBy("source_file").agg(F.count_distinct("__raw_station").alias("n")).where("n > 1").limit(5).collect()
    if mixed:
        raise DataError(f"files with more than one station: {[r['source_file'] for r in mixed]}")
    return out.withColumn("timestamp", F.col(f"`{settings.columns['timestamp']}`").cast("timestamp_ntz")).drop("__raw_station")


def with_capacity(frame: DataFrame, settings: Settings) -> DataFrame:
    """``capacity``: the largest positive capacity of the station's file, for each of its rows.

    Grouped and joined back: the groups are files, so a station with a third of
    all rows is combined before the shuffle instead of being one window. Up to
    ``BROADCAST_FILES`` files, counted first, the wide rows aren't moved.
    """
    column = F.expr(f"try_cast(`{settings['data']['capacity_column']}` AS double)")
    positive = F.when(finite(column) & (column > 0), column)
    default = settings["data"].get("default_capacity")
    best = frame.groupBy("source_file", "station_id").agg(F.max(positive).alias("__best"))
    resolved = best.withColumn("capacity", F.coalesce("__best", F.lit(default).cast("double")).cast("float")).drop("__best")
    bad = ~finite(F.col("capacity")) | (F.col("capacity") <= 0)
    files = resolved.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if files["bad"]:
        raise DataError(f"no positive capacity for {[(r['source_file'], r['station_id']) for r in resolved.where(bad).limit(5).collect()]}")
    return frame.join(F.broadcast(resolved) if files["n"] <= BROADCAST_FILES else resolved, ["source_file", "station_id"])


def check_histories(frame: DataFrame, settings: Settings, require_target: bool, irradiance: bool) -> None:
    """Arrays are there and long enough, and power and irradiance histories are aligned."""
    columns, n = settings.columns, settings.history_length

    def short(name: str, least: int) -> Column:
        return F.coalesce(F.size(F.col(f"`{name}`")), F.lit(-1)) < least

    rules = {f"{columns['power_history']} has fewer than {n} values": short(columns["power_history"], n)}
    if irradiance:
        rules[f"{columns['ghi_history']} isn't aligned with {columns['power_history']}"] = short(columns["ghi_history"], n) | (F.size(F.col(f"`{columns['ghi_history']}`")) != F.size(F.col(f"`{columns['power_history']}`")))
    last = settings.horizons[-1]
    for name in [*([columns["power_future"]] if require_target else []), *settings.weather]:
        rules[f"{name} has fewer than {last} steps"] = short(name, last)
    reject(frame, rules)


def scan(spark: SparkSession, data: DataFrame | str | Path | Sequence[str | Path], settings: Settings, require_target: bool = True, factor_ids: Sequence[str] | None = ()) -> DataFrame:
    """Checked origin rows of all stations, lazily. A DataFrame keeps its null cells; files lose rows with one."""
    columns = required_columns(settings, require_target, factor_ids)
    if isinstance(data, DataFrame):
        absent = [c for c in columns if c not in data.columns]
        if absent:
            raise DataError(f"the frame lacks the columns {absent}")
        frame = data
    else:
        frame = read_files(spark, discover(spark, data, settings), columns)
    frame = with_capacity(annotate(frame, settings), settings)
    check_histories(frame, settings, require_target, needs_irradiance_history(factor_ids))
    return frame


def prune_by_role(frame: DataFrame, settings: Settings) -> DataFrame:
    """Only stations with a role, if every role names its stations."""
    union = settings.role_union()
    return frame if union is None else frame.where(F.col("station_id").isin(union))


def load_in_order(spark: SparkSession, data: DataFrame | str | Path | Sequence[str | Path], settings: Settings, require_target: bool = True, factor_ids: Sequence[str] | None = ()) -> DataFrame:
    """``scan`` sorted by origin, station and file, rows of a file in their order. For output only: everything else is order-free."""
    return scan(spark, data, settings, require_target, factor_ids).orderBy("timestamp", "station_id", "source_file", "row_order")


def distinct_sites(frame: DataFrame) -> DataFrame:
    """The site records that a frame's rows bring, each once."""
    return frame.select("station_id", *[c for c in SITE_COLUMNS if c in frame.columns]).distinct()


def manifest(frame: DataFrame) -> dict:
    """Station count, sorted ids, rows for each, and distinct site metadata where attached."""
    rows = frame.groupBy("station_id").count().orderBy("station_id").collect()
    out = {"station_count": len(rows), "station_ids": [r["station_id"] for r in rows], "rows": {r["station_id"]: r["count"] for r in rows}}
    if set(SITE_COLUMNS) & set(frame.columns):
        out["sites"] = [r.asDict() for r in distinct_sites(frame).orderBy("station_id").collect()]
    return out
