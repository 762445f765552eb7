"""Site metadata: the CSV, overrides, conflicts, and the join to station rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions.arrays import finite
from sunloom.operators.checks import DataError, missing_keys, reject
from sunloom.settings import TIMEZONE, Settings
from sunloom.sources.stations import SITE_COLUMNS, canonical_station

SITES = "station_id string, site_capacity double, site_longitude double, site_latitude double, site_timezone string"
#: Sites are broadcast to the station rows up to this number.
BROADCAST_SITES = 100_000


def read_csv(spark: SparkSession, settings: Settings) -> DataFrame:
    site = settings["data"]["site_metadata"]
    raw = spark.read.csv(str(site["path"]), header=True)
    names = [site[f"{n}_column"] for n in ("station", "capacity", "longitude", "latitude")]
    absent = [n for n in names if n not in raw.columns]
    if absent:
        raise DataError(f"the site metadata lacks the columns {absent}")
    station, *numbers = names
    values = [F.expr(f"try_cast(`{n}` AS double)").alias(c) for n, c in zip(numbers, SITE_COLUMNS, strict=False)]
    return raw.select(canonical_station(F.col(f"`{station}`"), site.get("aliases") or {}).alias("station_id"), *values, F.lit(site.get("timezone", TIMEZONE)).alias("site_timezone"))


def override(sites: DataFrame, settings: Settings) -> DataFrame:
    """Records of overridden stations are replaced by the override."""
    given = settings["data"]["site_metadata"].get("overrides") or {}
    if not given:
        return sites
    spark, zone = sites.sparkSession, settings["data"]["site_metadata"].get("timezone", TIMEZONE)
    rows = [(str(s), float(v["capacity"]), float(v["longitude"]), float(v["latitude"]), zone) for s, v in given.items()]
    own = spark.createDataFrame(rows, SITES)
    own = own.withColumn("station_id", canonical_station(F.col("station_id"), settings["data"]["site_metadata"].get("aliases") or {}))
    return replace_sites(sites, own)


def replace_sites(sites: DataFrame, own: DataFrame) -> DataFrame:
    """The sites that ``own`` doesn't name, then ``own``."""
    return sites.join(own.select("station_id"), "station_id", "left_anti").unionByName(own)


def conflicts(sites: DataFrame) -> DataFrame:
    """Stations whose records differ; a null differs from a value."""
    return sites.groupBy("station_id").agg(F.count_distinct(F.struct(*SITE_COLUMNS[:3])).alias("n_records")).where("n_records > 1")


def range_rules(capacity: Column, longitude: Column, latitude: Column) -> dict[str, Column]:
    def outside(x: Column, low: float, high: float) -> Column:
        return ~finite(x) | (x < low) | (x > high)

    return {
        "a site capacity isn't positive": ~finite(capacity) | (capacity <= 0),
        "a longitude is outside -180..180": outside(longitude, -180.0, 180.0),
        "a latitude is outside -90..90": outside(latitude, -90.0, 90.0),
    }


def load_sites(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """Checked sites, one row for each station; None if none are configured."""
    site = settings["data"].get("site_metadata") or {}
    if not site.get("path") and not site.get("overrides"):
        return None
    sites = read_csv(spark, settings) if site.get("path") else spark.createDataFrame([], SITES)
    sites = override(sites, settings)
    if found := conflicts(sites).limit(5).collect():
        raise DataError(f"site records of a station differ: {[r['station_id'] for r in found]}")
    sites = sites.dropDuplicates(["station_id"])
    reject(sites, range_rules(*[F.col(c) for c in SITE_COLUMNS[:3]]), ("station_id",))
    return sites


def attach(frame: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Site columns by station. Without sites, a frame may bring all four itself, or none."""
    have = [c for c in SITE_COLUMNS if c in frame.columns]
    if sites is None:
        if have and len(have) < len(SITE_COLUMNS):
            raise DataError(f"site columns come together: only {have} are there")
        if have:
            rules = range_rules(*[F.col(c) for c in SITE_COLUMNS[:3]])
            reject(frame, rules | {f"a time zone isn't {TIMEZONE}": ~F.coalesce(F.col("site_timezone") == TIMEZONE, F.lit(False))})
        return frame
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    joined = frame.drop(*SITE_COLUMNS).join(F.broadcast(sites) if small else sites, "station_id", "left")
    absent = missing_keys(frame, sites, "station_id").orderBy("station_id").limit(5).collect()
    if absent:
        raise DataError(f"no site metadata for {[r['station_id'] for r in absent]}")
    return joined
