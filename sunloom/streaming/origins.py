"""New origin rows as a stream through the same row-local projection.

Factors and base features only look at their own row, so a file-source stream
runs through them in append mode without state. Rules over whole files (largest
capacity, occurrence numbers) need all rows of a file: a stream takes capacity
from the site and has occurrence 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sunloom.operators.factors import add_factors
from sunloom.operators.factors.base import STEP
from sunloom.operators.features import lag_array, row_id
from sunloom.settings import Settings
from sunloom.sources.sites import BROADCAST_SITES
from sunloom.sources.stations import canonical_station


def read(spark: SparkSession, folder: str, schema: StructType, settings: Settings, files_per_batch: int = 100) -> DataFrame:
    glob = str(settings["data"]["parquet_glob"])
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def project(rows: DataFrame, sites: DataFrame, settings: Settings, factor_ids: Sequence[str] | None = ()) -> DataFrame:
    """Feature rows of a stream (or a batch) of origins; ``sites`` is static, and a row of an unknown station is an error, as in a batch run."""
    aliases = (settings["data"].get("site_metadata") or {}).get("aliases") or {}
    named = rows.withColumn("station_id", canonical_station(F.col(f"`{settings['data']['station_id_column']}`"), aliases))
    named = named.withColumn("timestamp", F.col(f"`{settings.columns['timestamp']}`").cast("timestamp_ntz"))
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    named = named.join(F.broadcast(sites) if small else sites, "station_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no site metadata for "), F.coalesce("station_id", F.lit("a station without a name"))))
    named = named.withColumn("site_capacity", F.when(F.col("site_capacity").isNull(), unknown.cast("double")).otherwise(F.col("site_capacity")))
    named = named.withColumn("capacity", F.col("site_capacity").cast("float")).withColumn("occurrence", F.lit(0)).withColumn("lags", lag_array(settings))
    out = add_factors(named, settings, factor_ids)
    target = F.timestamp_add("MINUTE", F.col(STEP) * settings.minutes, F.col("timestamp"))
    weather = {f"{c}_target": F.element_at(F.col(f"`{c}`"), F.col(STEP)).cast("float") for c in settings.weather}
    return out.withColumn("target_timestamp", target).withColumns({**weather, "predict_hour": F.hour("target_timestamp"), "predict_month": F.month("target_timestamp"), "row_id": row_id(F.col(STEP))})
