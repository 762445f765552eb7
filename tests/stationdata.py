"""Origin rows as the sources expect them."""

from datetime import datetime

from pyspark.sql import functions as F

from sunloom.settings import default_config, load_settings

SCHEMA = (
    "timestamp_win timestamp_ntz, station string, cap_power_on double, Power array<float>, GHI_real array<float>, Power_predict array<float>, "
    "GHI_SOLARGIS_predict array<float>, TEMP_SOLARGIS_predict array<float>, WS_SOLARGIS_predict array<float>, WD_SOLARGIS_predict array<float>"
)


def row(station="s1", when="2024-09-10 12:00:00", capacity=500.0, shift=0.0, power=None, irradiance=None, future=None):
    power = [float(i + shift) for i in range(96)] if power is None else power
    future = [float(i) for i in range(16)] if future is None else future
    return (
        datetime.fromisoformat(when), station, capacity, power, [10.0 * p for p in power] if irradiance is None else irradiance, [100.0 + f for f in future],
        [200.0 + f for f in future], [20.0 + f for f in future], [2.0 + f for f in future], [100.0 + f for f in future],
    )


def frame(spark, *rows, site=True):
    df = spark.createDataFrame(list(rows or [row()]), SCHEMA)
    return with_site(df) if site else df


def with_site(df, capacity=500.0):
    return df.withColumns({"site_capacity": F.lit(capacity), "site_longitude": F.lit(121.5), "site_latitude": F.lit(31.2), "site_timezone": F.lit("Asia/Shanghai")})


def settings(split=None, **features):
    config = default_config()
    config["features"] |= features
    config["split"] |= split or {}
    return load_settings(config)
